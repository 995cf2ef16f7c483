"""Near-duplicate components by min-max hashing.

Each document is the set of its five-word shingles. Under every permutation both the smallest and the largest
value are kept, so 64 hash evaluations give a signature of 128. Bands of four values make 32 keys; two sets
with a similarity of 0.75 share none with a probability of 5e-6 if they are large, and of less than 1e-5 if one has FEW
shingles. On smaller sets minimum and maximum depend on each other, so these have keys of another kind besides, by which
no link between them is missed: their rarest shingles, as many as any two similar sets must have one in common of.

1. Documents with equal shingle sets are one class, stood for by its smallest id. Only classes are compared.
2. In each bucket (classes with an equal band key) every class is paired with the bucket's smallest one: as many
   pairs as members, never all pairs. Pairs are confirmed on full shingle sets; components follow by alternating
   large-star and small-star steps over tables.
3. Buckets whose members ended in different components are searched for the links that the stars missed. In pairs of
   blocks of bounded size, those of a group's largest component not among each other, signatures show which members can have a partner in another component; these components
   make clusters. Each cluster's members are then compared on full shingle sets, again in pairs of blocks, each pair
   of members once however many buckets they share, and only links that merge components leave a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.llm.store import written
from lociforge.llm.words import Words, blobs, bytes_of, chunks, grams, unblob

PERMUTATIONS, BAND = 64, 4
#: Members of a bucket whose signatures one task compares with another such block.
BLOCK = 512
#: Sets of fewer shingles are linked by the shingles themselves, too.
FEW = 20
#: How many deviations below its similarity the share of equal signature values of a pair may lie.
DEVIATIONS = 5.25
_RNG = np.random.Generator(np.random.PCG64(20240229))
_MULT = (_RNG.integers(0, 1 << 32, PERMUTATIONS, np.uint64) | np.uint64(1)).astype(np.uint32)
_FLIP = _RNG.integers(0, 1 << 32, PERMUTATIONS, np.uint64).astype(np.uint32)
_MIX = _RNG.integers(0, 1 << 63, 2 * PERMUTATIONS, np.uint64) | np.uint64(1)

SIGNED = "id bigint, n_shingles bigint, class binary, bands array<bigint>, signature binary, few array<bigint>"


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
    words = Words(texts, lower=True)
    h = words.hashes()
    g = grams(h, size)
    for a, b in zip(words.of[:-1].tolist(), words.of[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(g[a : b - size + 1])
            yield x[np.append(True, x[1:] != x[:-1])]
        else:
            yield grams(h[a:b], b - a) if b > a else h[:0]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min and max under each permutation, one row for each non-empty set."""
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint32)
    step, at = 1 << 16, 0
    while at < len(sets):
        upto, total = at + 1, len(sets[at])
        while upto < len(sets) and total + len(sets[upto]) <= step:
            total += len(sets[upto])
            upto += 1
        x = (np.concatenate(sets[at:upto]) >> np.uint64(32)).astype(np.uint32)
        cut = np.cumsum([0, *map(len, sets[at : upto - 1])])
        for k in range(PERMUTATIONS):
            v = (x ^ _FLIP[k]) * _MULT[k]
            np.minimum.reduceat(v, cut, out=out[at:upto, 2 * k])
            np.maximum.reduceat(v, cut, out=out[at:upto, 2 * k + 1])
        at = upto
    return out


def least_equal(percent: int, values: int = 2 * PERMUTATIONS) -> int:
    """Equal signature values that a pair worth confirming has at least."""
    p = percent / 100
    return max(0, int(values * p - DEVIATIONS * (values * p * (1 - p)) ** 0.5))


def _signer(size: int, percent: int):
    most = 100 * (FEW - 1) // percent  # shingles of a set that can be similar to one of fewer than FEW

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = list(shingle_sets(batch.column("text"), size))
            full = [k for k, x in enumerate(sets) if len(x)]
            sig = signatures([sets[k] for k in full])
            x = sig.astype(np.uint64) * _MIX
            x ^= x >> np.uint64(31)
            keys = x.reshape(len(full), -1, BAND).sum(2, dtype=np.uint64)
            keys = (keys ^ (keys >> np.uint64(29))) * _MIX[: keys.shape[1]]
            yield pa.record_batch(
                [
                    batch.column("id").take(pa.array(full, pa.int64())),
                    pa.array([len(sets[k]) for k in full], pa.int64()),
                    pa.array([hashlib.blake2b(sets[k], digest_size=16).digest() for k in full], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(len(full) + 1, dtype=np.int32) * keys.shape[1], keys.astype(np.int64).ravel()),
                    pa.array([r.tobytes() for r in sig], pa.binary()),
                    pa.array([sets[k].astype(np.int64) if len(sets[k]) <= most else None for k in full], pa.list_(pa.int64())),
                ],
                ["id", "n_shingles", "class", "bands", "signature", "few"],
            )

    return sign


def _verifier(size: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks([whole], "a_text"):
                left = {}
                a_ids = batch.column("a").to_pylist()
                first = {x: k for k, x in reversed(list(enumerate(a_ids)))}
                take = batch.column("a_text").take(pa.array(list(first.values())))
                left = dict(zip(first, shingle_sets(take, size), strict=True))
                ok, at = [], 0
                for part in chunks([batch], "b_text"):
                    for x in shingle_sets(part.column("b_text"), size):
                        y = left[a_ids[at]]
                        both = np.intersect1d(x, y, assume_unique=True).size
                        ok.append(100 * both >= percent * (len(x) + len(y) - both))
                        at += 1
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return verify


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b), n being about how many an a has, whose full shingle sets are similar enough; texts: (id, text).

    An a of many pairs is salted: each BLOCK of its pairs is a key of its own, to which the text of a is copied.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK))).select("a", "b", "salt")
    a, b = (texts.select(F.col("id").alias(k), F.col("text").alias(f"{k}_text")) for k in "ab")
    heads = salted.select("a", "salt").distinct().join(a, "a")
    return salted.join(b, "b").join(heads, ["a", "salt"]).select("a", "b", "a_text", "b_text").mapInArrow(_verifier(size, percent), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of an edge (a, b): the smallest id that it reaches."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.where("u <> v").distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Members of the two blocks, and whether they are one and the same."""
    part, i, j = table.column("part").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
    return np.flatnonzero(part == i), np.flatnonzero(part == j), i == j


def _close(percent: int):
    least = least_equal(percent)

    def candidates(table: pa.Table) -> pa.Table:
        """The members of two blocks whose signature is close to that of a member of another component.

        Rows (id, component, other): other components to which close pairs lead, as few as connect what they connect;
        a member without such a row has one with its own component.
        """
        table = table.combine_chunks()
        ids, comp = table.column("id").to_numpy(), table.column("component").to_numpy()
        sig = np.frombuffer(bytes_of(table.column("signature"))[0].tobytes(), np.uint32).reshape(len(comp), -1)
        left, right, _ = _sides(table)
        seen, group, rows = np.zeros(len(comp), bool), comp.copy(), []
        others, of = sig[right], comp[right]
        for x in left if len(right) else ():
            far = of != comp[x]
            if not far.any():
                continue
            close = far & ((others == sig[x]).sum(1) >= least)
            if close.any():
                seen[x] = True
                seen[right[close]] = True
                while (apart := close & (group[right] != group[x])).any():
                    y = right[int(apart.argmax())]
                    rows.append((ids[x], comp[x], comp[y]))
                    group[group == group[y]] = group[x]
        out = np.concatenate([np.array(rows, np.int64).reshape(-1, 3), np.stack([ids[seen], comp[seen], comp[seen]], 1)])
        return pa.table([pa.array(out[:, k]) for k in range(3)], ["id", "component", "other"])

    return candidates


def _merging(percent: int):
    def link(table: pa.Table) -> pa.Table:
        """Confirmed links between two blocks, as many as it takes to merge the components that they merge."""
        table = table.combine_chunks()
        ids, comp = table.column("id").to_numpy(), table.column("component").to_numpy()
        values, of = unblob(table.column("shingles"), np.uint64)
        coded = pa.array(values).dictionary_encode()
        index, size = coded.indices.to_numpy(), np.diff(of)
        left, right, same = _sides(table)
        others = np.concatenate([index[of[r] : of[r + 1]] for r in right]) if len(right) else index[:0]
        cut = np.cumsum(size[right]) - size[right]
        mark = np.zeros(len(coded.dictionary), bool)
        group = comp.copy()
        out = []
        for x in left if len(right) else ():
            if same and (group[right] == group[x]).all():
                continue
            mine = index[of[x] : of[x + 1]]
            mark[mine] = True
            both = np.add.reduceat(mark[others], cut, dtype=np.int64)
            mark[mine] = False
            good = (100 * both >= percent * (size[x] + size[right] - both)) & (group[right] != group[x])
            while good.any():
                y = right[int(good.argmax())]
                out.append((ids[x], ids[y]))
                group[group == group[y]] = group[x]
                good &= group[right] != group[x]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return link


def _shingler(size: int):
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = list(shingle_sets(batch.column("text"), size))
            ends = np.append(0, np.cumsum([len(x) for x in sets]))
            yield pa.record_batch([batch.column("id"), blobs(np.concatenate(sets), ends).cast(pa.binary())], ["id", "shingles"])

    return shingle


def rarest(reps: DataFrame, percent: int) -> DataFrame:
    """(id, band): from (class, id, few), the rarest shingles of each set, but for those that no other has.

    Two sets whose intersection is `percent` of their union share at least as much of each, so one of the first
    n - ceil(n * percent / 100) + 1 of its shingles, in an order that is the same for all.
    """
    each = reps.where("few is not null").select("class", "id", F.explode("few").alias("band"))
    counts = each.groupBy("band").agg(F.count("*").alias("n"))
    order = each.join(counts, "band").groupBy("class", "id").agg(F.sort_array(F.collect_list(F.struct("n", "band"))).alias("x"))
    n = F.size("x")
    first = F.slice("x", 1, n - F.ceil(n * percent / 100).cast("int") + 1)
    return order.select("id", F.explode(first).alias("x")).where("x.n > 1").select("id", "x.band")


def links(reps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, component) of the classes that are linked with another, by confirmed links."""
    keyed = reps.select("id", F.explode("bands").alias("band")).unionByName(written(rarest(reps, percent)))
    buckets = written(keyed.groupBy("band").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1"))
    members = written(keyed.join(buckets, "band"))
    texts = written(texts.join(members.select("id").distinct(), "id", "left_semi"))
    stars = members.where("id <> head").groupBy(F.col("head").alias("a"), F.col("id").alias("b")).agg(F.max("n").alias("n"))
    edges = written(confirmed(stars, texts, size, percent))
    comp = written(components(edges))
    # buckets with the same members are looked through once
    kinds = members.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("head"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("x")).groupBy("n", "head", "x").agg(F.min("band").alias("band")).select("band")
    now = members.join(kinds, "band").join(comp, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    # blocks of one bucket are spread anew, not left where the bucket was
    blocks = _in_pairs(now, "band").select("band", "i", "j", "part", "id", "component").join(reps.select("id", "signature"), "id")
    close = written(blocks.repartition("band", "i", "j").groupBy("band", "i", "j").applyInArrow(_close(percent), "id bigint, component bigint, other bigint").distinct())
    clusters = components(close.select(F.col("component").alias("a"), F.col("other").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("cluster"))
    near = written(close.select("id", "component").distinct().join(clusters, "component"))
    sets = texts.join(near.select("id").distinct(), "id", "left_semi").mapInArrow(_shingler(size), "id bigint, shingles binary")
    blocks = _in_pairs(near, "cluster").select("cluster", "i", "j", "part", "id", "component").join(sets, "id")
    more = written(blocks.repartition("cluster", "i", "j").groupBy("cluster", "i", "j").applyInArrow(_merging(percent), "a bigint, b bigint"))
    return written(components(edges.unionByName(more))) if more.limit(1).count() else comp


def _in_pairs(members: DataFrame, group: str) -> DataFrame:
    """Members (id, component) of groups dealt to blocks of about BLOCK, a row for each pair (i, j) of blocks that has theirs.

    Members of one component need not be compared. So a group's largest component has blocks of its own, which are paired
    with the blocks of the others only: a large group in which few stand apart costs little more than its members.
    """
    sizes = members.groupBy(group, "component").agg(F.count("*").alias("n"))
    top = sizes.groupBy(group).agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    top = top.select(group, F.col("top.component").alias("major"), blocks(F.col("n") - F.col("top.n")).alias("few"), blocks(F.col("top.n")).alias("many"))
    minor, h = F.col("component") != F.col("major"), F.xxhash64("id")
    part = F.when(minor, F.pmod(h, F.col("few"))).otherwise(F.col("few") + F.pmod(h, F.col("many"))).cast("int")
    own = members.join(top.where("few > 0"), group).withColumn("part", part)
    partners = F.sequence(F.lit(0), F.when(minor, F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)
    pairs = F.transform(partners, lambda p: F.struct(F.least(p, "part").alias("i"), F.greatest(p, "part").alias("j")))
    return own.select("*", F.explode(pairs).alias("p")).select("*", "p.i", "p.j")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """Groups documents that are linked by similar shingle sets (100 * intersection >= percent * union).

    Returns for each row of df: id_col, n_shingles, component_id (the smallest id reachable), kept (whether that is the
    row's own id). Words are runs without white space, A-Z lower-cased; shingles are `size` words, the whole sequence of
    a shorter text is its only one. Texts without words and null texts have no shingles and link with nothing.
    Rows with a null id are not compared: component_id null, kept true. Rows that repeat an id get the component of the
    smallest that any of their texts reaches. An empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(docs.where("id is not null").mapInArrow(_signer(size, percent), SIGNED))
    reps = signed.groupBy("class").agg(F.min("id").alias("id"), F.min(F.struct("id", "bands", "signature", "few")).alias("s")).select("class", "id", "s.bands", "s.signature", "s.few")
    reps = written(reps)
    comp = links(reps, docs.where("id is not null"), size, percent)
    by_class = reps.select("class", F.col("id").alias("rep")).join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component"))
    own = signed.select("id", "n_shingles", "class").join(by_class, "class").groupBy("id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component").alias("component"))
    out = docs.select("id").join(own, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), component.alias("component_id"), (component.isNull() | (component == F.col("id"))).alias("kept"))

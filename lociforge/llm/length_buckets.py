"""Packing into optimal length buckets.

All lengths are counted in one global histogram. Dynamic programming over it chooses the bucket boundaries that leave
the least padding when each sequence is padded to the upper boundary of its bucket. Inside a bucket, sequences are
numbered and cut into batches of as many as fit a token budget.

The driver sees the histogram only: a row for each distinct length, however many documents there are. Numbering is
done in parts of about PART_ROWS rows and shifted by the sizes of the parts before, so no bucket is sorted in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociforge.llm.quality import words
from lociforge.llm.store import written

PART_ROWS = 50_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Upper boundaries of at most `buckets` buckets with the least padding, and that padding.

    The padding of a bucket satisfies the quadrangle inequality, so the best last cut grows with the end of the range
    and each layer is solved by halving: O(buckets * n log n) for n distinct lengths.
    """
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(x)
    if not n:
        return [], 0
    total, weight = np.append(0, np.cumsum(c)), np.append(0, np.cumsum(c * x))
    best = np.append(0, x * total[1:] - weight[1:])  # one bucket for the first j lengths
    cuts = []
    for _ in range(min(buckets, n) - 1):
        new, cut = best.copy(), np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            low, high, a, b = todo.pop()
            j = (low + high) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + x[j - 1] * (total[j] - total[i]) - (weight[j] - weight[i])
            k = int(cost.argmin())
            new[j], cut[j] = cost[k], i[k]
            if low < j:
                todo.append((low, j - 1, a, int(i[k])))
            if j < high:
                todo.append((j + 1, high, int(i[k]), b))
        cuts.append(cut)
        best = new
    out, j = [], n
    for cut in reversed(cuts):
        out.append(int(x[j - 1]))
        j = int(cut[j])
        if not j:
            break
    if j:
        out.append(int(x[j - 1]))
    return out[::-1], int(best[n])


def length_buckets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, buckets: int = 16, budget: int = 16384) -> DataFrame:
    """Deals every row of df to a bucket and a batch.

    length counts a row's tokens; by default the words (runs without white space) of text_col. Returns for each row:
    id_col, n_tokens, bucket_tokens (what the batch is padded to), batch (number inside the bucket; rows are in order of a hash, then of the id),
    slot (place in the batch), padding. A batch holds budget // bucket_tokens rows, one at least: a row longer than the
    budget is a batch of its own. Null and empty texts have no tokens and go to the first bucket. Rows with null ids come
    first, in any order; so do rows that repeat an id among each other. An empty table gives an empty result.
    """
    count = F.size(words(F.col(text_col))) if length is None else length
    rows = written(df.select(F.col(id_col).alias("id"), F.coalesce(count, F.lit(0)).cast("long").alias("n")))
    histogram = rows.groupBy("n").count().collect()
    ends, _ = boundaries(np.array([r["n"] for r in histogram], np.int64), np.array([r["count"] for r in histogram], np.int64), buckets)
    bucket, parts = F.lit(None).cast("long"), F.lit(1)
    for start, end in reversed(list(zip([-1, *ends], ends, strict=False))):
        bucket = F.when(F.col("n") <= end, end).otherwise(bucket)
        inside = sum(r["count"] for r in histogram if start < r["n"] <= end)
        parts = F.when(F.col("n") <= end, -(-inside // PART_ROWS)).otherwise(parts)
    # parts are chosen by a hash of the row, so their order does not depend on the cluster
    rows = rows.select("id", "n", bucket.alias("bucket"), F.pmod(F.xxhash64("id", "n"), parts).alias("part"))
    sizes = rows.groupBy("bucket", "part").count()
    before = sizes.select("bucket", "part", (F.sum("count").over(W.partitionBy("bucket").orderBy("part")) - F.col("count")).alias("before"))
    inner = F.row_number().over(W.partitionBy("bucket", "part").orderBy("id", "n")) - 1
    numbered = rows.withColumn("inner", inner).join(before, ["bucket", "part"])
    place, fit = F.col("inner") + F.col("before"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket", F.lit(1)))).cast("long")
    return numbered.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("bucket").alias("bucket_tokens"), F.floor(place / fit).cast("long").alias("batch"), (place % fit).cast("long").alias("slot"), (F.col("bucket") - F.col("n")).alias("padding"))

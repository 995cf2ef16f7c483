"""A logistic regression with horseshoe-shrunk weights, as an ML Estimator: its posterior tells features with effects from noise.

weight j = z_j * tau * lambda_j * sqrt(c_j), with z_j normal, the global scale tau and the local scales lambda_j half-Cauchy, and
c_j inverse gamma; the intercept is normal with a deviation of 10. Scales are fitted by their logarithms. The posterior of all
of these is approximated by a normal distribution whose covariance is a diagonal and a matrix of low rank.

Samples are packed into blocks once, by partition and hash slice, and stay there. If they are more than SMALL bytes, a step of the
fit is one job over a slice (a minibatch): each task multiplies its blocks with a few posterior draws of the weights and returns
sums, a number for each feature and draw; the approximation itself lives on the driver, and has the size of the features. Fewer
bytes are read by one task, which takes the same steps over the same slices: a fit is one job then, where starting hundreds of
them takes longer than what they do. The last step of an epoch also takes the loss of the held-out slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.sources.shared import kept

#: The slice of held-out rows; packed bytes of a fit that one task may hold; rows that are multiplied at a time.
HELD, SMALL, ROWS = -1, 1 << 26, 4096


def _array(df: DataFrame, column: str) -> Column:
    return F.when(F.col(column).isNotNull(), vector_to_array(column)) if dict(df.dtypes)[column] == "vector" else F.col(column).cast("array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class LowRankNormal:
    """A normal distribution with covariance diag(exp(2 s)) + v v'."""

    def __init__(self, loc: np.ndarray, s: np.ndarray, v: np.ndarray):
        self.p = {"loc": loc, "s": s, "v": v}

    def draw(self, rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n draws, a row each, and the two kinds of noise that they were made of."""
        e, f = rng.normal(size=(n, len(self.p["loc"]))), rng.normal(size=(n, self.p["v"].shape[1]))
        return self.p["loc"] + np.exp(self.p["s"]) * e + f @ self.p["v"].T, e, f

    def slopes(self, g: np.ndarray, e: np.ndarray, f: np.ndarray) -> dict[str, np.ndarray]:
        """Slopes of the mean of a function with slopes g at draws made of e and f, plus those of the entropy."""
        s, v, n = np.exp(self.p["s"]), self.p["v"], len(g)
        w = v / (s**2)[:, None]
        inner = np.linalg.inv(np.eye(v.shape[1]) + v.T @ w)
        solved = w - w @ (inner @ (v.T @ w))  # the inverse covariance times v
        inverse = 1 / s**2 - np.einsum("ij,jk,ik->i", w, inner, w)
        return {"loc": g.mean(0), "s": (g * e).mean(0) * s + s**2 * inverse, "v": g.T @ f / n + solved}

    def entropy(self) -> float:
        v = self.p["v"]
        w = v * np.exp(-2 * self.p["s"])[:, None]
        return float(self.p["s"].sum() + 0.5 * np.linalg.slogdet(np.eye(v.shape[1]) + v.T @ w)[1])


def weights(theta: np.ndarray) -> np.ndarray:
    """Weights of rows (z, log lambda, log c, log tau, intercept)."""
    d = (theta.shape[1] - 2) // 3
    return theta[:, :d] * np.exp(np.clip(theta[:, d : 2 * d] + theta[:, 2 * d : 3 * d] / 2 + theta[:, 3 * d : 3 * d + 1], -30, 30))


def log_prior_slopes(theta: np.ndarray, shape: float = 1.0) -> np.ndarray:
    """Slopes of the log prior densities of rows (z, log lambda, log c, log tau, intercept)."""
    d = (theta.shape[1] - 2) // 3
    cauchy = lambda u: 1 - 2 / (1 + np.exp(-2 * np.clip(u, -30, 30)))
    return np.concatenate([-theta[:, :d], cauchy(theta[:, d : 2 * d]), shape * (np.exp(-np.clip(theta[:, 2 * d : 3 * d], -30, 30)) - 1), cauchy(theta[:, 3 * d : 3 * d + 1]), -theta[:, 3 * d + 1 :] / 100], 1)


def joint_slopes(theta: np.ndarray, by_weight: np.ndarray, by_intercept: np.ndarray) -> np.ndarray:
    """Slopes of log likelihood and prior, from those of the likelihood by weights (a row for each draw) and intercepts."""
    d = by_weight.shape[1]
    w = weights(theta)
    scale = np.exp(np.clip(theta[:, d : 2 * d] + theta[:, 2 * d : 3 * d] / 2 + theta[:, 3 * d : 3 * d + 1], -30, 30))
    pull = by_weight * w
    return np.concatenate([by_weight * scale, pull, pull / 2, pull.sum(1, keepdims=True), by_intercept[:, None]], 1) + log_prior_slopes(theta)


def _pack(width: int, mean: np.ndarray, scale: np.ndarray):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = ((_matrix(batch.column("x"), width) - mean) / scale).astype(np.float32)
            y, s = batch.column("y").to_numpy(zero_copy_only=False).astype(np.float32), batch.column("slice").to_numpy()
            found = np.unique(s)
            yield pa.record_batch([pa.array(found, pa.int32()), pa.array([x[s == k].tobytes() for k in found], pa.binary()), pa.array([y[s == k].tobytes() for k in found], pa.binary())], ["slice", "x", "y"])

    return pack


def _slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slopes of the rows' log likelihood by weights and intercept at each draw (rows of w, b)."""
    g = np.zeros((len(w), w.shape[1] + 1))
    for k in range(0, len(y), ROWS):
        part = x[k : k + ROWS].astype(float)
        r = part @ w.T
        r += b
        np.clip(r, -30, 30, out=r)
        np.exp(np.negative(r, out=r), out=r)
        r += 1
        np.subtract(y[k : k + ROWS, None], np.reciprocal(r, out=r), out=r)
        g[:, :-1] += r.T @ part
        g[:, -1] += r.sum(0)
    return g


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: float) -> float:
    """The rows' loss."""
    z = np.clip(x @ w + b, -30, 30)
    return float((np.log1p(np.exp(z)) - y * z).sum())


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks as slice, features and labels."""
    for batch in batches:
        for k, xs, ys in zip(batch.column("slice").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
            y = np.frombuffer(ys.as_buffer(), np.float32)
            yield k, np.frombuffer(xs.as_buffer(), np.float32).reshape(len(y), -1), y


def _sums(w: np.ndarray, b: np.ndarray, mean_w: np.ndarray, mean_b: float):
    """A partition's sums: slopes of the log likelihood at each draw (rows of w, b), or the held-out loss at the mean."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n, held, n_held = np.zeros((len(w), w.shape[1] + 1)), 0, 0.0, 0
        for k, x, y in _unpacked(batches):
            if k == HELD:
                held, n_held = held + _loss(x, y, mean_w, mean_b), n_held + len(y)
            else:
                g += _slopes(x, y, w, b)
                n += len(y)
        if n or n_held:
            yield pa.record_batch([pa.array([n]), pa.array([held]), pa.array([n_held]), pa.array([g.tobytes()], pa.binary())], ["n", "held", "n_held", "g"])

    return go


def _added(table: pa.Table) -> pa.Table:
    g = np.sum([np.frombuffer(x.as_buffer()) for x in table.column("g")], 0)
    total = lambda c: pa.array([table.column(c).to_numpy().sum()])
    return pa.table([total("n"), total("held"), total("n_held"), pa.array([g.tobytes()], pa.binary())], ["n", "held", "n_held", "g"])


_SUMS = "n bigint, held double, n_held bigint, g binary"

#: Rows of slices, their held-out loss and rows, and their slopes, at draws of weights and intercepts and at a mean of both.
Sums = Callable[[list[int], np.ndarray, np.ndarray, np.ndarray, float], tuple[int, float, int, np.ndarray]]


def _spread(blocks: DataFrame) -> Sums:
    """Sums as a job over all partitions."""
    parts = blocks.rdd.getNumPartitions()

    def sums(wanted: list[int], w: np.ndarray, b: np.ndarray, mean_w: np.ndarray, mean_b: float) -> tuple[int, float, int, np.ndarray]:
        found = blocks.where(F.col("slice").isin(wanted)).mapInArrow(_sums(w, b, mean_w, mean_b), _SUMS)
        if parts > 64:  # partial sums of many partitions meet in a few tasks first
            found = found.groupBy(F.pmod(F.spark_partition_id(), F.lit(16))).applyInArrow(_added, _SUMS)
        got = found.collect()
        g = np.sum([np.frombuffer(r.g) for r in got], 0) if got else np.zeros(1)
        return sum(r.n for r in got), sum(r.held for r in got), sum(r.n_held for r in got), g.reshape(len(w), -1) if got else g

    return sums


def _gathered(batches: Iterator[pa.RecordBatch]) -> Sums:
    """Sums over blocks that are all here."""
    found: dict[int, list] = {}
    for k, x, y in _unpacked(batches):
        found.setdefault(k, []).append((x, y))
    slices = {k: tuple(map(np.concatenate, zip(*found.pop(k), strict=True))) for k in list(found)}

    def sums(wanted: list[int], w: np.ndarray, b: np.ndarray, mean_w: np.ndarray, mean_b: float) -> tuple[int, float, int, np.ndarray]:
        rows = [slices[k] for k in wanted if k != HELD and k in slices]
        held = [slices[k] for k in wanted if k == HELD and k in slices]
        g = np.zeros((len(w), w.shape[1] + 1))
        for x, y in rows:
            g += _slopes(x, y, w, b)
        return sum(len(y) for _, y in rows), sum(_loss(x, y, mean_w, mean_b) for x, y in held), sum(len(y) for _, y in held), g

    return sums


def climb(sums: Sums, size: float, d: int, get: dict) -> tuple[dict[str, np.ndarray], float]:
    """The posterior's parameters after the best epoch, and the loss there (infinite without held-out rows); get: the estimator's parameters."""
    rng = np.random.Generator(np.random.PCG64(get["seed"]))
    loc = np.zeros(3 * d + 2)
    loc[3 * d] = -2.5  # weights begin near 0, of certain scale
    q = LowRankNormal(loc, np.full(len(loc), -3.0), 0.01 * rng.normal(size=(len(loc), get["rank"])))
    m, s = ({k: np.zeros(v.shape) for k, v in q.p.items()} for _ in range(2))
    best, least, since, step = {k: v.copy() for k, v in q.p.items()}, np.inf, 0, 0
    for _ in range(get["maxEpochs"]):
        order = rng.permutation(get["slices"])
        for at in order:
            theta, e, f = q.draw(rng, get["drawsPerStep"])
            middle = q.p["loc"][None]
            n, held, n_held, g = sums([int(at), HELD] if at == order[-1] else [int(at)], weights(theta), theta[:, -1], weights(middle)[0], float(middle[0, -1]))
            step += 1
            if n:
                g = g * (size / n)
                slopes = q.slopes(joint_slopes(theta, g[:, :-1], g[:, -1]), e, f)
                norm = np.sqrt(sum((v**2).sum() for v in slopes.values())) / size
                for k, v in slopes.items():
                    v = v / size * min(1.0, get["clipNorm"] / max(norm, 1e-300))
                    m[k] += 0.1 * (v - m[k])
                    s[k] += 0.01 * (v * v - s[k])
                    q.p[k] = q.p[k] + get["stepSize"] * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-10)
                q.p["s"] = np.clip(q.p["s"], -8, 3)
            if n_held:
                since += 1
                if held / n_held < least:  # the loss is that of the parameters before this step
                    best, least, since = {k: v.copy() for k, v in q.p.items()}, held / n_held, 0
        if since >= get["patience"]:
            break
    return best if np.isfinite(least) else q.p, least


def _in_one_task(blocks: DataFrame, size: float, d: int, get: dict) -> tuple[dict[str, np.ndarray], float]:
    """climb as one task over all blocks."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, least = climb(_gathered(batches), size, d, get)
        yield pa.record_batch([*(pa.array([p[k].tobytes()], pa.binary()) for k in ("loc", "s", "v")), pa.array([least])], ["loc", "s", "v", "least"])

    r = blocks.coalesce(1).mapInArrow(go, "loc binary, s binary, v binary, least double").first()
    loc, s, v = map(np.frombuffer, (r.loc, r.s, r.v))
    return {"loc": loc, "s": s, "v": v.reshape(len(loc), -1)}, r.least


class _HorseshoeParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed):
    maxEpochs = Param(Params._dummy(), "maxEpochs", "epochs at most", TypeConverters.toInt)
    slices = Param(Params._dummy(), "slices", "minibatches of an epoch", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "Adam's rate", TypeConverters.toFloat)
    clipNorm = Param(Params._dummy(), "clipNorm", "longest slope of a step, per sample", TypeConverters.toFloat)
    rank = Param(Params._dummy(), "rank", "rank of the covariance beside its diagonal", TypeConverters.toInt)
    drawsPerStep = Param(Params._dummy(), "drawsPerStep", "posterior draws of a step", TypeConverters.toInt)
    heldOut = Param(Params._dummy(), "heldOut", "share of rows that tell the best epoch", TypeConverters.toFloat)
    patience = Param(Params._dummy(), "patience", "epochs without a better one before the fit ends", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(maxEpochs=80, slices=4, stepSize=0.03, clipNorm=1.0, rank=4, drawsPerStep=32, heldOut=0.2, patience=15, seed=42)

    def held_out(self, features: Column) -> Column:
        """Whether a row is held out, by a hash of its features."""
        return F.pmod(F.xxhash64(F.lit(self.getOrDefault("seed")), features), F.lit(10_000)) < int(10_000 * self.getOrDefault("heldOut"))


class HorseshoeSelector(Estimator, _HorseshoeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the posterior on rows with features (a vector or an array) and a label of 0 or 1.

    Features are standardised by their mean and deviation (a constant one is left at 0). Rows with a null label or null
    features are left out. The parameters of the epoch with the least held-out loss are kept; without held-out rows the last.
    """

    @keyword_only
    def __init__(self, **params):
        super().__init__()
        self.setParams(**params)

    @keyword_only
    def setParams(self, **params):
        return self._set(**params)

    def _fit(self, dataset: DataFrame) -> HorseshoeModel:
        get, label = self.getOrDefault, F.col(self.getLabelCol())
        rows = dataset.select(_array(dataset, self.getFeaturesCol()).alias("x"), label.cast("double").alias("y")).where("x is not null and y is not null")
        if rows.isEmpty():
            raise ValueError("no rows to fit on")
        stats = rows.select(Summarizer.metrics("mean", "std").summary(array_to_vector("x")).alias("s")).select("s.*").first()
        mean, scale, d = stats["mean"].toArray(), stats["std"].toArray(), len(stats["mean"])
        scale = np.where(scale > 0, scale, 1.0)
        slices = get("slices")
        where = F.when(self.held_out(F.col("x")), HELD).otherwise(F.pmod(F.xxhash64("x", F.lit(get("seed") + 1)), F.lit(slices))).cast("int")
        blocks = rows.withColumn("slice", where).mapInArrow(_pack(d, mean, scale), "slice int, x binary, y binary").persist()
        try:
            each = blocks.agg(F.coalesce(F.sum(F.when(F.col("slice") != HELD, F.octet_length("y") / 4)), F.lit(0.0)).alias("n"), F.sum(F.octet_length("x").cast("long")).alias("bytes")).first()
            settings = {k: get(k) for k in ("seed", "rank", "slices", "maxEpochs", "drawsPerStep", "patience", "clipNorm", "stepSize")}
            p, least = _in_one_task(blocks, each.n, d, settings) if each.bytes <= SMALL else climb(_spread(blocks), each.n, d, settings)
        finally:
            blocks.unpersist()
        out = HorseshoeModel()
        out._set(loc=p["loc"].tolist(), logScales=p["s"].tolist(), factors=p["v"].ravel().tolist(), means=mean.tolist(), deviations=scale.tolist(), loss=float(least) if np.isfinite(least) else -1.0)
        return self._copyValues(out)


class HorseshoeModel(Model, _HorseshoeParams, DefaultParamsReadable, DefaultParamsWritable):
    """The posterior. transform adds probability (of label 1, at its mean) and prediction; saved and loaded as other ML models."""

    loc = Param(Params._dummy(), "loc", "means of z, log lambda, log c, log tau, intercept", TypeConverters.toListFloat)
    logScales = Param(Params._dummy(), "logScales", "logarithms of the diagonal deviations", TypeConverters.toListFloat)
    factors = Param(Params._dummy(), "factors", "the matrix of low rank, by rows", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "feature means", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "feature deviations", TypeConverters.toListFloat)
    loss = Param(Params._dummy(), "loss", "held-out loss of a row, -1 without such rows", TypeConverters.toFloat)

    def _posterior(self) -> LowRankNormal:
        loc = np.array(self.getOrDefault("loc"))
        return LowRankNormal(loc, np.array(self.getOrDefault("logScales")), np.array(self.getOrDefault("factors")).reshape(len(loc), -1))

    def _scores(self, df: DataFrame, w: np.ndarray, b: np.ndarray, tell, schema: str, *keep: str) -> DataFrame:
        mean, scale = np.array(self.getOrDefault("means")), np.array(self.getOrDefault("deviations"))

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = (_matrix(batch.column("_x"), len(mean)) - mean) / scale
                yield pa.record_batch([*(batch.column(c) for c in keep), *map(pa.array, tell(x @ w.T + b, batch))], [*keep, *(f.split()[0] for f in schema.split(", "))])

        kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
        return df.withColumn("_x", _array(df, self.getFeaturesCol())).where("_x is not null").select(*keep, "_x").mapInArrow(go, f"{kinds}, {schema}")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Rows with null features get null."""
        mean, scale = (F.array(*map(F.lit, self.getOrDefault(c))) for c in ("means", "deviations"))
        loc = np.array(self.getOrDefault("loc"))[None]
        w = F.array(*map(F.lit, weights(loc)[0].tolist()))
        x = _array(dataset, self.getFeaturesCol())
        terms = F.zip_with(F.zip_with(F.zip_with(x, mean, lambda a, m: a - m), scale, lambda a, s: a / s), w, lambda a, v: a * v)
        z = F.aggregate(terms, F.lit(float(loc[0, -1])), lambda a, t: a + t)
        p = 1 / (1 + F.exp(-z))
        return dataset.withColumn(self.getProbabilityCol(), p).withColumn(self.getPredictionCol(), (F.col(self.getProbabilityCol()) >= 0.5).cast("double"))

    def draws(self, spark, names: list[str], n: int = 3000) -> DataFrame:
        """Posterior draws of the weights of standardised features: draw, feature_name, beta. They are made where they are used."""
        q, seed = self._posterior(), self.getOrDefault("seed")

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column("id").to_pylist():
                    w = weights(q.draw(np.random.Generator(np.random.PCG64([seed, k])), 1)[0])[0]
                    yield pa.record_batch([pa.array(np.full(len(w), k, np.int64)), pa.array(names), pa.array(w)], ["draw", "feature_name", "beta"])

        return spark.range(n).mapInArrow(make, "draw bigint, feature_name string, beta double")

    def validation_table(self, df: DataFrame, key: str = "sample_id", n: int = 200) -> DataFrame:
        """How n posterior draws predict the held-out rows of df, one row each: key, label, accuracy, accuracy_std, avg_prediction, prediction_std, draw_count.

        Deviations are population ones; accuracy_std is that of a mean of so many draws. A row with a null label has a null accuracy.
        """
        label = self.getLabelCol()
        theta = self._posterior().draw(np.random.Generator(np.random.PCG64([self.getOrDefault("seed"), n])), n)[0]

        def tell(z: np.ndarray, batch: pa.RecordBatch) -> list[np.ndarray]:
            hit = (z >= 0).astype(float)
            y = batch.column(label).to_numpy(zero_copy_only=False).astype(float)
            right = np.where(np.isnan(y), np.nan, (hit == y[:, None]).mean(1))
            return [right, np.sqrt(right * (1 - right) / n), hit.mean(1), hit.std(1), np.full(len(y), n, np.int64)]

        held = df.where(self.held_out(_array(df, self.getFeaturesCol())))
        got = self._scores(held, weights(theta), theta[:, -1], tell, "accuracy double, accuracy_std double, avg_prediction double, prediction_std double, draw_count bigint", key, label)
        known = lambda c: F.nanvl(c, F.lit(None).cast("double")).alias(c)
        return got.select(key, label, known("accuracy"), known("accuracy_std"), "avg_prediction", "prediction_std", "draw_count")


def bayesian_selector(tasks: DataFrame, features: list[str], label: str = "label", by: str = "iteration", draws: int = 200, parallel: int = 4, **params) -> DataFrame:
    """Posterior draws (iteration, draw, feature_name, beta) of wide rows, a fit for each iteration, so many at a time.

    Rows with a null feature teach nothing. params are those of HorseshoeSelector.
    """
    spark, kind = tasks.sparkSession, dict(tasks.dtypes)[by]
    full = F.expr(" and ".join(f"`{f}` is not null" for f in features))
    whole = kept(tasks.where(F.col(by).isNotNull()).select(by, label, F.when(full, F.array(*[F.col(f).cast("double") for f in features])).alias("features")))
    keys = sorted(r[0] for r in whole.select(by).distinct().collect())
    whole = whole.where("features is not null")
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        models = list(pool.map(lambda k: HorseshoeSelector(labelCol=label, **params).fit(whole.where(F.col(by) == k)), keys))
    out = None
    for k, model in zip(keys, models, strict=True):
        one = model.draws(spark, features, draws).select(F.lit(k).cast(kind).alias(by), F.col("draw").cast("int").alias("draw"), "feature_name", "beta")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], f"{by} {kind}, draw int, feature_name string, beta double")

"""Linear probes, sweeps, negative controls and bootstrap intervals."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.operators import curation, metrics

# Fixed values.
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
CS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
MLP_CONFIGS = tuple({"hidden": h, "decay": a} for h in (256, 512, 1024) for a in (1e-4, 1e-3, 1e-2))
SLOTS = 16
#: Draws of one replicate and stratum that a task makes at once.
DRAWS = 65_536
#: Draws that a worker sorts into lists at once; places of a block, and cells of its matrix of draws, at most.
GATHERED, PLACES, CELLS = 1 << 19, 1024, 1 << 21
#: Sums that R2 is made of, by dimension: rows, values, their squares, rows whose difference is known, its squares.
MOMENTS = ("n", "s", "ss", "known", "sse")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            z = np.concatenate((np.ones((batch.num_rows, 1)), _matrix(batch.column(0)), _matrix(batch.column(1))), axis=1)
            total = z.T @ z if total is None else total + z.T @ z
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(total.tobytes()) % SLOTS], pa.int32()), pa.array([len(total)], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "d", "m"])


def _summed(table: pa.Table) -> pa.Table:
    d = table.column("d")[0].as_py()
    total = sum(np.frombuffer(m, np.float64) for m in table.column("m").to_pylist())
    return pa.table({"slot": table.column("slot").slice(0, 1), "d": pa.array([d], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})


class Gram:
    """Moments of (1, x, y) over all rows: enough for every ridge penalty. Its size is that of the features alone."""

    def __init__(self, moments: np.ndarray, d_x: int):
        self.m, self.d = moments, d_x

    def ridge(self, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """(W, b) of least squares with intercept and penalty alpha on W."""
        n, k = self.m[0, 0], self.d + 1
        mx, my = self.m[0, 1:k] / n, self.m[0, k:] / n
        xx = self.m[1:k, 1:k] - n * np.outer(mx, mx)
        xy = self.m[1:k, k:] - n * np.outer(mx, my)
        w = np.linalg.solve(xx + alpha * np.eye(self.d), xy)
        return w, my - mx @ w


def gram(df: DataFrame, x: str = "x", y: str = "y") -> Gram:
    """One pass: partial moments of each task, summed in SLOTS groups, then on the driver."""
    d = df.select(F.size(x).alias("d")).first()["d"]
    parts = df.select(x, y).mapInArrow(_grams, "slot int, d int, m binary").groupBy("slot").applyInArrow(_summed, "slot int, d int, m binary").collect()
    size = parts[0].d
    return Gram(sum(np.frombuffer(p.m, np.float64) for p in parts).reshape(size, size), d)


def _applied(model, x: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            p = _matrix(batch.column(batch.schema.get_field_index(x))) @ w + b if batch.num_rows else np.zeros((0, len(b)))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), max(1, p.shape[1])).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "p"])

    return run


def predict_linear(df: DataFrame, w: np.ndarray, b: np.ndarray, x: str = "x") -> DataFrame:
    """df with `p` = x W + b, batches at a time."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(_applied(df.sparkSession.sparkContext.broadcast((w, b)), x), f"{kinds}, p array<double>")


def row_cosines(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    from seqlattice.functions import vector

    return df.withColumn("cosine", vector.cosine(F.col(y), F.col(p)))


def ridge_sweep(train: DataFrame, val: DataFrame, alphas: Sequence[float] = ALPHAS) -> list[tuple[float, float]]:
    """(alpha, mean cosine on val) for each penalty; the moments are computed once."""
    g = gram(train)
    return [(a, row_cosines(predict_linear(val, *g.ridge(a))).agg(F.avg("cosine")).first()[0]) for a in alphas]


def best_of(sweep: Sequence[tuple[float, float]]) -> float:
    """Parameter of the greatest score, the first of equals."""
    return max(sweep, key=lambda s: s[1])[0]


def ridge_protocol(df: DataFrame, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """Sweep on val, refit on train and val, test once: (alpha, mean_cosine, median_cosine, r2_macro) of df (x, y, split)."""
    alpha = best_of(ridge_sweep(df.where("split = 'train'"), df.where("split = 'val'"), alphas))
    tested = row_cosines(predict_linear(df.where("split = 'test'"), *gram(df.where("split in ('train', 'val')")).ridge(alpha)))
    r2 = metrics.r2_by_dimension(tested, "y", "p").agg(F.avg("r2").alias("r2_macro"))
    return tested.agg(F.avg("cosine").alias("mean_cosine"), F.median("cosine").alias("median_cosine")).crossJoin(r2).withColumn("alpha", F.lit(float(alpha)))


def logistic(train: DataFrame, c: float, x: str = "x", label: str = "label"):
    """L2 logistic regression: C times the summed loss plus half the squared weights."""
    n = train.count()
    fit = LogisticRegression(featuresCol="_v", labelCol=label, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-9)
    return fit.fit(train.withColumn("_v", array_to_vector(F.transform(x, lambda v: v.cast("double")))))


def predict_logistic(model, df: DataFrame, x: str = "x") -> DataFrame:
    """df with `pred` and `proba`."""
    out = model.transform(df.withColumn("_v", array_to_vector(F.transform(x, lambda v: v.cast("double")))))
    return out.withColumn("proba", vector_to_array("probability")).withColumn("pred", F.col("prediction").cast("int")).drop("_v", "rawPrediction", "probability", "prediction")


def logistic_sweep(train: DataFrame, val: DataFrame, cs: Sequence[float] = CS) -> list[tuple[float, float]]:
    train = train.cache()
    out = [(c, metrics.summary(predict_logistic(logistic(train, c), val), "label", "pred").first()["macro_f1"]) for c in cs]
    train.unpersist()
    return out


def logistic_protocol(df: DataFrame, cs: Sequence[float] = CS) -> DataFrame:
    """Sweep on val by macro-F1, refit on train and val, test once: (C, n, accuracy, balanced_accuracy, macro_f1, kappa)."""
    c = best_of(logistic_sweep(df.where("split = 'train'"), df.where("split = 'val'"), cs))
    tested = predict_logistic(logistic(df.where("split in ('train', 'val')"), c), df.where("split = 'test'"))
    return metrics.summary(tested, "label", "pred").withColumn("C", F.lit(float(c)))


def _drawn(df: DataFrame, key: str, stratum: str | None, replicates: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Draws (rep, _s, _n), a row each, and the rows they take, (_s, _n, key)."""
    s = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")
    places = curation.in_order(df.select(key, s.alias("_s")), key, "_s").select("_s", (F.col("_p") - 1).alias("_n"), key)
    sizes = df.select(s.alias("_s")).groupBy("_s").agg(F.count("*").alias("_size"))
    reps = df.sparkSession.range(replicates).select(F.col("id").alias("rep"))
    # draws of a replicate and stratum come in blocks, dealt to all tasks; without a number these few rows would meet in one
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = sizes.crossJoin(F.broadcast(reps)).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_size - 1) div {DRAWS}"))))
    draws = draws.repartition(tasks, "rep", "_s", "_block").withColumn("_j", F.explode(F.sequence(F.col("_block") * DRAWS, F.least(F.col("_size"), (F.col("_block") + 1) * DRAWS) - 1)))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), "_s", F.col("_j").cast("string")))
    return draws.select("rep", "_s", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("_size")).alias("_n")), places


def stratified_draws(df: DataFrame, key: str, stratum: str | None, replicates: int, seed: int = 42) -> DataFrame:
    """(rep, key, w): how often a row is drawn in each replicate, with replacement, strata keeping their sizes.

    Draw j of a stratum of n rows takes the row whose place is a digest of (seed, rep, stratum, j), modulo n.
    """
    draws, places = _drawn(df, key, stratum, replicates, seed)
    weights = draws.groupBy("rep", "_s", "_n").agg(F.count("*").alias("w"))
    # Spark takes the draws for as few as the replicates and would broadcast them
    return weights.join(places.hint("merge"), ["_s", "_n"]).select("rep", key, "w")


def _bucketed(rows: int):
    """Draws (rep, _n) to (block, rep, at): many of a replicate, by their blocks of `rows` places, in one list."""

    def lists(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rep, n = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in (0, 1))
        span = n.max() // rows + 1
        of = rep * span + n // rows
        order = np.argsort(of, kind="stable")
        of = of[order]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        at = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)), pa.int32()), pa.array((n[order] % rows).astype(np.int16)))
        return pa.RecordBatch.from_arrays([pa.array(of[first] % span), pa.array(of[first] // span), at], names=["block", "rep", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts, held = [*parts, batch], held + batch.num_rows
            if held >= GATHERED:
                yield lists(parts)
                parts, held = [], 0
        if parts:
            yield lists(parts)

    return run


def _weighted(replicates: int, rows: int):
    """Of a block's draws and rows (n, x), x holding MOMENTS values a dimension: their weighted sums by replicate and dimension."""

    def flat(table: pa.Table, lists: str, by: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        column = table.column(lists).combine_chunks()
        size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return np.repeat(table.column(by).to_numpy().astype(np.int64), size), column.flatten().to_numpy(zero_copy_only=False), size

    def run(draws: pa.Table, places: pa.Table) -> pa.Table:
        rep, at, _ = flat(draws, "at", "rep")
        w = np.bincount(rep * rows + at, minlength=replicates * rows).reshape(replicates, rows).astype(np.float64)
        n, values, size = flat(places, "x", "n")
        x = np.zeros((rows, size.max(initial=0)))
        np.add.at(x, (n, np.arange(len(n)) - np.repeat(np.cumsum(size) - size, size)), values)
        odd = np.flatnonzero(~np.isfinite(x).all(axis=1))
        plain = x.copy()
        plain[odd] = 0
        total = w @ plain
        for i in odd:  # 0 times NaN is NaN: only for the replicates that drew it
            drew = w[:, i] > 0
            total[drew] += w[drew, i, None] * x[i]
        total = total.reshape(replicates, x.shape[1] // len(MOMENTS), len(MOMENTS))
        rep, dim = np.nonzero(total[:, :, 0] > 0)
        return pa.table({"rep": pa.array(rep, pa.int64()), "dim": pa.array(dim, pa.int32())} | {m: pa.array(total[rep, dim, k]) for k, m in enumerate(MOMENTS)})

    return run


def bootstrap_classification(df: DataFrame, key: str, true: str, pred: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(metric, point, lo, hi) of macro_f1 and kappa; replicates are a column, all of them one aggregate."""
    drawn = stratified_draws(df, key, true, replicates, seed).join(df.select(key, true, pred), key)
    scores = metrics.summary(drawn, true, pred, ["rep"], weight="w")
    point = metrics.summary(df, true, pred)
    names = ("macro_f1", "kappa")
    long = lambda d, n: d.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(n)) for m in names])).alias("e")).select("e.*")
    return long(point, "point").join(metrics.interval(long(scores, "v"), "v", ["metric"]), "metric")


def bootstrap_regression(df: DataFrame, key: str, y: str, p: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(metric, point, lo, hi) of the macro R2 of vector columns.

    Draws meet the rows in blocks of places, where a product of matrices gives the sums of all replicates; neither draws
    nor their dimensions become rows of a join.
    """
    rows = max(1, min(PLACES, CELLS // max(1, replicates)))
    draws, places = _drawn(df, key, None, replicates, seed)
    t, e = (lambda z: z.y.cast("double")), (lambda z: z.y.cast("double") - z.p.cast("double"))
    known = lambda c: F.coalesce(c, F.lit(0.0))
    moments = lambda z: F.array(F.lit(1.0), known(t(z)), known(t(z) * t(z)), e(z).isNotNull().cast("double"), known(e(z) * e(z)))
    vectors = df.select(key, F.flatten(F.transform(F.arrays_zip(F.col(y).alias("y"), F.col(p).alias("p")), moments)).alias("x")).where("x is not null")
    taken = places.join(vectors, key).select(F.expr(f"_n div {rows}").alias("block"), (F.col("_n") % rows).cast("int").alias("n"), "x")
    lists = draws.select("rep", "_n").mapInArrow(_bucketed(rows), "block long, rep long, at array<smallint>")
    sums = lists.groupBy("block").cogroup(taken.groupBy("block")).applyInArrow(_weighted(replicates, rows), "rep long, dim int, " + ", ".join(f"{m} double" for m in MOMENTS))
    sums = sums.groupBy("rep", "dim").agg(*[F.sum(m).alias(m) for m in MOMENTS]).withColumn("sse", F.when(F.col("known") > 0, F.col("sse")))
    scores = metrics.r2_of_sums(sums, ["rep"]).groupBy("rep").agg(F.avg("r2").alias("v"))
    point = metrics.r2_by_dimension(df, y, p).agg(F.lit("r2_macro").alias("metric"), F.avg("r2").alias("point"))
    return point.crossJoin(metrics.interval(scores, "v"))


class Mlp:
    """One hidden layer of rectified units, trained by Adam on a bounded sample, stopped early on val. A diagnostic."""

    def __init__(self, hidden: int = 64, rate: float = 1e-3, decay: float = 1e-4, epochs: int = 200, patience: int = 10, seed: int = 42):
        self.hidden, self.rate, self.decay, self.epochs, self.patience, self.seed = hidden, rate, decay, epochs, patience, seed

    def fit(self, x: np.ndarray, y: np.ndarray, vx: np.ndarray, vy: np.ndarray) -> Mlp:
        r = np.random.default_rng(self.seed)
        p = [r.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], self.hidden)), np.zeros(self.hidden), r.normal(0, np.sqrt(1 / self.hidden), (self.hidden, y.shape[1])), y.mean(axis=0)]
        m, v, t = [0.0 * q for q in p], [0.0 * q for q in p], 0
        best, self.p, wait = np.inf, [q.copy() for q in p], 0
        for _ in range(self.epochs):
            for rows in np.array_split(r.permutation(len(x)), max(1, len(x) // 64)):
                h = np.maximum(x[rows] @ p[0] + p[1], 0)
                e = 2 * (h @ p[2] + p[3] - y[rows]) / max(1, len(rows))
                back = (e @ p[2].T) * (h > 0)
                grads = [x[rows].T @ back + self.decay * p[0], back.sum(axis=0), h.T @ e + self.decay * p[2], e.sum(axis=0)]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= self.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            loss = ((np.maximum(vx @ p[0] + p[1], 0) @ p[2] + p[3] - vy) ** 2).mean()
            if loss < best - 1e-9:
                best, self.p, wait = loss, [q.copy() for q in p], 0
            else:
                wait += 1
                if wait >= self.patience:
                    break
        self.loss = float(best)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]


def _squares(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                split, x, y = batch.column(0).to_pylist(), _matrix(batch.column(1)), _matrix(batch.column(2))
                for k, m in enumerate(models.value):
                    errors = ((m.predict(x) - y) ** 2).mean(axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k] * len(split), pa.int32()), pa.array(errors)], names=["split", "k", "e"])

    return run


def mlp_protocol(df: DataFrame, configs: Sequence[dict], rows: int = 20_000) -> DataFrame:
    """(hidden, rate, decay, val_loss, test_mse) of each configuration of df (x, y, split, id).

    It is fitted on `rows` train rows at most and stopped by as many val rows; both losses are those of all val and test rows.
    """
    part = {}
    for s in ("train", "val"):
        some = df.where(F.col("split") == s).orderBy(F.md5(F.col("id").cast("string"))).limit(rows).select("x", "y").collect()
        part[s] = [np.array([r[c] for r in some], np.float64) for c in ("x", "y")]
    models = [Mlp(**c).fit(*part["train"], *part["val"]) for c in configs]
    held = df.where("split in ('val', 'test')").select("split", "x", "y")
    losses = held.mapInArrow(_squares(df.sparkSession.sparkContext.broadcast(models)), "split string, k int, e double").groupBy("split", "k").agg(F.avg("e").alias("e"))
    loss = {(r.split, r.k): r.e for r in losses.collect()}
    out = [(m.hidden, m.rate, m.decay, loss.get(("val", k)), loss.get(("test", k))) for k, m in enumerate(models)]
    return df.sparkSession.createDataFrame(out, "hidden int, rate double, decay double, val_loss double, test_mse double")


def encode(df: DataFrame, id_col: str, seq_col: str, encoder: Callable[[list[str]], np.ndarray], width: int) -> DataFrame:
    """(id, x) by a plugged-in encoder: called with batches of sequences in each worker, returns a matrix of `width` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.asarray(encoder(batch.column(1).to_pylist()), np.float64).reshape(batch.num_rows, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), width).cast(pa.list_(pa.float64()))], names=["id", "x"])

    return df.select(id_col, F.col(seq_col).cast("string")).mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, x array<double>").withColumnRenamed("id", id_col)


def project_2d(df: DataFrame, x: str = "x") -> DataFrame:
    """df with `xy`, two principal components: a linear stand-in for a neighbourhood embedding."""
    v = df.withColumn("_v", array_to_vector(F.transform(x, lambda e: e.cast("double"))))
    return PCA(k=2, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("xy", vector_to_array("_p")).drop("_v", "_p")

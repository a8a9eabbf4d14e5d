"""Classification and regression metrics as aggregates; every function also works within groups (`by`)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12


def confusion(df: DataFrame, true: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., true, pred, n) over the classes seen in `true`, zeros included; predictions of other classes are not shown."""
    counts = df.groupBy(*by, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    classes = counts.select(*by, "true").distinct()
    other = classes.withColumnRenamed("true", "pred")
    grid = classes.join(other, list(by)) if by else classes.crossJoin(other)
    return grid.join(counts, [*by, "true", "pred"], "left").na.fill(0, ["n"])


def class_scores(df: DataFrame, true: str, pred: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by.., class, support, predicted, hits, recall, f1) for the classes in true or pred.

    Each row counts once for its true and once for its predicted class, so one aggregate gives all marginals.
    """
    w = F.col(weight) if weight else F.lit(1)
    hit = F.col(true) == F.col(pred)
    row = lambda c, s, p, h: F.struct(c.cast("string").alias("class"), F.lit(s).alias("s"), F.lit(p).alias("p"), h.cast("int").alias("h"))
    sides = F.array(row(F.col(true), 1, 0, F.lit(0)), row(F.col(pred), 0, 1, hit))
    rows = df.select(*by, w.cast("long").alias("w"), F.explode(sides).alias("e")).select(*by, "w", "e.*")
    sums = rows.groupBy(*by, "class").agg(F.sum(F.col("s") * F.col("w")).alias("support"), F.sum(F.col("p") * F.col("w")).alias("predicted"), F.sum(F.col("h") * F.col("w")).alias("hits"))
    both = F.col("support") + F.col("predicted")
    return sums.withColumn("recall", F.col("hits") / F.nullif(F.col("support"), F.lit(0))).withColumn("f1", F.coalesce(2 * F.col("hits") / F.nullif(both, F.lit(0)), F.lit(0.0)))


def summary(df: DataFrame, true: str, pred: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by.., n, accuracy, balanced_accuracy, macro_f1, kappa); kappa is null where it is not defined."""
    s = class_scores(df, true, pred, by, weight)
    n, hits = F.sum("support"), F.sum("hits")
    chance = F.sum((F.col("support") * F.col("predicted")).cast("double"))
    agg = s.groupBy(*by).agg(n.alias("n"), hits.alias("_h"), chance.alias("_c"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))
    po = F.col("_h") / F.nullif(F.col("n"), F.lit(0))
    pe = F.col("_c") / F.nullif(F.col("n").cast("double") * F.col("n"), F.lit(0.0))
    kappa = (po - pe) / F.nullif(1 - pe, F.lit(0.0))
    return agg.select(*by, "n", po.alias("accuracy"), "balanced_accuracy", "macro_f1", kappa.alias("kappa"))


def kappa_of_confusion(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Kappa from a long confusion table (by.., true, pred, n)."""
    return summary(table, "true", "pred", by, weight="n").select(*by, "kappa")


def row_normalised(table: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("true"))
    return table.withColumn("share", F.col("n") / F.greatest(total, F.lit(1)))


def r2_by_dimension(df: DataFrame, y: str, p: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by.., dim, r2) of two vector columns; the denominator is 1e-12 at least."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    dims = df.select(*by, w.alias("w"), F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col(p).alias("p"))).alias("dim", "e"))
    t, e = F.col("e.y").cast("double"), F.col("e.y").cast("double") - F.col("e.p").cast("double")
    s = dims.groupBy(*by, "dim").agg(F.sum("w").alias("n"), F.sum(F.col("w") * t).alias("s"), F.sum(F.col("w") * t * t).alias("ss"), F.sum(F.col("w") * e * e).alias("sse"))
    return r2_of_sums(s, by)


def r2_of_sums(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by.., dim, r2) of sums (by.., dim, n, s, ss, sse): rows, values, their squares and the squared differences."""
    sst = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return sums.select(*by, "dim", (1 - F.col("sse") / F.greatest(sst, F.lit(TINY))).alias("r2"))


def r2_distribution(r2: DataFrame) -> DataFrame:
    """One row: mean, median, count above 0 and 0.5, max, p10, p90, and the dimensions that make up half of the sum (-1 if it is not positive)."""
    order = Window.orderBy(F.desc("r2"), "dim")  # one row for each output dimension
    ranked = r2.withColumn("k", F.row_number().over(order)).withColumn("c", F.sum("r2").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    total = r2.agg(F.sum("r2").alias("total"))
    half = ranked.crossJoin(total).agg(F.coalesce(F.min(F.when((F.col("total") > 0) & (F.col("c") >= 0.5 * F.col("total")), F.col("k"))), F.lit(-1)).cast("long").alias("dims_half"))
    stats = r2.agg(
        F.count("*").alias("dims"), F.avg("r2").alias("mean"), F.median("r2").alias("median"), F.count_if(F.col("r2") > 0).alias("above_0"), F.count_if(F.col("r2") > 0.5).alias("above_05"),
        F.max("r2").alias("max"), F.percentile("r2", F.lit(0.1)).alias("p10"), F.percentile("r2", F.lit(0.9)).alias("p90"),
    )
    return stats.crossJoin(half)


def interval(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., lo, hi): 2.5 and 97.5 percentiles, interpolated."""
    return df.groupBy(*by).agg(F.percentile(value, F.lit(0.025)).alias("lo"), F.percentile(value, F.lit(0.975)).alias("hi"))


def gate(delta: Column, margin: float = 0.02) -> Column:
    return F.when(delta >= margin, "win").when(delta <= -margin, "loss").when(delta.isNotNull(), "tie")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins, the last closed; values outside are not counted, empty bins are."""
    step = (high - low) / bins
    inside = df.where((F.col(value) >= low) & (F.col(value) <= high)).select(F.least(F.floor((F.col(value) - low) / step), F.lit(bins - 1)).cast("long").alias("bin"))
    grid = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return grid.join(inside.groupBy("bin").agg(F.count("*").alias("n")), "bin", "left").na.fill(0, ["n"])


def length_summary(df: DataFrame, text: str) -> DataFrame:
    n = F.length(text)
    return df.agg(F.count(text).alias("n"), F.floor(F.median(n)).cast("long").alias("median"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"))

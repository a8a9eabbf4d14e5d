"""Column functions on vectors, and pooling of chunk vectors. Stored as float, computed in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(TINY)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(TINY))


def argmax(values: Column, classes: Column) -> Column:
    """Class of the first greatest value."""
    return F.element_at(classes, F.array_position(values, F.array_max(values)).cast("int"))


# Multiple of the hidden size that a pooling has.
WIDTH = {"base": 1, "meanmean": 1, "specialmean": 1, "maxmean": 1, "clsmean": 1, "meanD": 3, "meanG": 4}


def pooled_width(pooling: str, hidden: int) -> int:
    if pooling not in WIDTH:
        raise ValueError(f"unknown pooling: {pooling!r}")
    return WIDTH[pooling] * hidden


def available_poolings(has: Column) -> Column:
    """Poolings that the reductions at hand (an array of names) allow, in order."""
    needs = (("meanmean", "mean"), ("specialmean", "special_mean"), ("maxmean", "max"), ("clsmean", "cls"), ("meanD", "mean"), ("meanG", "mean"))
    return F.array_compact(F.array(*[F.when(F.array_contains(has, need), F.lit(name)) for name, need in needs]))


def token_reductions(tokens: DataFrame, key: list[str], special: str = "special") -> DataFrame:
    """Per chunk: mean and max over content vectors, mean over all, and the first vector, from (key.., pos, vec, special).

    A chunk without special tokens has no cls. Element-wise over positions of the vector, with map-side partial sums.
    """
    parts = tokens.select(*key, "pos", F.col(special).alias("_s"), F.posexplode("vec").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    by_dim = parts.groupBy(*key, "i").agg(
        F.avg(F.when(~F.col("_s"), F.col("v"))).alias("mean"), F.max(F.when(~F.col("_s"), F.col("v"))).alias("max"), F.avg("v").alias("special_mean"),
        F.max(F.when((F.col("pos") == 0) & F.col("_s"), F.col("v"))).alias("cls"),
    )
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda x: x[c]).alias(c)
    out = by_dim.groupBy(*key).agg(*[ordered(c) for c in ("mean", "special_mean", "max", "cls")])
    return out.withColumn("cls", F.when(~F.exists("cls", lambda x: x.isNull()), F.col("cls")))


def pooled(chunks: DataFrame, id_col: str, vec_col: str = "vec", chunk_col: str = "chunk_no") -> DataFrame:
    """(id, mean_vec, first_vec, last_vec, max_vec): one pass from which all poolings of a reduction follow."""
    v = F.col(vec_col)
    ends = chunks.groupBy(id_col).agg(F.min(F.struct(chunk_col, vec_col))[vec_col].alias("first_vec"), F.max(F.struct(chunk_col, vec_col))[vec_col].alias("last_vec"))
    dims = chunks.select(id_col, F.posexplode(v).alias("i", "v")).groupBy(id_col, "i").agg(F.avg(F.col("v").cast("double")).alias("a"), F.max(F.col("v").cast("double")).alias("m"))
    rows = dims.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("i", "a", "m"))).alias("d"))
    both = rows.join(ends, id_col)
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    return both.select(
        id_col, F.transform("d", lambda x: x["a"]).alias("mean_vec"), double("first_vec").alias("first_vec"), double("last_vec").alias("last_vec"), F.transform("d", lambda x: x["m"]).alias("max_vec")
    )


# The reduction of a chunk that a pooling averages over the chunks.
REDUCTION = {"meanmean": "mean", "specialmean": "special_mean", "maxmean": "max", "clsmean": "cls"}


def mean_of_chunks(chunks: DataFrame, id_col: str, pooling: str) -> DataFrame:
    """(id, x): mean over an id's chunks of the reduction that the pooling needs.

    Without a column for the reduction that is an error at once; a chunk in which it is null fails the run.
    """
    if pooling not in REDUCTION:
        raise ValueError(f"unknown pooling: {pooling!r}")
    name = REDUCTION[pooling]
    if name not in chunks.columns:
        raise ValueError(f"{pooling} needs {name}")
    absent = F.raise_error(F.concat(F.lit(f"{pooling} needs {name}, absent in a chunk of "), F.col(id_col).cast("string"))).cast(dict(chunks.dtypes)[name])
    parts = chunks.select(id_col, F.when(F.col(name).isNull(), absent).otherwise(F.col(name)).alias("v")).select(id_col, F.posexplode("v").alias("i", "v"))
    dims = parts.groupBy(id_col, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return dims.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("x"))


def mean_d(p: DataFrame) -> Column:
    return F.concat(p["first_vec"], p["last_vec"], p["mean_vec"])


def mean_g(p: DataFrame) -> Column:
    return F.concat(p["first_vec"], p["last_vec"], p["mean_vec"], p["max_vec"])


def variant_dataset(features: DataFrame, pooled_vectors: DataFrame, id_col: str, pooling: str, hidden: int) -> DataFrame:
    """features with x replaced by a pooled vector (id, x); running it fails on a missing id or a wrong width."""
    width = pooled_width(pooling, hidden)
    joined = features.drop("x").join(pooled_vectors.select(id_col, "x"), id_col, "left")
    problem = F.when(F.col("x").isNull(), F.concat(F.lit("missing "), F.col(id_col).cast("string"))).when(F.size("x") != width, F.lit("wrong width"))
    return joined.withColumn("x", F.when(problem.isNotNull(), F.raise_error(problem).cast("array<double>")).otherwise(F.col("x")))


def flat_mean(tokens: DataFrame, id_col: str, chunk_col: str = "chunk_no", vec_col: str = "vec") -> DataFrame:
    """(id, x): mean over chunks of the mean over each chunk's tokens."""
    parts = tokens.select(id_col, chunk_col, F.posexplode(vec_col).alias("i", "v"))
    chunk = parts.groupBy(id_col, chunk_col, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    dims = chunk.groupBy(id_col, "i").agg(F.avg("v").alias("v"))
    return dims.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("x"))


def bin_means(bins: DataFrame, id_col: str, centre: int, bin_col: str = "bin", vec_col: str = "vec") -> DataFrame:
    """(id, global_vec, centre_vec): mean over all bins, and over the `centre` bins around the middle."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(id_col))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(bin_col)) - 1
    first = F.greatest(F.floor((n - centre) / 2), F.lit(0))
    inner = bins.withColumn("_in", (place >= first) & (place < first + centre))
    dims = inner.select(id_col, "_in", F.posexplode(vec_col).alias("i", "v")).groupBy(id_col, "i").agg(
        F.avg(F.col("v").cast("double")).alias("g"), F.avg(F.when(F.col("_in"), F.col("v").cast("double"))).alias("c")
    )
    rows = dims.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("i", "g", "c"))).alias("d"))
    return rows.select(id_col, F.transform("d", lambda x: x["g"]).alias("global_vec"), F.transform("d", lambda x: x["c"]).alias("centre_vec"))

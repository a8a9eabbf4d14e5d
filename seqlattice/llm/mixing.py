"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. Documents of a source stand
in a fixed order (by size class, then by a hash of the id), their expected copies are summed up along it, one offset
per source is added, and a document is emitted once per integer boundary that its stretch crosses. Sums are kept in
whole units of 2^-24 copies, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.llm.common import cut, prepare

#: Parts of one copy.
UNIT = 1 << 24
#: Groups that the documents of one source and size class are dealt to, so that no task sorts a whole source. A source
#: has about 130 size classes at most, so the window over its groups holds 130 * SALTS rows at most.
SALTS = 1024


def words_in(text: Column) -> Column:
    """Number of stretches without ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn. The targets share the sum of all sizes by weight; one
    over `cap` times its source's size stops there and the excess is shared among the others by weight, again and
    again. That is filling to a common level: with sources ordered by cap / weight, the first k are full where the
    level that the rest would share lies above their own. One row per source only: no document is in these windows.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_k") - 1, len(weights)) + 1).cast("int"))
    rows = sizes.withColumn("_k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("_w", turn)
    by_level = Window.orderBy(cap * F.col("source_size") / F.col("_w"), "_k")
    whole = Window.partitionBy()
    full = F.coalesce(F.sum("source_size").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * cap
    rest = F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (F.sum("source_size").over(whole) - full) / rest)
    open_ = F.when(F.col("_level") * F.col("_w") <= cap * F.col("source_size"), F.col("_level"))
    rows = rows.withColumn("_level", F.max(open_).over(whole))  # the first such level: later ones are lower
    target = F.least(F.coalesce(F.col("_level") * F.col("_w"), cap * F.col("source_size")), cap * F.col("source_size"))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, key: Column) -> DataFrame:
    text, own = F.col(text_col), F.col(id_col)
    return docs.select(own.alias("_id"), F.col(source_col).alias("source"), words_in(text).alias("size"), F.when(own.isNull(), F.xxhash64(text)).alias("_tie"), key.alias("_key"))


def _counted(rows: DataFrame, weights: Sequence[float], cap: float, seed: int, salts: int) -> DataFrame:
    """rows (_id, source, size, _tie, _key) with source_size, target and copies; _tie orders what has no id, _key the rest."""
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.lit("null"))))
    bits = F.bin("size")
    rows = rows.withColumn("_mark", mark).withColumn("_class", F.concat(F.lpad(F.length(bits), 2, "0"), F.substring(bits, 2, 2)))
    # null ids have one mark; their texts spread them
    spread = F.when(F.col("_id").isNull(), F.pmod(F.col("_tie"), F.lit(salts))).otherwise(F.pmod(F.conv(F.substring("_mark", 1, 8), 16, 10).cast("long"), F.lit(salts)))
    rows = rows.withColumn("_salt", spread)
    # places within (source, class, salt), then what stands before each of these groups
    group = ["source", "_class", "_salt"]
    before = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("source").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    before = before.join(targets.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy("size", "_mark", "_id", "_tie", "_key")))
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a._class") == F.col("b._class")) & (F.col("a._salt") == F.col("b._salt"))
    joined = placed.alias("a").join(before.alias("b"), same).select("a.*", "b._before", "b.source_size", "b.target")
    each = F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)) * UNIT).cast("long")
    each = F.coalesce(each, F.lit(0))
    offset = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("offset"), F.coalesce("source", F.lit("null")))), 1, 8), 16, 10).cast("long"), F.lit(UNIT))
    end = F.col("_before") + F.col("_place")
    crossed = lambda n: F.floor((n * each + offset) / UNIT).cast("long")
    return joined.withColumn("copies", crossed(end) - crossed(end - 1))


def mix_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: int = 7, salts: int = SALTS
) -> DataFrame:
    """(id, size, source_size, target, copies, taken) for every row of docs.

    Size is the number of words, 0 for null and empty texts; such documents get copies that take nothing. Null ids
    are ordered as the text "null", then by text. Repeated rows are further documents. Sources without words have
    target 0. Empty input gives an empty result. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = cut(_sized(docs, id_col, text_col, source_col, F.lit("")))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return _counted(rows, weights, cap, seed, salts).select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies", taken)


def row_key(docs: DataFrame) -> Column:
    """128 bits of all columns of a row: rows with one key are equal."""
    own = []
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        # hashes pass over nulls, and do not take maps
        own += [c.isNull(), F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c]
    return F.concat(F.hex(F.xxhash64(*own)), F.lit("|"), F.hex(F.xxhash64(F.lit(1), *own)))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: int = 7, salts: int = SALTS) -> DataFrame:
    """The mixed corpus: each row of docs, with all its columns, as often as its copies.

    Decisions are of rows, not of ids, and are those of mix_counts: null and repeated ids, null and empty texts and
    null sources follow the same rules. Rows equal in every column share their copies. Texts are shuffled once, by
    the row's key, and never sorted or gathered.
    """
    prepare(docs.sparkSession)
    rows = cut(_sized(docs, "doc_id", "text", "source", row_key(docs)))
    taken = _counted(rows, weights, cap, seed, salts).groupBy("_key").agg(F.sum("copies").alias("n"), F.count("*").alias("m"))
    taken = cut(taken.where("n > 0"))
    # copies are known by now; the texts stream past them
    joined = docs.select(row_key(docs).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(taken.hint("shuffle_hash"), "_key")
    once = joined.where("m = 1").select("row", "n")
    # of equal rows one stands for all, chosen on the map side
    equal = joined.where("m > 1").groupBy("_key").agg(F.first("row").alias("row"), F.first("n").alias("n")).select("row", "n")
    return once.unionByName(equal).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")

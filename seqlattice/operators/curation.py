"""Curation: rule predicates, priority assignment, splits, samples, joins that check, set assertions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rules in their order of priority; (name, title, include, exclude), searched without regard to case.
FAMILY_RULES = (
    ("kinase", "Protein kinases", (r"\bkinase",), (r"kinase inhibitor", r"kinase regulator", r"kinase substrate", r"pseudokinase")),
    (
        "tf",
        "Transcription factors",
        (r"zinc finger", r"homeobox", r"basic helix-loop-helix", r"\bbZIP\b", r"forkhead box", r"high mobility group", r"nuclear receptor", r"T-box", r"SOX transcription", r"ETS transcription", r"transcription factor"),
        (r"transcription factor binding", r"cofactor"),
    ),
    ("ion", "Ion channels", (r"\bchannel",), (r"channel regulat", r"channel auxiliary", r"channel interacting")),
    (
        "gpcr",
        "GPCRs",
        (r"G protein-coupled receptor", r"adrenoceptor", r"5-hydroxytryptamine receptor", r"dopamine receptor", r"muscarinic", r"opioid receptor", r"chemokine receptor", r"olfactory receptor"),
        (),
    ),
    (
        "immune",
        "Immune receptors",
        (r"toll like receptor", r"interleukin .* receptor", r"\bFc receptor", r"NOD-like receptor", r"NLR family", r"killer cell immunoglobulin", r"T cell receptor", r"B cell receptor", r"C-type lectin domain", r"immunoglobulin like receptor"),
        (r"binding",),
    ),
)
FAMILY_ORDER = ("tf", "gpcr", "kinase", "ion", "immune")


def rules_named(names: Sequence[str] | None, rules=FAMILY_RULES):
    """The rules of these short names, all without any; an unknown name is an error."""
    if not names:
        return tuple(rules)
    unknown = set(names) - {r[0] for r in rules}
    if unknown:
        raise ValueError(f"unknown families: {sorted(unknown)}")
    return tuple(r for r in rules if r[0] in names)


def matches(text: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Some include pattern is found and no exclude pattern; false for null and without includes."""
    if not include:
        return F.lit(False)
    found = text.rlike("(?i)" + "|".join(f"(?:{p})" for p in include))
    if exclude:
        found = found & ~text.rlike("(?i)" + "|".join(f"(?:{p})" for p in exclude))
    return F.coalesce(found, F.lit(False))


def assign(text: Column, rules) -> Column:
    """Name of the first rule that matches; one expression, no shuffle."""
    out = F.lit(None).cast("string")
    for name, _, include, exclude in reversed(rules):
        out = F.when(matches(text, include, exclude), F.lit(name)).otherwise(out)
    return out


def assign_capped(df: DataFrame, key: str, text: str, order: str, rules, cap: int | None = None) -> DataFrame:
    """df rows by the first rule that keeps them, with `family`; at most `cap` rows of a rule, in `order`.

    The cap comes before the claim: a row over the cap of one rule is open to the next. Only keys that were kept are
    claimed; rows of one key within a rule all stay.
    """
    if not cap:
        return df.withColumn("family", assign(F.col(text), rules)).where("family is not null")
    out, open_ = [], df
    for name, _, include, exclude in rules:
        fits = open_.where(matches(F.col(text), include, exclude))
        kept = fits.orderBy(order).limit(cap).withColumn("family", F.lit(name))
        out.append(kept)
        open_ = open_.join(kept.select(key).distinct(), key, "left_anti")
    return reduce(DataFrame.unionByName, out)


def head_per_group(df: DataFrame, group: str, order: Sequence[str], n: int | None) -> DataFrame:
    if not n:
        return df
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def seeded(key: Column, seed: int) -> Column:
    """A fixed random order: digest of key and seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def placed(df: DataFrame, key: str, stratum: str, seed: int = 42) -> DataFrame:
    """df with `_p`, the place (from 1) in its stratum by digest of key, then key, and `_c`, the stratum's rows.

    A stratum is sorted in 4096 ranges of the digest; counts of the ranges, a few rows a stratum, give where each
    begins. No task holds a whole stratum.
    """
    ranged = df.withColumn("_d", seeded(F.col(key), seed)).withColumn("_b", F.left("_d", F.lit(3)))
    return _counted(ranged, stratum, "_d", key).drop("_d")


def in_order(df: DataFrame, key: str, stratum: str) -> DataFrame:
    """df with `_p`, the place (from 1) in its stratum by key (null first), and `_c`, the stratum's rows.

    A stratum is sorted in ranges between 1023 keys at most, those of least digest, so ranges are about equal whatever
    the keys are. No task holds a whole stratum. Equal keys share a range; their order among themselves is open.
    """
    bounds = df.select(key).where(F.col(key).isNotNull()).orderBy(seeded(F.col(key), 0), key).limit(1023)
    bounds = bounds.agg(F.array_sort(F.collect_list(key)).alias("_all")).withColumn("_some", F.expr("filter(_all, (x, i) -> i % 32 = 31)"))
    upto = lambda c: F.size(F.filter(c, lambda x: x <= F.col(key)))
    ranged = df.crossJoin(F.broadcast(bounds)).withColumn("_at", upto(F.col("_some")) * 32)
    ranged = ranged.withColumn("_b", F.col("_at") + upto(F.slice("_all", F.col("_at") + 1, F.lit(32)))).drop("_all", "_some", "_at")
    return _counted(ranged, stratum, key)


def _counted(ranged: DataFrame, stratum: str, *order: str) -> DataFrame:
    """Places in strata of rows in ranges `_b`, by their order within the range and counts of the ranges before."""
    counts = ranged.groupBy(F.col(stratum).alias("_of"), F.col("_b").alias("_r")).agg(F.count("*").alias("_k"))
    whole = Window.partitionBy("_of")
    counts = counts.withColumn("_before", F.sum("_k").over(whole.orderBy("_r")) - F.col("_k")).withColumn("_c", F.sum("_k").over(whole)).drop("_k")
    joined = ranged.join(counts, F.col(stratum).eqNullSafe(F.col("_of")) & F.col("_b").eqNullSafe(F.col("_r")))
    place = F.row_number().over(Window.partitionBy(stratum, "_b").orderBy(*order)) + F.col("_before")
    return joined.withColumn("_p", place).drop("_b", "_of", "_r", "_before")


def stratified_split(df: DataFrame, key: str, stratum: str, seed: int = 42, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """df with `split`: exact shares within each stratum, the same at every run."""
    return placed(df, key, stratum, seed).withColumn(
        "split", F.when(F.col("_p") <= F.floor(F.col("_c") * train), "train").when(F.col("_p") <= F.floor(F.col("_c") * (train + val)), "val").otherwise("test")
    ).drop("_p", "_c")


def balanced_sample(df: DataFrame, key: str, group: str, values: Sequence, seed: int = 42) -> DataFrame:
    """As many rows of each value of `group` as the rarest one has, without replacement."""
    rows = df.where(F.col(group).isin(*values))
    counts = rows.groupBy(group).agg(F.count("*").alias("_c"))
    least = counts.agg(F.min("_c").alias("_least"), F.count("*").alias("_k")).select(F.when(F.col("_k") == len(values), F.col("_least")).otherwise(0).alias("_least"))
    return placed(rows, key, group, seed).crossJoin(F.broadcast(least)).where("_p <= _least").drop("_p", "_c", "_least")


def permuted_labels(df: DataFrame, key: str, label: str, within: str | None = None, seed: int = 42) -> DataFrame:
    """df with `label` permuted (within each value of `within`): the i-th row by key gets the label of the i-th by digest."""
    rows = df.withColumn("_w", F.col(within) if within else F.lit(0))
    by_key = in_order(rows, key, "_w").drop("_c")
    by_hash = placed(rows.select(key, "_w", F.col(label).alias("_label")), key, "_w", seed).select("_w", "_p", "_label")
    return by_key.join(by_hash, ["_w", "_p"]).withColumn(label, F.col("_label")).drop("_label", "_p", "_w")


def keep_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows with a key that is not null and is known."""
    return df.na.drop(subset=[key]).join(known.select(key), key, "left_semi")


def with_lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def ordered_lookup(manifest: DataFrame, data: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """data in the order of the manifest (key, pos); running it fails with the first key that data does not have."""
    marked = data.withColumn("_there", F.lit(True))
    joined = manifest.join(marked, key, "left")
    checked = F.when(F.col("_there"), F.col(pos)).otherwise(F.raise_error(F.concat(F.lit(f"missing {key}: "), F.col(key).cast("string"))).cast("long"))
    return joined.withColumn(pos, checked).drop("_there").orderBy(pos)


def aligned_pairs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a and b paired by key; running it fails if either lacks a key of the other."""
    x, y = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    joined = x.join(y, key, "full_outer")
    both = F.when(F.col("_a") & F.col("_b"), F.col(key)).otherwise(F.raise_error(F.lit("keys differ")).cast(dict(a.dtypes)[key]))
    return joined.withColumn(key, both).drop("_a", "_b")


def membership(df: DataFrame, members: DataFrame, key: str, name: str = "label") -> DataFrame:
    """df with 1 where the key is a member, else 0."""
    m = members.select(F.col(key).alias("_k"), F.lit(1).alias("_m")).distinct()
    return df.join(m, df[key] == m["_k"], "left").withColumn(name, F.col("_m").isNotNull().cast("tinyint")).drop("_k", "_m")


def split_violations(df: DataFrame, whole: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(problem, key) of keys in two splits, keys missing from all, and keys that are not part of the whole; empty if all is well."""
    twice = df.groupBy(key).agg(F.count_distinct(split).alias("n")).where("n > 1").select(F.lit("overlap").alias("problem"), key)
    gone = whole.select(key).join(df.select(key), key, "left_anti").select(F.lit("missing").alias("problem"), key)
    more = df.select(key).join(whole.select(key), key, "left_anti").select(F.lit("extra").alias("problem"), key)
    return twice.unionByName(gone).unionByName(more)


def composition(df: DataFrame, family: str, split: str, order: Sequence[str] = FAMILY_ORDER) -> DataFrame:
    """family, total, train, val, test: zero-filled, families in the given order."""
    counts = df.groupBy(family).agg(F.count("*").alias("total"), *[F.count_if(F.col(split) == s).alias(s) for s in ("train", "val", "test")])
    names = df.sparkSession.createDataFrame([(n, k) for k, n in enumerate(order)], f"{family} string, _k int")
    return names.join(counts, family, "left").na.fill(0, ["total", "train", "val", "test"]).orderBy("_k").drop("_k")


def split_balance(df: DataFrame, label: str, split: str = "split", low: float = 0.45, high: float = 0.55) -> DataFrame:
    """split, n_classes, positive, balanced: classes seen and, for labels 0 and 1, whether their share is balanced."""
    out = df.groupBy(split).agg(F.count_distinct(label).alias("n_classes"), F.avg(F.col(label).cast("double")).alias("positive"))
    return out.withColumn("balanced", F.col("positive").between(low, high))


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """One row: how many rows pass each step and all before it; a single scan."""
    passed, columns = F.lit(True), []
    for name, condition in steps.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        columns.append(F.count_if(passed).alias(name))
    return df.agg(*columns)


def overlaps(df: DataFrame, key: str, group: str) -> DataFrame:
    """(a, b, n): keys that two groups share, a < b. Groups of a key are gathered, not pairs of rows."""
    groups = df.groupBy(key).agg(F.array_sort(F.collect_set(group)).alias("g")).where(F.size("g") > 1)
    pairs = F.flatten(F.transform("g", lambda a: F.transform(F.filter("g", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return groups.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a"), F.col("p.b")).agg(F.count("*").alias("n"))

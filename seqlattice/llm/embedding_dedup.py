"""Near-duplicate embeddings by cosine: int8 tile products with error bounds, full precision only where a pair may link.

Equal vectors collapse to one class first. Classes are dealt into buckets by random rotations: in each of several
tables, the code of a vector is its largest coordinate, with its sign, after one or more fixed rotations, so near
vectors share a bucket. The number of rotations follows the number of classes, so that buckets stay small, and the
number of tables follows from it: a pair right at the threshold meets in some table with a probability of `recall` at
least, nearer pairs almost surely. Buckets are dealt into tiles of bounded size, so a hot bucket becomes many tile
pairs. In a tile pair the unit vectors are quantised to int8, multiplied tile by tile (integer products, exact in
float32 up to 1,000 dimensions), and every pair whose product plus the two vectors' own quantisation error bounds may
reach the threshold is recomputed in double precision. A pair counts in the first table that it shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.llm.common import components, cut, forest, prepare

#: Classes on one side of a tile pair.
TILE = 2048
#: Chance that a pair right at the threshold meets, at least.
RECALL = 0.999
#: Classes of a bucket, were all equally likely; more classes mean one more rotation a table.
BUCKET = 2048
#: One class in so many is counted to find large buckets; the counts decide only how a bucket is split.
COUNTED = 16
_PAIRS = 1 << 16


def usable(vectors: np.ndarray) -> np.ndarray:
    return np.isfinite(vectors).all(axis=1) & (np.abs(vectors).max(axis=1, initial=0) > 0)


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest component first, so that nothing under- or overflows."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scale, error): u = scale * q + e with |e| at most error, rounding of this very computation included."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None])
    rest = u - q * scale[:, None]
    return q.astype(np.int8), scale, np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9) + 1e-12


def links(left: np.ndarray, right: np.ndarray, threshold: float, same: bool, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of linked unit vectors; i < j only if both sides are the same tile."""
    q, s, e = quantise(left)
    r, t, f = (q, s, e) if same else quantise(right)
    most = f.max(initial=0)
    # u.v <= s t (q.r) + |e| |v| + |s q| |f|, with |v| <= 1 (rounding in 1e-9) and |s q| <= 1 + |e|
    least = (threshold - 1e-9 - e - (1 + e) * most) / s
    exact = q.shape[1] * 127 * 127 < 1 << 24
    kind = np.float32 if exact else np.float64
    rt = r.astype(kind).T
    for at in range(0, len(left), rows):
        product = q[at : at + rows].astype(kind) @ rt
        product *= t.astype(kind)[None, :] * kind(1 + 1e-6)  # rounding of the scaling itself
        i, j = np.nonzero(product >= (least[at : at + rows] - 1e-3)[:, None].astype(kind))
        i += at
        if same:
            ahead = i < j
            i, j = i[ahead], j[ahead]
        for k in range(0, len(i), _PAIRS):
            a, b = i[k : k + _PAIRS], j[k : k + _PAIRS]
            near = np.einsum("ij,ij->i", left[a], right[b]) >= threshold
            if near.any():
                yield a[near], b[near]


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def rotations(d: int, n: int, seed: int = 42) -> np.ndarray:
    """n fixed random rotations of d dimensions."""
    r = np.random.default_rng([seed, d])
    return np.stack([np.linalg.qr(r.standard_normal((d, d)))[0] for _ in range(n)])


def codes(u: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """For each rotation, the number of each unit vector's largest coordinate, and its sign: (vectors, rotations)."""
    out = np.empty((len(u), len(turned)), np.int16 if u.shape[1] < 1 << 14 else np.int32)
    for k, q in enumerate(turned):
        x = u @ q
        at = np.abs(x).argmax(axis=1)
        out[:, k] = 2 * at + (x[np.arange(len(u)), at] < 0)
    return out


def meeting_rate(d: int, threshold: float, pairs: int = 1 << 14, seed: int = 7) -> float:
    """Share of pairs of d-dimensional vectors right at the threshold that have one code, by a fixed simulation."""
    r = np.random.default_rng([seed, d])
    u, v = units(r.standard_normal((pairs, d))), r.standard_normal((pairs, d))
    if d > 1:
        v = units(v - (u * v).sum(axis=1, keepdims=True) * u)
        v = threshold * u + math.sqrt(1 - threshold * threshold) * v
    else:
        v = u
    q = rotations(d, 1, seed)
    # a little under what was seen, so that chance does not make it look better
    seen = float((codes(u, q) == codes(v, q)).mean())
    return max(seen - 2 * math.sqrt(seen * (1 - seen) / pairs), 1e-3)


def plan_of(classes: int, d: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(rotations a table, tables) for so many classes."""
    each = max(1, math.ceil(math.log(max(2, classes) / BUCKET) / math.log(2 * d))) if d > 1 else 1
    met = meeting_rate(d, threshold) ** each
    return each, max(1, math.ceil(math.log(1 - recall) / math.log(1 - met))) if met < 1 else 1


def _placed(turned, each: int):
    """Each class once for every table: (rep, vec, copies, t, bucket, all its buckets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = codes(units(_matrix(batch.column(1))), turned.value).astype(np.int64)
            tables = found.shape[1] // each
            wide = 2 * turned.value.shape[1]
            buckets = sum(found[:, k::each] * wide**k for k in range(each))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(buckets.ravel()), tables).cast(pa.list_(pa.int64()))
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(found), t, np.int32)), pa.array(buckets[:, t]), flat], names=["rep", "vec", "copies", "t", "bucket", "buckets"])

    return run


def _compared(threshold: float):
    """Of each tile pair: links of each class (weighted by copies) and a spanning forest, over the pairs that are its own."""

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        table = table.take(pa.array(np.argsort(side, kind="stable")))
        n, m = len(side), int((side == 0).sum())
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        u, buckets = units(_matrix(table.column("vec").combine_chunks())), _matrix(table.column("buckets").combine_chunks()).astype(np.int64)
        t, same = keys[0].as_py(), keys[2].as_py() == keys[3].as_py()
        weight = np.zeros(n, np.int64)

        def counted():
            for i, j in links(u[:m], u if same else u[m:], threshold, same):
                j = j if same else j + m
                own = ~(buckets[i, :t] == buckets[j, :t]).any(axis=1)  # no table before this one has the pair
                i, j = i[own], j[own]
                np.add.at(weight, i, copies[j])
                np.add.at(weight, j, copies[i])
                yield i, j

        root = forest(n, counted())
        out = np.nonzero((weight > 0) | (root != np.arange(n)))[0]
        return pa.table({"a": rep[out], "b": rep[root[out]], "w": weight[out]})

    return run


def class_links(classes: DataFrame, d: int, threshold: float, tile: int = TILE, recall: float = RECALL, counted: int = COUNTED) -> DataFrame:
    """(a, b, w) of classes (rep, vec, copies) of one length d: links that connect them, and each one's number of linked vectors."""
    spark = classes.sparkSession
    each, tables = plan_of(classes.count(), d, threshold, recall)
    turned = spark.sparkContext.broadcast(rotations(d, each * tables))  # d * d numbers a rotation
    kinds = "rep long, vec " + dict(classes.dtypes)["vec"] + ", copies long, t int, bucket long, buckets array<long>"
    rows = classes.select("rep", "vec", "copies").mapInArrow(_placed(turned, each), kinds)
    few = classes.where(F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(counted)) == 0).select("rep", "vec", "copies").mapInArrow(_placed(turned, each), kinds)
    large = few.groupBy("t", "bucket").agg((F.count("*") * counted).alias("n")).where(F.col("n") > tile)
    large = cut(large.select("t", "bucket", F.ceil(F.col("n") / tile).cast("int").alias("parts")))
    if large.isEmpty():
        rows = rows.withColumn("parts", F.lit(1))
    else:
        rows = rows.join(large, ["t", "bucket"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # part p of a bucket of k parts meets every part, its own included: tile (i, j), i <= j
    p = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    cell = lambda o: F.struct(F.least(o, F.col("p")).alias("i"), F.greatest(o, F.col("p")).alias("j"), F.when(F.col("p") <= o, 0).otherwise(1).alias("side"))
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), cell)).alias("c")
    tiles = rows.withColumn("p", p).select("t", "bucket", "rep", "copies", "vec", "buckets", cells).select("t", "bucket", "c.i", "c.j", "c.side", "rep", "copies", "vec", "buckets")
    return cut(tiles.groupBy("t", "bucket", "i", "j").applyInArrow(_compared(threshold), "a long, b long, w long"))


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tile: int = TILE, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: direct links at cosine >= threshold, smallest reachable id.

    Every link found is exact; a pair right at the threshold is found with a probability of `recall` at least, nearer
    ones almost surely. A vector that is null, empty, zero, or holds a null or non-finite component links with
    nothing. Vectors of different lengths do not link. Equal vectors link with each other; repeated rows count as
    further vectors, and rows of one id may have different vectors. A row with a null id links with nothing and has a
    null component. Other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("vec"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.col("_id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0)
    rows = cut(rows.withColumn("ok", F.coalesce(good, F.lit(False))))
    # classes are named by a hash of their vector, as equal ids may have different ones
    vec = F.transform("vec", lambda x: F.when(x == 0, F.lit(0).cast(dict(rows.dtypes)["vec"][6:-1])).otherwise(x))
    usable_rows = rows.where("ok").select("_id", vec.alias("vec"))
    classes = cut(usable_rows.groupBy("vec").agg(F.min("_id").alias("least"), F.count("*").alias("copies")).withColumn("rep", F.xxhash64("vec")))
    sizes = [r.d for r in classes.groupBy(F.size("vec").alias("d")).count().select("d").collect()]
    found = [class_links(classes.where(F.size("vec") == d), d, threshold, tile, recall) for d in sizes]  # a table has one length, or a few
    alone = rows.where("not ok").select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.col("_id").isNotNull().alias("kept"))
    if not found:
        return alone
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    reached = components(every.where("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    named = classes.join(every.groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("w")), "rep", "left").join(reached, "rep", "left")
    named = cut(named.select("rep", "least", (F.coalesce("w", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component")))
    firsts = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(named.join(firsts, "component").select("rep", "n", "component_id"))
    out = usable_rows.select("_id", F.xxhash64("vec").alias("rep")).join(named, "rep")
    out = out.select(F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_links"), "component_id", (F.col("_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(alone)

"""Repeated lines across documents, found with two Bloom filters: hashes seen once, and hashes seen again.

Pass 1 sends only 8-byte hashes of eligible lines, packed per task and segment of the hash space, to the owner of
each segment. The owner streams them through its once-seen filter; a hash that is there already goes into its
twice-seen filter. The once-seen filters never leave their owners. Pass 2 probes the twice-seen filters: only lines
suspected of repeating are shuffled, with their text, for the exact count of documents and the choice of the one that
keeps them. Pass 3 rewrites the documents that lose lines; the others never meet a shuffle.

The twice-seen filters are broadcast if they have `broadcast_bytes` together at most. Beyond that they stay with their
owners as well: pass 2 sends (hash, row) of eligible lines to them, and the rows that they suspect are read once more.
Either way the documents are read a fixed number of times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlattice.llm.common import binary_column, cut, prepare

SPACE = b" \t\n\r\x0b\x0c"
#: Filter bits a hash, bits set a hash.
BITS_A_HASH, PROBES = 12, 4
#: Most bytes of filters broadcast.
BROADCAST_BYTES = 32 << 20
#: Least bits of a hash that name its segment; as many segments as shuffle partitions, at least, so owners stay small.
SEGMENT_BITS = 8


def eligible(text: bytes | None, least: int) -> Iterator[tuple[int, bytes]]:
    """(line number, key) of the lines whose key has at least `least` code points."""
    for k, line in enumerate((text or b"").lower().split(b"\n")):
        if len(line) >= least:
            key = line.strip(SPACE)
            if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
                yield k, key


def _digest(key: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(key)


def _spots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit numbers of each hash (double hashing); bits is a power of two."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * step[None, :]) >> np.uint64(13)) & np.uint64(bits - 1)


def new_filter(n: int) -> np.ndarray:
    """An empty filter for n hashes: packed bits, a power of two of them."""
    return np.zeros(1 << max(7, int(np.ceil(np.log2(max(1, n * BITS_A_HASH)))) - 3), np.uint8)


def put(table: np.ndarray, hashes: np.ndarray) -> None:
    spots = _spots(hashes, 8 * len(table)).ravel()
    np.bitwise_or.at(table, (spots >> np.uint64(3)).astype(np.int64), np.uint8(1) << (spots & np.uint64(7)).astype(np.uint8))


def held(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash."""
    spots = _spots(hashes, 8 * len(table))
    return ((table[(spots >> np.uint64(3)).astype(np.int64)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def seen_filters(parts: list[np.ndarray]) -> np.ndarray:
    """Twice-seen filter of hashes arriving in parts; sized to what was found in the once-seen filter before."""
    once = new_filter(sum(map(len, parts)))
    again = []
    for part in parts:
        # repeats within a part, then hashes that the filter has already
        values, counts = np.unique(part, return_counts=True)
        hit = held(once, values) | (counts > 1)
        again.append(values[hit])
        put(once, values)
    found = np.unique(np.concatenate(again)) if again else np.zeros(0, np.uint64)
    twice = new_filter(len(found))
    put(twice, found)
    return twice


def _hashed(least: int, segment_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_digest(key) for text in binary_column(batch, "_text") for _, key in eligible(text, least)]
            values, counts = np.unique(np.array(got, np.uint64), return_counts=True)
            h = np.repeat(values, np.minimum(counts, 2))  # twice says as much as often: a very common line stays small
            segment = (h >> np.uint64(64 - segment_bits)).astype(np.int64)
            own, at = np.unique(segment, return_index=True)
            ends = np.append(at[1:], len(h)) if len(h) else at
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), pa.array([h[s:e].tobytes() for s, e in zip(at, ends, strict=True)], pa.binary())], names=["segment", "hashes"]
            )

    return run


def _merged(table: pa.Table) -> pa.Table:
    twice = seen_filters([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()])
    return pa.table({"segment": table.column("segment").slice(0, 1), "twice": pa.array([twice.tobytes()], pa.binary())})


def _segment(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _referred(least: int, segment_bits: int):
    """(segment, hashes, rows): eligible lines' hashes, each with its row's key, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            got = [{_digest(key) for _, key in eligible(text, least)} for text in binary_column(batch, "_text")]
            h = np.array([x for own in got for x in own], np.uint64)
            row = np.repeat(keys, [len(own) for own in got])
            order = np.argsort(h, kind="stable")
            h, row = h[order], row[order]
            own, at = np.unique(_segment(h, segment_bits), return_index=True)
            ends = np.append(at[1:], len(h)) if len(h) else at
            packed = [pa.array([x[s:e].tobytes() for s, e in zip(at, ends, strict=True)], pa.binary()) for x in (h, row)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *packed], names=["segment", "hashes", "rows"])

    return run


def _suspected(table: pa.Table) -> pa.Table:
    """Rows with a line that the segment's twice-seen filter may hold, and the hashes of these lines."""
    hashes, rows = ([np.frombuffer(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("hashes", np.uint64), ("rows", np.int64)))
    twice = seen_filters(hashes)
    h, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, rows))
    hit = held(twice, h) if len(h) else np.zeros(0, bool)
    order = np.argsort(row[hit], kind="stable")
    h, row = h[hit][order], row[hit][order]
    own, at = np.unique(row, return_index=True)
    ends = np.append(at[1:], len(h)) if len(h) else at
    return pa.table({"_k": pa.array(own.astype(np.int64)), "h": pa.array([h[s:e].tobytes() for s, e in zip(at, ends, strict=True)], pa.binary())})


def _suspects(least: int, segment_bits: int, filters):
    """Of each row, once for each key that may repeat: (_id, _print, key, line numbers).

    A key may repeat if the broadcast filters hold it or, without any, if it is among the hashes that the owners sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {s: np.frombuffer(x, np.uint8) for s, x in filters.value.items()} if filters is not None else {}
        for batch in batches:
            at, numbers, keys = [], [], []
            for k, text in enumerate(binary_column(batch, "_text")):
                for n, key in eligible(text, least):
                    at.append(k)
                    numbers.append(n)
                    keys.append(key)
            h = np.array(list(map(_digest, keys)), np.uint64)
            hit = np.zeros(len(h), bool)
            if filters is None:
                sent = [{int(v) for x in lists for v in np.frombuffer(x, np.uint64)} for lists in batch.column(3).to_pylist()]
                hit = np.array([int(x) in sent[k] for x, k in zip(h, at, strict=True)], bool)
            else:
                segment = _segment(h, segment_bits)
                for s in np.unique(segment).tolist():
                    if s in tables:
                        own = np.nonzero(segment == s)[0]
                        hit[own] = held(tables[s], h[own])
            lines: dict[tuple[int, bytes], list[int]] = {}
            for i in np.nonzero(hit)[0].tolist():
                lines.setdefault((at[i], keys[i]), []).append(numbers[i])
            take = pa.array([k for k, _ in lines], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array([k.decode("utf-8", "replace") for _, k in lines], pa.string()), pa.array(list(lines.values()), pa.list_(pa.int32()))],
                names=["_id", "_print", "key", "lines"],
            )

    return run


def _row_key(*columns: str) -> Column:
    return F.xxhash64(*columns)


def repeated_lines(rows: DataFrame, least_chars: int = 40, least_docs: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(_id, _print, drop): the line numbers that each row of rows (_id, _print, _text) loses."""
    spark = rows.sparkSession
    prepare(spark)
    bits = max(SEGMENT_BITS, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    filters = cut(rows.select("_text").mapInArrow(_hashed(least_chars, bits), "segment int, hashes binary").groupBy("segment").applyInArrow(_merged, "segment int, twice binary"))
    kinds = "_id long, _print long, key string, lines array<int>"
    size = filters.agg(F.sum(F.octet_length("twice"))).first()[0]
    if (size or 0) <= broadcast_bytes:
        share = {r.segment: bytes(r.twice) for r in filters.collect()}
        suspects = rows.select("_id", "_print", "_text").mapInArrow(_suspects(least_chars, bits, spark.sparkContext.broadcast(share)), kinds)
    else:
        keyed = rows.select("_id", "_print", "_text", _row_key("_id", "_print").alias("_r"))
        sent = keyed.select("_r", "_text").mapInArrow(_referred(least_chars, bits), "segment int, hashes binary, rows binary").groupBy("segment").applyInArrow(_suspected, "_k long, h binary")
        sent = cut(sent.groupBy("_k").agg(F.collect_list("h").alias("h")))  # a row's own lines
        found = keyed.join(sent.hint("shuffle_hash"), F.col("_r") == F.col("_k")).select("_id", "_print", "_text", "h")
        suspects = found.mapInArrow(_suspects(least_chars, bits, None), kinds)
    suspects = cut(suspects)
    counted = suspects.where("_id is not null").groupBy("key", "_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("docs"), F.max("_id").alias("keeper"))
    # cut, so that both sides of the join are plain shuffles and a line that is very common can be split over tasks
    common = cut(counted.where(F.col("docs") >= least_docs).select("key", "keeper"))
    lost = suspects.join(common, "key").where(~F.col("_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("_id", "_print").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("drop"))


def _filtered(table: pa.Table) -> pa.Table:
    keys = table.column("_k").to_numpy().view(np.uint64)
    own = new_filter(len(keys))
    put(own, keys)
    return pa.table({"segment": table.column("segment").slice(0, 1), "twice": pa.array([own.tobytes()], pa.binary())})


def _affected(filters, segment_bits: int):
    """(.., affected): whether a row's key may be in the filters."""
    tables: dict[int, np.ndarray] = {}

    @F.pandas_udf("boolean")
    def of(keys: pd.Series) -> pd.Series:
        if not tables:
            tables.update({s: np.frombuffer(x, np.uint8) for s, x in filters.value.items()})
        h = keys.to_numpy(np.int64).view(np.uint64)
        segment, out = _segment(h, segment_bits), np.zeros(len(h), bool)
        for s in np.unique(segment).tolist():
            if s in tables:
                own = np.nonzero(segment == s)[0]
                out[own] = held(tables[s], h[own])
        return pd.Series(out)

    return of


def affected_only(drops: DataFrame, broadcast_bytes: int = BROADCAST_BYTES):
    """A function of a key column: whether drops (_k) may hold the key. None if the filters would be larger than allowed.

    Filters have BITS_A_HASH to 2 * BITS_A_HASH bits a key.
    """
    if drops.count() * BITS_A_HASH // 4 > broadcast_bytes:
        return None
    # the upper bits of a hash name the segment, the others a place in it
    spread = drops.select("_k", F.shiftrightunsigned("_k", 64 - SEGMENT_BITS).cast("int").alias("segment"))
    filters = spread.groupBy("segment").applyInArrow(_filtered, "segment int, twice binary")
    share = {r.segment: bytes(r.twice) for r in filters.collect()}  # broadcast_bytes at most, as counted above
    return _affected(drops.sparkSession.sparkContext.broadcast(share), SEGMENT_BITS)


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n_lines, n_dropped = [], [], []
        drops = batch.column(batch.schema.get_field_index("drop")).to_pylist()
        for text, drop in zip(binary_column(batch, "_text"), drops, strict=True):
            lines = (text or b"").split(b"\n")
            gone = set(drop or ())
            n_lines.append(len(lines))
            n_dropped.append(len(gone))
            texts.append(b"\n".join([x for k, x in enumerate(lines) if k not in gone]) if gone else text)
        keep = [k for k, f in enumerate(batch.schema) if f.name not in ("_text", "drop")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(k) for k in keep], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
            names=[*[batch.schema.field(k).name for k in keep], "kept_text", "n_lines", "n_dropped"],
        )


def _deduped(docs: DataFrame, id_col: str, text_col: str, others: list[str], least_chars: int, least_docs: int, broadcast_bytes: int) -> DataFrame:
    """(_id, _c0 .., kept_text, n_lines, n_dropped): the other columns under names of our own."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(others)])
    # equal ids may have different texts: line numbers belong to (id, hash of text)
    rows = rows.withColumn("_print", F.xxhash64("_text"))
    drops = repeated_lines(rows, least_chars, least_docs, broadcast_bytes)
    drops = cut(drops.select(_row_key("_id", "_print").alias("_k"), F.col("_id").alias("_i"), F.col("_print").alias("_p"), "drop"))
    rows = rows.withColumn("_r", _row_key("_id", "_print"))
    affected = affected_only(drops, broadcast_bytes)
    # a shuffled hash join streams the texts without sorting them; documents that lose nothing go round it
    same = (F.col("_k") == F.col("_r")) & F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_p") == F.col("_print"))
    some, rest = (rows, None) if affected is None else (rows.where(affected("_r")), rows.where(~affected("_r")))
    joined = some.join(drops.hint("shuffle_hash"), same, "left").drop("_k", "_i", "_p", "_print", "_r")
    if rest is not None:
        joined = joined.unionByName(rest.drop("_print", "_r").withColumn("drop", F.lit(None).cast("array<int>")))
    kept = ", ".join(f"{c} {t}" for c, t in joined.dtypes if c not in ("_text", "drop"))
    return joined.mapInArrow(_rewritten, kept + ", kept_text string, n_lines long, n_dropped long")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, kept_text, n_lines, n_dropped) for every row of docs.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at least `least_chars`
    code points that stand in at least `least_docs` documents lose all their lines except in the largest id that
    holds them. Null and empty texts are one empty line; a null text stays null. Documents are told apart by id: rows
    with equal ids count once. A row with a null id counts for no document and keeps no repeated line. Empty input
    gives an empty result. Lines may be of any length. Other columns are ignored.
    """
    out = _deduped(docs, id_col, text_col, [], least_chars, least_docs, broadcast_bytes)
    return out.withColumnRenamed("_id", id_col)


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """docs with repeated lines taken out of text, n_chars recounted; same columns, same rows.

    Null and empty texts, null ids, ties and repeated rows follow line_dedup(): a null text stays null, with n_chars
    null, and a row with a null id loses every repeated line. Other columns stay, whatever their names.
    """
    others = [c for c in docs.columns if c != "text"]
    out = _deduped(docs, "doc_id", "text", others, least_chars, least_docs, BROADCAST_BYTES)
    named = {c: F.col(f"_c{k}") for k, c in enumerate(others)} | {"text": F.col("kept_text")}
    if "n_chars" in named:
        named["n_chars"] = F.length("kept_text").cast(dict(docs.dtypes)["n_chars"])
    return out.select(*[named[c].alias(c) for c in docs.columns])

"""Column functions and row-wise operators on sequences, coordinates and names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGT"


def fasta_sequence(text: Column) -> Column:
    """Sequence of a FASTA file's text: header lines dropped, white space removed, upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*>.*$", ""), r"\s+", ""))


def _kmer_rows(k: int):
    code = np.full(256, -1, np.int64)
    for n, b in enumerate(BASES):
        code[ord(b)] = code[ord(b.lower())] = n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 4**k
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
            out = np.zeros((len(texts), size))
            for row, text in zip(out, texts, strict=True):
                c = code[np.frombuffer(text or b"", np.uint8)]
                n = len(c) - k + 1
                if n > 0:
                    index, ok = np.zeros(n, np.int64), np.ones(n, bool)
                    for j in range(k):
                        part = c[j : j + n]
                        ok &= part >= 0
                        index = index * 4 + part
                    counts = np.bincount(index[ok], minlength=size)
                    if ok.any():
                        row[:] = counts / counts.sum()
            flat = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), size).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["id", "x"])

    return run


def kmer_frequencies(df: DataFrame, id_col: str, seq_col: str, k: int = 4) -> DataFrame:
    """(id, x): relative frequencies of all 4**k k-mers in lexicographic order; windows with another letter are skipped.

    Sequences that are null, shorter than k or without a valid window give zeros. One pass, nothing is shuffled.
    """
    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col), F.col(seq_col).cast("string")).mapInArrow(_kmer_rows(k), f"id {kind}, x array<double>").withColumnRenamed("id", id_col)


def kmer_counts(df: DataFrame, id_col: str, seq_col: str, k: int = 4) -> DataFrame:
    """(id, kmer, n) of the k-mers that occur. The look-ahead finds overlapping windows in one scan of the sequence."""
    found = F.regexp_extract_all(F.upper(seq_col), F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))
    return df.select(id_col, F.explode(found).alias("kmer")).groupBy(id_col, "kmer").agg(F.count("*").alias("n"))


def split_features(manifest: DataFrame, seqs: DataFrame, id_col: str, seq_col: str, k: int = 4) -> DataFrame:
    """(split, pos, id, x) for a manifest (id, split, pos); running it fails on an id without a sequence."""
    joined = manifest.join(seqs.select(id_col, F.col(seq_col).alias("_seq")), id_col, "left")
    missing = F.raise_error(F.concat(F.lit("no sequence for "), F.col(id_col).cast("string"))).cast("string")
    checked = joined.withColumn("_seq", F.when(F.col("_seq").isNull(), missing).otherwise(F.col("_seq")))
    return manifest.join(kmer_frequencies(checked, id_col, "_seq", k), id_col).select("split", "pos", id_col, "x")


def log_length(seq: Column) -> Column:
    return F.log1p(F.length(seq).cast("double"))


def chunk_starts(n: Column, longest: int, overlap: int) -> Column:
    """Starts of windows of `longest`, `overlap` of it shared with the next; the last one reaches the end."""
    if overlap >= longest:
        raise ValueError("overlap must be smaller than the window")
    step = longest - overlap
    last = F.ceil((n - longest) / F.lit(step)).cast("int") * step
    return F.when(n <= longest, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)))


def chunks(df: DataFrame, id_col: str, n: Column, longest: int, overlap: int) -> DataFrame:
    """(id, chunk_no, start, len), a row for each window."""
    rows = df.select(id_col, n.cast("int").alias("_n"), F.posexplode(chunk_starts(n.cast("int"), longest, overlap)).alias("chunk_no", "start"))
    return rows.select(id_col, "chunk_no", "start", F.least(F.lit(longest), F.col("_n") - F.col("start")).alias("len"))


def centre_fit(seq: Column, length: int) -> Column:
    """The sequence cut or padded with N to `length` around its centre; odd remainders go to the right."""
    n = F.length(seq)
    left = F.floor((F.lit(length) - n) / 2).cast("int")
    padded = F.concat(F.repeat(F.lit("N"), F.greatest(left, F.lit(0))), seq, F.repeat(F.lit("N"), F.greatest(F.lit(length) - n - left, F.lit(0))))
    cut = F.substring(seq, F.floor((n - length) / 2).cast("int") + 1, F.lit(length))
    return F.when(n >= length, cut).otherwise(padded)


def base_indices(seq: Column) -> Column:
    """Index of each base, A C G T from 0, anything else 4."""
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.when(F.instr(F.lit(BASES), F.upper(c)) > 0, F.instr(F.lit(BASES), F.upper(c)) - 1).otherwise(4))


def centre_slice(values: Column, k: int) -> Column:
    """The k values around the centre, all of them if there are fewer."""
    start = F.greatest(F.floor((F.size(values) - k) / 2).cast("int"), F.lit(0))
    return F.slice(values, start + 1, F.lit(k))


def tss_window(start: Column, end: Column, strand: Column, length: int) -> tuple[Column, Column]:
    """1-based inclusive window of `length` around the transcription start; moved right where it would begin before 1."""
    if length <= 0:
        raise ValueError("length must be positive")
    tss = F.when(strand >= 0, start).otherwise(end)
    low = F.greatest(tss - length // 2, F.lit(1))
    return low, low + (length - 1)


def region_name(chrom: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%d..%d:1", chrom, start, end)


def excerpt(text: Column, n: int) -> Column:
    """Trimmed beginning of a text, with an ellipsis if it goes on; bars become slashes."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.replace(F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("..."))).otherwise(t), F.lit("|"), F.lit("/"))


def markdown_cell(cell: Column) -> Column:
    """A table cell without marks of emphasis, code, or a parenthesis at its end."""
    return F.trim(F.regexp_replace(F.regexp_replace(cell, r"[`*]", ""), r"\s*\([^)]*\)\s*$", ""))


def signed4(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%+.4f", value)).otherwise("-")


def fixed4(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.4f", value)).otherwise("-")

"""Ordinal quality classifier: cumulative-link (proportional odds) regression on hashed words.

P(grade > k | x) = sigmoid(w.x - theta_k) with one weight vector for all grades and thresholds theta_0 < theta_1 < ...
kept in order by construction. Features are the distinct words of the whole text, as written and in a normal form,
hashed into one shared table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.llm.common import binary_column, cut, prepare

#: Hash table of weights.
BITS = 22
#: Labelled rows, at most, on which the model is fitted; they are chosen by a hash of the id.
FIT_ROWS = 10_000
#: Least labelled texts that a feature stands in.
LEAST_TEXTS = 4
#: Standard errors by which the mean grade of a feature's texts must differ from that of all.
SCREEN = 3.5
#: Selection: probability of the highest grade.
KEEP = 0.5
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_MASK = (1 << BITS) - 1


def features(text: bytes | None) -> np.ndarray:
    """Sorted distinct buckets of a text's words."""
    every = (text or b"").split()
    words = set(every)
    plain = {w.strip(_PUNCTUATION).lower() for w in words}
    # the tail of a word tells junk marks, the share of distinct words tells repetition; kinds are told apart by a first byte
    tails = {b"~" + w[-2:] for w in words}
    if every:
        tails.add(b"\x02%d|%d" % (len(every).bit_length(), 16 * len(words) // len(every)))
    got = [zlib.crc32(w) & _MASK for w in words] + [zlib.crc32(b"\x01" + w) & _MASK for w in plain] + [zlib.crc32(w) & _MASK for w in tails]
    return np.unique(np.array(got, np.int32))


class Ordinal:
    """Fitted model; weights of buckets that were never seen are zero."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.buckets, self.weights, self.thresholds = buckets, weights, thresholds
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def tails(self, text: bytes | None) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        if self._table is None:
            self._table = np.zeros(1 << BITS, np.float32)
            self._table[self.buckets] = self.weights
        eta = float(self._table[features(text)].sum(dtype=np.float64))
        return 1 / (1 + np.exp(-np.clip(eta - self.thresholds, -500, 500)))


def log_likelihood(w: np.ndarray, cols: np.ndarray, of: np.ndarray, grades: np.ndarray, levels: int, l2: float) -> tuple[float, np.ndarray]:
    """Penalised negative log-likelihood a text, and its gradient.

    w holds the weights of the features, then the first threshold and the logarithms of the steps to the next ones;
    text of[k] has feature cols[k].
    """
    n, features = len(grades), len(w) - levels + 1
    raw = w[features:]
    theta = np.cumsum(np.concatenate((raw[:1], np.exp(raw[1:]))))
    eta = np.bincount(of, w[cols], minlength=n)
    above = np.concatenate((np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(eta[:, None] - theta[None, :], -500, 500))), np.zeros((n, 1))), axis=1)
    low, high = above[np.arange(n), grades], above[np.arange(n), grades + 1]
    p = np.maximum(low - high, 1e-12)
    dl, dh = low * (1 - low), high * (1 - high)
    g_theta = np.zeros(levels - 1)
    np.add.at(g_theta, np.clip(grades - 1, 0, None), np.where(grades > 0, dl / p, 0))
    np.add.at(g_theta, np.clip(grades, None, levels - 2), np.where(grades < levels - 1, -dh / p, 0))
    g_raw = g_theta[::-1].cumsum()[::-1] * np.concatenate(([1.0], np.exp(raw[1:])))
    g_w = np.bincount(cols, -((dl - dh) / p)[of], minlength=features) + l2 * w[:features]
    return (l2 / 2 * (w[:features] ** 2).sum() - np.log(p).sum()) / n, np.concatenate((g_w, g_raw)) / n


def fit_ordinal(active: np.ndarray, rows: list[np.ndarray], grades: np.ndarray, levels: int, rounds: int = 300, l2: float = 0.3, rate: float = 0.15) -> Ordinal:
    """Penalised maximum likelihood by Adam on the whole sample; rows hold buckets of `active`, which is sorted."""
    n = len(rows)
    if n == 0:
        return Ordinal(np.zeros(0, np.int64), np.zeros(0, np.float32), np.arange(levels - 1, dtype=np.float64))
    cols, of = np.searchsorted(active, np.concatenate(rows)), np.repeat(np.arange(n), [len(r) for r in rows])
    w = np.zeros(len(active) + levels - 1)
    shares = np.array([(grades > k).mean() for k in range(levels - 1)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(shares / (1 - shares))
    w[len(active)] = start[0]
    w[len(active) + 1 :] = np.log(np.maximum(np.diff(start), 0.1))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        _, grad = log_likelihood(w, cols, of, grades, levels, l2)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    raw = w[len(active) :]
    return Ordinal(active, w[: len(active)].astype(np.float32), np.cumsum(np.concatenate((raw[:1], np.exp(raw[1:])))))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [features(t) for t in binary_column(batch, "_text")]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.int32()))], names=["_id", "grade", "f"])


def _screened(active):
    """Rows with the active buckets only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.intersect1d(np.array(f, np.int32), active.value, assume_unique=True).tobytes() for f in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own, pa.binary())], names=batch.schema.names)

    return run


def fit_quality(docs: DataFrame, graded: DataFrame, levels: int, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Ordinal:
    """Model from graded (id, grade 0 .. levels-1): fitted on fit_rows graded rows at most.

    Rows with a null id, null text or null grade, or a grade outside the range, teach nothing; nor do ids without a
    document. Repeated rows count as often as they stand there. Buckets are counted and screened by the executors; the
    driver receives no text and of each fitted row only the buckets that pass, of 2 ** BITS at most.
    """
    spark = docs.sparkSession
    prepare(spark)
    valid = graded.select(F.col(id_col).cast("long").alias("_id"), F.col("grade").cast("int").alias("grade")).where(f"_id is not null and grade between 0 and {levels - 1}")
    some = valid.orderBy(F.xxhash64("_id"), "_id", "grade").limit(fit_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    rows = rows.join(F.broadcast(some), "_id").select("_id", "grade", "_text")  # fit_rows pairs of numbers
    key = ["_id", "grade", "p"]
    rows = rows.mapInArrow(_hashed, "_id long, grade int, f array<int>").withColumn("p", F.xxhash64("f"))
    rows = cut(rows.groupBy(*key).agg(F.first("f").alias("f"), F.count("*").alias("n")))
    # repeated ids may have more rows than are fitted: the first ones in order
    take, left = [], fit_rows
    for r in rows.select(*key, "n").orderBy(*key).limit(fit_rows).collect():
        take.append((r["_id"], r["grade"], r["p"], min(r["n"], left)))
        left -= take[-1][3]
        if not left:
            break
    times = np.array([x[3] for x in take], np.int64)
    grades = np.repeat(np.array([x[1] for x in take], np.int64), times)
    if not len(grades):
        return fit_ordinal(np.zeros(0, np.int32), [], grades, levels)
    own = rows.drop("n").join(F.broadcast(spark.createDataFrame(take, "_id long, grade int, p long, k long")), key)
    counts = own.select(F.explode("f").alias("b"), "k", "grade").groupBy("b").agg(F.sum("k").alias("seen"), F.sum(F.col("k") * F.col("grade")).alias("sum"))
    z = F.abs(F.col("sum") / F.col("seen") - float(grades.mean())) / max(float(grades.std()), 1e-9) * F.sqrt("seen")
    active = np.sort(np.array([r.b for r in counts.where((F.col("seen") >= LEAST_TEXTS) & (z >= SCREEN)).select("b").collect()], np.int32))
    kinds = "_id long, grade int, p long, f binary"
    got = own.select(*key, "f").mapInArrow(_screened(spark.sparkContext.broadcast(active)), kinds).collect()
    of = {(r["_id"], r["grade"], r["p"]): np.frombuffer(r["f"], np.int32) for r in got}
    return fit_ordinal(active, [of[x[:3]] for x in take for _ in range(x[3])], grades, levels)


def _graded(model, keep: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_column(batch, "_text")
            zero = np.zeros(len(model.value.thresholds))
            tails = np.array([model.value.tails(t) if t and t.strip() else zero for t in texts]).reshape(len(texts), len(zero))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= keep)], names=["_id", "expected_grade", "tail_prob", "keep"]
            )

    return run


def score_quality(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """(id, expected_grade, tail_prob, keep) for every row of docs: expected grade, probability of the highest grade, selection.

    A null text, and one without a word, has grade 0 and is not kept. Null ids and repeated rows pass through. Whole
    texts of any length are read. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights at most
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(_graded(shared, keep), f"_id {dict(docs.dtypes)[id_col]}, expected_grade double, tail_prob double, keep boolean").withColumnRenamed("_id", id_col)

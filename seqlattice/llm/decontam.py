"""Benchmark decontamination with spaced seeds: hashes of token windows under fixed masks that ignore one position.

Any window of five aligned words with at most one substitution is hit by one of the masks below. An overlap of n words
with at least 80 % equal holds such a window, so none is missed. Around each hit the aligned words are compared along
the whole diagonal within the document, and the pair counts if some stretch of `overlap` words (or the whole item, if
it is shorter) has at least `similarity` equal words.

Test items are taken in blocks of bounded size, a long item in overlapping pieces. Each block's masks, keyed by word
numbers, are broadcast and joined with every window of every document. All blocks are probed in one pass over the
documents; a worker holds a few of them and reads the others anew for each batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.llm.common import binary_column, cut, prepare

#: Positions of a window that count. Span 5 at most, four words each.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
SIMILARITY, OVERLAP = 0.8, 13
#: Words of test items in a block (about 64 bytes of index each), and blocks that a worker holds.
BLOCK_WORDS, HELD = 1_000_000, 4
#: Words of one piece of an item, at most.
PIECE_WORDS = 4096
GAP = 5
LEAST_WORDS = len(MASKS[0])
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LARGE = 1 << 21


def words_of(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z), parted by anything that is ASCII and neither letter nor digit."""
    return (text or b"").translate(_TABLE).split()


class Block:
    """Spaced-seed index of some test items, given as (id, words); a long item in pieces that overlap."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.vocabulary: dict[bytes, int] = {}
        #: Items too short for a seed: they are looked for as whole documents.
        self.whole: dict[tuple[bytes, ...], list[int]] = {}
        for i, own in items:
            if 0 < len(own) < LEAST_WORDS:
                self.whole.setdefault(tuple(own), []).append(i)
        items = [(i, own) for i, own in items if len(own) >= LEAST_WORDS]
        self.ids = np.array([i for i, _ in items], np.int64)
        parts, starts, at = [], [], 0
        for _, words in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            starts.append(at)
            parts.append(np.array([*own, *[-2] * GAP], np.int64))
            at += len(own) + GAP
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.starts = np.array(starts, np.int64)
        self.lengths = np.array([len(p) - GAP for p in parts], np.int64)
        self.keys, self.order = [], []
        for mask in MASKS:
            key, at_ = self.seeds(self.words, mask)
            order = np.argsort(key, kind="stable")
            self.keys.append(key[order])
            self.order.append(at_[order])

    def seeds(self, words: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(key, position) of the windows whose selected words all belong to the vocabulary."""
        n = len(words) - mask[-1]
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        known = words >= 0
        at = np.nonzero(np.logical_and.reduce([known[m : n + m] for m in mask]))[0]
        key = np.zeros(len(at), np.uint64)
        for m in mask:
            key = key * np.uint64(max(2, len(self.vocabulary))) + words[at + m].astype(np.uint64)
        return key, at

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in words, position in the items' words) of every seed in common."""
        here, there = [], []
        for mask, keys, order in zip(MASKS, self.keys, self.order, strict=True):
            if not len(keys):
                continue
            key, at = self.seeds(words, mask)
            low = np.searchsorted(keys, key, "left")
            found = keys[np.minimum(low, len(keys) - 1)] == key
            low, key, at = low[found], key[found], at[found]
            count = np.searchsorted(keys, key, "right") - low
            here.append(np.repeat(at, count))
            first = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) if len(count) else low
            there.append(order[first + np.arange(len(first))])
        return (np.concatenate(here), np.concatenate(there)) if here else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def overlaps(self, texts: list[list[bytes]], similarity: float, overlap: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item id, first word, equal words, words compared) of each verified pair; its best stretch in a piece."""
        get = self.vocabulary.get
        gap, parts, begin, end, at = [-1] * GAP, [], [], [], 0
        for d, text in enumerate(texts):
            if len(text) < LEAST_WORDS:
                for i in self.whole.get(tuple(text), ()):
                    yield d, i, 0, len(text), len(text)
            own = [get(w, -1) for w in text]
            begin.append(at)
            end.append(at + len(own))
            parts += own
            parts += gap
            at += len(own) + GAP
        words = np.array(parts, np.int64)
        begins, ends = np.array(begin, np.int64), np.array(end, np.int64)
        here, there = self.hits(words)
        if not len(here):
            return
        item = np.searchsorted(self.starts, there, "right") - 1
        doc = np.searchsorted(begins, here, "right") - 1
        # one comparison for each (document, item, diagonal)
        case = np.unique(np.stack([doc, item, here - (there - self.starts[item])]), axis=1)
        doc, item, first = case
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n in np.unique(self.lengths[item]).tolist():
            own = np.nonzero(self.lengths[item] == n)[0]
            width = min(n, overlap)
            least = math.ceil(similarity * width - 1e-9)
            step = max(1, _LARGE // n)
            for k in range(0, len(own), step):
                c = own[k : k + step]
                place = first[c][:, None] + np.arange(n)
                inside = (place >= begins[doc[c]][:, None]) & (place < ends[doc[c]][:, None])
                equal = inside & (words[np.where(inside, place, 0)] == self.words[self.starts[item[c]][:, None] + np.arange(n)])
                sums = np.cumsum(np.pad(equal, ((0, 0), (1, 0))), axis=1)
                runs = sums[:, width:] - sums[:, :-width]
                top = runs.argmax(axis=1)
                for r in np.nonzero(runs.max(axis=1) >= least)[0].tolist():
                    d, i = int(doc[c[r]]), int(item[c[r]])
                    got = (int(runs[r, top[r]]), -int(first[c[r]] + top[r] - begins[d]), width)
                    if got > best.get((d, i), (-1, 0, 0)):
                        best[d, i] = got
        for (d, i), (equal, place, width) in sorted(best.items()):
            yield d, int(self.ids[i]), -place, equal, width


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, words: int, overlap: int, piece: int = PIECE_WORDS) -> Iterator[Block]:
    """The test items in blocks of `words` words at most. Items stream through the driver, which holds one block of them.

    Pieces of a long item share overlap - 1 words, so that every stretch of `overlap` words lies in one of them.
    """
    some, n = [], 0
    piece = max(overlap, min(piece, words))
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").toLocalIterator():
        own = words_of(r.t.encode())
        for k in range(0, max(1, len(own) - overlap + 1), max(1, piece - overlap + 1)):
            part = own[k : k + piece]
            if some and n + len(part) > words:
                yield Block(some)
                some, n = [], 0
            some.append((r.i, part))
            n += len(part)
    if some:
        yield Block(some)


def _opened(blocks: list) -> Iterator[Block]:
    """Broadcast blocks one after the other; those that a worker does not hold are read from its executor's copy."""
    for k, block in enumerate(blocks):
        yield block.value if k < HELD else block.load_from_path(block._path)


def _overlaps(blocks: list, texts: list[bytes | None], similarity: float, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(text number, item id, first word, equal words, words compared) over all blocks, the best stretch of each pair."""
    words = [words_of(t) for t in texts]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for block in _opened(blocks):
        for d, i, first, equal, width in block.overlaps(words, similarity, overlap):
            if (equal, -first, width) > best.get((d, i), (-1, 0, 0)):
                best[d, i] = (equal, -first, width)
    return [(d, i, -first, equal, width) for (d, i), (equal, first, width) in sorted(best.items())]


def _found(blocks: list, similarity: float, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _overlaps(blocks, binary_column(batch, "_text"), similarity, overlap)
            take, *rest = [pa.array([g[k] for g in got], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *rest], names=["_id", "item_id", "first_word", "n_equal", "n_words"])

    return run


def _broadcast(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, words: int, overlap: int) -> list:
    return [docs.sparkSession.sparkContext.broadcast(b) for b in blocks_of(benchmark, id_col, text_col, words, overlap)]  # each of bounded size


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    similarity: float = SIMILARITY, overlap: int = OVERLAP, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(id, item_id, first_word, n_equal, n_words): each row of docs with each test item it overlaps, best stretch.

    Null and empty texts overlap with nothing; items with a null id or text, or without a word, match nothing. An
    item of fewer than four words is no evidence inside a text: it matches documents that consist of these words.
    Null document ids and repeated rows pass through, a result each; of items with one id, the best stretch counts.
    The earliest of equally good stretches is reported. Whole texts of any length are compared, in one pass. Empty
    tables give an empty result. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    schema = f"_id {dict(docs.dtypes)[id_col]}, item_id long, first_word long, n_equal long, n_words long"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    blocks = _broadcast(docs, benchmark, item_col, item_text_col, block_words, overlap)
    return rows.mapInArrow(_found(blocks, similarity, overlap), schema).withColumnRenamed("_id", id_col)


def _clean(blocks: list, similarity: float, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = {g[0] for g in _overlaps(blocks, binary_column(batch, "text"), similarity, overlap)}
            yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, overlap: int = OVERLAP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, unchanged, that overlap with no test item; one scan, one pass, no shuffle.

    Rows with a null or empty text, null ids and repeated rows are treated as by contaminated(): each row by its text
    alone. All columns stay, whatever their names. Empty tables give an empty result, or docs as they are.
    """
    prepare(docs.sparkSession)
    blocks = _broadcast(docs, benchmark, "item_id", "text", block_words, overlap)
    return docs.mapInArrow(_clean(blocks, similarity, overlap), docs.schema)

"""Language identification by compression: the language whose dictionary compresses a text best is its language.

Each language has one raw-content zstandard dictionary, cut from labelled texts. A whole text is compressed block by
block (so that its own history does not replace the dictionary) under every dictionary, and the smallest sum wins. A
narrow margin between the two smallest sums is a reason to reject.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlattice.llm.common import binary_column, prepare

#: The fitted sample: about this many texts of each language, of each one stretch of so many characters from anywhere
#: in it, and about so many texts of all languages; and bytes of a dictionary.
SAMPLE_TEXTS, SAMPLE_CHARS, ALL_TEXTS, DICTIONARY_BYTES = 200, 2000, 10_000, 112_640
#: Bytes compressed together.
BLOCK = 2048
#: Bytes of each language's sample in the context that breaks ties.
CONTEXT = 300
#: Share of the second smallest size by which the smallest must be smaller, or the text is rejected.
MARGIN = 0.01
#: Languages that are learned, at most, those with the most texts; each is one more compression of every text.
MAX_LANGUAGES = 256
_OTHERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The text's letters in lower case, everything else a single blank."""
    return _OTHERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


class Languages:
    """Dictionaries by language, ready to classify; compressors are built on first use in each worker.

    Short texts may come out as uncompressed under every dictionary. If the two smallest sums are nearly equal, each
    block is compressed behind one context of all languages, and what it adds to the context is compared.
    """

    def __init__(self, dictionaries: dict[str, bytes], context: bytes = b""):
        self.dictionaries, self.context = dictionaries, context
        self._compressors: list | None = None
        self._base: list[int] = []

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "context": self.context, "_compressors": None, "_base": []}

    def _build(self) -> list:
        import zstandard

        if self._compressors is None:
            # syllables are short: matches of four bytes, sought lazily
            how = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_LAZY2, window_log=17, min_match=4, hash_log=15, chain_log=16, search_log=4, target_length=32, write_content_size=False, write_checksum=False
            )
            raw = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, d in sorted(self.dictionaries.items())]
            self._compressors = [zstandard.ZstdCompressor(dict_data=d, compression_params=how) for d in raw]
            self._base = [len(c.compress(self.context)) for c in self._compressors]
        return self._compressors

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self._build()]

    def classify(self, text: bytes | None, margin: float = MARGIN) -> tuple[str, float, bool]:
        """(language, score, rejected); und for a text that is null or has no letter."""
        plain = text.decode("utf-8", "replace") if text else ""
        words = letters(plain)
        # numerals such as fractions count as word characters, but are no letters
        if not words or not self.dictionaries or not any(map(str.isalpha, plain)):
            return "und", 0.0, True
        names = sorted(self.dictionaries)
        if len(names) == 1:
            return names[0], 1.0, False
        sizes = self.sizes(words)
        first, second = sorted(sizes)[:2]
        if second - first < 3:
            blocks = [words[k : k + BLOCK] for k in range(0, len(words), BLOCK)]
            added = [sum(len(c.compress(self.context + b" " + b)) - base for b in blocks) for c, base in zip(self._build(), self._base, strict=True)]
            sizes = [s + a for s, a in zip(sizes, added, strict=True)]
            first, second = sorted(sizes)[:2]
        score = 1 / sum(math.exp(-(s - first) / (0.01 * abs(first) + 2)) for s in sizes)
        return names[sizes.index(first)], score, second - first < margin * max(second, 1)


def fit_languages(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS, languages: int = MAX_LANGUAGES) -> Languages:
    """Dictionaries from a bounded sample: about `texts` distinct texts of each language, chosen by a hash of the text.

    Only rows with text and language count; of more than `languages` languages, those with the most distinct texts
    are learned (ties by name). With very many languages there are fewer texts of each, about ALL_TEXTS together. Of
    each text, one stretch is taken, at a place given by the hash. The driver receives 2 * ALL_TEXTS stretches at most.
    """
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("l is not null and length(t) > 0")
    # copies of a text are chosen together, so the share is one of distinct texts
    distinct = rows.select("l", F.xxhash64("t").alias("k")).distinct().groupBy("l").agg(F.count("*").alias("n"))
    counts = {r.l: r.n for r in distinct.orderBy(F.desc("n"), "l").limit(languages).collect()}
    if not counts:
        return Languages({})
    each = max(30, min(texts, ALL_TEXTS // len(counts)))  # a draw of none is as good as impossible
    place = F.pmod(F.xxhash64("t"), F.lit(1 << 32))
    chosen: Column = F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col("l") == lang) & (place < int(min(1.0, each / n) * (1 << 32))))
    start = F.pmod(F.xxhash64("t", F.lit(1)), F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    some = rows.where(chosen).select("l", F.xxhash64("t").alias("k"), F.substring("t", start, F.lit(SAMPLE_CHARS)).alias("t")).distinct()
    of: dict[str, list] = {}
    for r in some.orderBy("k", "l", "t").limit(2 * max(ALL_TEXTS, 30 * len(counts))).collect():
        of.setdefault(r.l, []).append(r.t.encode())
    if lost := sorted(set(counts) - set(of)):
        raise ValueError(f"no text chosen of {', '.join(lost)}")
    # a few hundred bytes of the last text are context, the rest is the dictionary
    context = b" ".join(letters(parts[-1].decode("utf-8", "ignore"))[:CONTEXT] for _, parts in sorted(of.items()))
    joined = {lang: b" ".join(letters(p.decode("utf-8", "ignore")) for p in (parts[:-1] or parts)) for lang, parts in of.items()}
    return Languages({lang: raw[:DICTIONARY_BYTES] for lang, raw in joined.items()}, context)


def _classified(model, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = model.value
        for batch in batches:
            got = [languages.classify(t, margin) for t in binary_column(batch, "_text")]
            lang, score, narrow = ([g[k] for g in got] for k in range(3))
            columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(narrow, pa.bool_())]
            keep = [k for k, f in enumerate(batch.schema) if f.name != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *columns], names=[*[batch.schema.field(k).name for k in keep], "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """(id, lang_pred, score, rejected) for every row of docs, from the whole text alone.

    A null text and one without a letter are und, score 0, rejected. Otherwise lang_pred is a learned language; the
    first in order wins ties, which are rejected. Null ids and repeated rows pass through. Without any labelled text
    everything is und. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    model = docs.sparkSession.sparkContext.broadcast(languages)  # MAX_LANGUAGES dictionaries of DICTIONARY_BYTES at most
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(_classified(model, margin), f"_id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("_id", id_col)


def _accepted(model, margin: float, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [not model.value.classify(t, margin)[2] for t in binary_column(batch, text)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return run


def accepted(docs: DataFrame, languages: Languages, margin: float = MARGIN) -> DataFrame:
    """The rows of docs, unchanged, whose language is clear; one scan, no shuffle.

    Null texts and texts without a letter go, as do ties. Null ids and repeated rows are treated by their text alone.
    All columns stay, whatever their names. Without any learned language everything goes.
    """
    prepare(docs.sparkSession)
    return docs.mapInArrow(_accepted(docs.sparkSession.sparkContext.broadcast(languages), margin, "text"), docs.schema)


def held_out(id_col: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 after division by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))

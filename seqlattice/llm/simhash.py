"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius by bit-sliced comparison.

Candidates come from tables, each a mask of some of the 64 bits: fingerprints that agree on a mask share a bucket.
The masks are an exact pigeonhole cover: with `radius + 2` bands, two fingerprints within the radius agree on two
whole bands at least, so every pair of bands is one table.
Each bucket is stored as vertical bit planes; one machine word then holds the same bit of 64 fingerprints and a few
carry-save counter planes update 64 distances at once. A block is abandoned as soon as all of its distances exceed the
radius. Buckets larger than a tile are compared as tile pairs, so no task gathers an unbounded bucket and no pair of a
bucket is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.llm.common import binary_column, components, cut, forest_pairs, prepare

BITS = 64
#: Most fingerprints that one side of a tile holds.
TILE = 2048
#: Small buckets are laid side by side in one block of about this many fingerprints.
BLOCK = 512
#: One class in so many is counted to find large buckets; the counts decide only how a bucket is split.
COUNTED = 16
#: Large buckets, at most, that are broadcast; more are joined.
FEW = 100_000
#: Counts of a text's shingles by their hash; the sum of the lesser counts of two texts bounds what they have in common.
COUNTS = 128
#: Spanning forests of proposed links that are verified first; of the other pairs, those that their groups leave apart follow.
FORESTS = 4


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles; zero for a text without words."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], 42) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    if len(h) < 4096:
        ones = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    else:
        table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
        ones = np.concatenate([np.bincount(column, minlength=256) @ table for column in h.astype(">u8").view(np.uint8).reshape(-1, 8).T])
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in binary_column(batch, "_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["_id", "fp"])

    return run


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of 64-bit fingerprints: row p holds bit p of every fingerprint, 64 of them in a word."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((-(-len(values) // 64) * 64, BITS), np.uint8)
    padded[: len(values)] = bits
    return np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view("<u8")


def within_radius(values: np.ndarray, radius: int, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of fingerprints that differ in at most `radius` bits, by vertical carry-save counters."""
    planes, n = planes_of(values), len(values)
    counters = max(radius.bit_length(), 1)
    for at in range(0, n, rows):
        query = values[at : at + rows].astype(np.uint64)
        left = at // 64  # pairs j > i only
        block = planes[:, left:]
        count = [np.zeros((len(query), block.shape[1]), np.uint64) for _ in range(counters)]
        over = np.zeros_like(count[0])
        for p in range(BITS):
            flip = np.where((query >> np.uint64(p)) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
            carry = block[p][None, :] ^ flip[:, None]
            for c in range(counters):
                carry, count[c] = carry & count[c], carry ^ count[c]
            over |= carry
            if p % 8 == 7:
                over |= _above(count, radius)
                if p < BITS - 1 and np.all(over == np.uint64(0xFFFFFFFFFFFFFFFF)):
                    break
        else:
            hit = ~over
            i, word = np.nonzero(hit)
            if len(i):
                bits = np.unpackbits(hit[i, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                pair, bit = np.nonzero(bits)
                a, b = at + i[pair], (left + word[pair]) * 64 + bit
                keep = (a < b) & (b < n)
                if keep.any():
                    yield a[keep], b[keep]


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter value is over the radius, by comparing bits from the highest."""
    above, equal = np.zeros_like(count[0]), np.full_like(count[0], 0xFFFFFFFFFFFFFFFF)
    for c in reversed(range(len(count))):
        if radius >> c & 1:
            equal &= count[c]
        else:
            above |= equal & count[c]
            equal &= ~count[c]
    return above


def band_masks(radius: int) -> list[int]:
    """Masks of all pairs of radius + 2 bands: every pair of fingerprints within the radius agrees on one at least."""
    cuts = [round(BITS * k / (radius + 2)) for k in range(radius + 3)]
    bands = [((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in range(radius + 2)]
    return [a | b for a, b in combinations(bands, 2)]


def first_table(differ: np.ndarray, masks: Sequence[int]) -> np.ndarray:
    """Number of the first mask without a bit of `differ`; -1 if there is none."""
    out = np.full(len(differ), -1)
    at = np.arange(len(differ))
    for t, mask in enumerate(masks):
        equal = differ[at] & np.uint64(mask) == 0
        out[at[equal]] = t
        at = at[~equal]
        if not len(at):
            break
    return out


def shingle_counts(shingles: np.ndarray) -> np.ndarray:
    """How many shingles have each of COUNTS hash values; 255 stands for 255 or more."""
    return np.minimum(np.bincount((shingles % np.uint64(COUNTS)).astype(np.int64), minlength=COUNTS), 255).astype(np.uint8)


def may_be_similar(counts: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float, step: int = 1 << 14) -> np.ndarray:
    """Whether pairs may reach the Jaccard similarity: the lesser counts, summed up, are at least what they have in common."""
    out = np.empty(len(i), bool)
    for k in range(0, len(i), step):
        a, b = i[k : k + step], j[k : k + step]
        least = np.minimum(counts[a], counts[b])
        most = least.sum(axis=1, dtype=np.int64)
        out[k : k + step] = (least == 255).any(axis=1) | (most >= similarity / (1 + similarity) * (size[a] + size[b]) - 1e-6)
    return out


def _links(radius: int, forests: int | None, masks: Sequence[int], spares: bool, similarity: float):
    def nearest_first(values: np.ndarray, table: np.ndarray, whole: np.ndarray, part: np.ndarray, group: np.ndarray | None, size: np.ndarray | None, counts: np.ndarray | None):
        """Each pair once: in the first table that both share, and in the tile of both of its parts."""
        for i, j in within_radius(values, radius):
            if group is not None:
                open_ = (group[i] != group[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
                i, j = i[open_], j[open_]
            differ = values[i] ^ values[j]
            if counts is not None and len(i):
                open_ = may_be_similar(counts, size, i, j, similarity)
                i, j, differ = i[open_], j[open_], differ[open_]
            own = (table[i] == table[j]) & (first_table(differ, masks) == table[i]) & (whole[i] | (part[i] != part[j]))
            i, j, differ = i[own], j[own], differ[own]
            order = np.argsort(np.bitwise_count(differ), kind="stable")
            yield i[order], j[order]

    def joined(values: np.ndarray, ids: np.ndarray, *places: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        found = nearest_first(values, *places)
        if forests is not None:
            spare = np.zeros(len(values), bool)
            i, j = forest_pairs(len(values), found, forests, spare)
            left = np.flatnonzero(spare) if spares else np.zeros(0, np.int64)
            found = [(np.concatenate((i, left)), np.concatenate((j, left)))]
        for i, j in found:
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    def compared(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Whole buckets, one after the other; those of a single member are passed over, small ones share a block."""
        size = np.diff(np.append(_starts(columns), len(columns[0])))
        some = np.repeat(size > 1, size)
        t, _, i, j, fp, rep, part, *of = [c[some] for c in columns]
        if of:
            of[2] = np.frombuffer(b"".join(of[2]), np.uint8).reshape(-1, COUNTS)
        ends, at = np.cumsum(size[size > 1]), 0
        while at < len(t):
            end = int(ends[min(np.searchsorted(ends, at + BLOCK), len(ends) - 1)])
            own = slice(at, end)
            yield from joined(fp[own].view(np.uint64), rep[own], t[own], (i == j)[own], part[own], *([c[own] for c in of] or [None, None, None]))
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            last = int(_starts(held)[-1])  # the last bucket may go on in the next batch
            if last:
                yield from compared([c[:last] for c in held])
                held = [c[last:].copy() for c in held]
        if held is not None:
            yield from compared(held)

    return run


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where buckets start: rows in order, a bucket is named by the first four columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns[:4]:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def fingerprint_links(
    classes: DataFrame, radius: int = 2, tile: int = TILE, forests: int | None = 1, *, spares: bool = False, similarity: float = 0.0, counted: int = COUNTED
) -> DataFrame:
    """Links (a, b) that connect the representatives of all classes (fp, rep) within the radius: spanning forests of each tile.

    Every pair within the radius meets. With `spares`, (a, a) is added for each end of a pair that the forests leave out. Without forests (None)
    every pair is a link; classes then also have a `group`, a `size` and shingle `counts`, and pairs of one group, or
    that by sizes or counts cannot be similar, are none. Large buckets are found by the counts of one class in `counted`, chosen by a hash.
    """
    prepare(classes.sparkSession)
    masks = band_masks(radius)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    of = ["group", "size", "counts"] if forests is None else []
    keys = F.array(*[F.struct(F.lit(t).cast("smallint").alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("x")) for t, m in enumerate(signed)])
    rows = classes.select("fp", "rep", *of, F.explode(keys).alias("key")).select("key.*", "fp", "rep", *of)
    few = classes.where(F.pmod(F.xxhash64("fp", "rep", F.lit(7)), F.lit(counted)) == 0).select("fp", F.explode(keys).alias("key")).select("key.*")
    large = few.groupBy("t", "x").agg((F.count("*") * counted).alias("n")).where(F.col("n") > tile)
    large = cut(large.select("t", "x", F.ceil(F.col("n") / tile).cast("int").alias("parts")))
    n = large.count()
    if n == 0:
        rows = rows.withColumn("parts", F.lit(1))
    else:
        rows = rows.join(F.broadcast(large) if n <= FEW else large, ["t", "x"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.hash("fp", "rep"), F.col("parts"))
    # part p of a bucket of k parts meets every part, its own included: tile (min, max)
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j"))))
    rows = rows.withColumn("own", own).select("t", "x", "fp", "rep", "own", *of, pair.alias("pair"))
    # plain rows in the order of their tiles: nothing is gathered in the JVM, a worker holds one tile
    bucket = ["t", "x", "i", "j"]
    tiles = rows.select("t", "x", "pair.i", "pair.j", "fp", "rep", "own", *of).repartition(*bucket).sortWithinPartitions(*bucket)
    return tiles.mapInArrow(_links(radius, forests, masks, spares, similarity), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs; component_id is the smallest id reachable over links.

    Null and empty texts have no words: fingerprint zero, linked like any other. Rows with equal texts share a
    fingerprint and so a component. A null id keeps its row; it joins its fingerprint's component and never names
    one unless all ids of the component are null. Repeated rows stay repeated. Empty input gives an empty result.
    Other columns, whatever their names, are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    prints = cut(rows.mapInArrow(_fingerprints(shingle), "_id long, fp long"))
    # classes are named by their fingerprints, as equal ids may have different texts
    classes = cut(prints.groupBy("fp").agg(F.min("_id").alias("least")))
    found = components(fingerprint_links(classes.where("least is not null").select("fp", F.col("fp").alias("rep")), radius))
    named = cut(classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    firsts = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(named.join(firsts, "component").select("fp", "component_id"))
    return prints.join(named, "fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _texts(shingle: int):
    """Fingerprint and a digest of the words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_column(batch, "_text")
            values = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            digests = [_words_digest(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), pa.array(digests, pa.binary())], names=["_id", "fp", "digest"])

    return run


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, of the whole sequence if it is shorter."""
    import xxhash

    w = (text or b"").lower().split()
    return np.unique(np.array([xxhash.xxh3_64_intdigest(b" ".join(w[k : k + words])) for k in range(max(1, len(w) - words + 1))], np.uint64))


def _words_digest(text: bytes | None) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join((text or b"").lower().split()))


def _sets(words: int):
    """Shingles of the rows whose words are those of their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, digests = binary_column(batch, "_text"), batch.column(1).to_pylist()
            own = [k for k, t in enumerate(texts) if _words_digest(t) == digests[k]]
            got = [shingle_set(texts[k], words) for k in own]
            lists = [pa.array([f(x).tobytes() for x in got], pa.binary()) for f in (np.asarray, shingle_counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), *lists], names=["rep", "s", "counts"])

    return run


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return run


def verified_groups(docs: DataFrame, shingle: int = 2, radius: int = 10, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for every row of docs with a doc_id: groups of texts that are nearly equal.

    Texts with the same words are one class. Fingerprints within the radius propose links; a link stands if the texts' sets of
    `words`-word shingles have a Jaccard similarity of `similarity` at least. Forests of proposed links, the nearest first, are verified at once. Of the pairs that they leave out, all
    whose ends are then in different groups are verified too, so that each proposed pair is confirmed, refuted or
    inside a group. Only texts that some link proposes are fetched for this. Short fingerprint shingles keep texts of
    similarity 0.8 near each other, about 5 bits apart. Null and empty texts are one class without words; rows of one
    id may have different texts, each of its own class.
    """
    prepare(docs.sparkSession)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    prints = cut(rows.mapInArrow(_texts(shingle), "_id long, fp long, digest binary"))
    # a class is named by a number of its own, as equal ids may have different texts
    classes = cut(prints.groupBy("fp", "digest").agg(F.min("_id").alias("least")).withColumn("rep", F.xxhash64("digest")))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    proposed = cut(fingerprint_links(classes, radius, forests=FORESTS, spares=True).select(*ordered).distinct())
    nearest, spare = proposed.where("a <> b"), proposed.where("a = b").select(F.col("a").alias("rep"))
    # both ends of a spare pair have links in the forests
    ends = nearest.select(F.explode(F.array("a", "b")).alias("_rep")).distinct()
    # one row of each class, found by its words: texts are streamed past the classes, not sorted
    wanted = classes.join(ends, F.col("rep") == F.col("_rep"), "left_semi").select("rep", F.col("least").alias("_least"), "digest")
    texts = rows.join(wanted.hint("shuffle_hash"), F.col("_id") == F.col("_least"))
    sets = cut(texts.select("rep", "digest", "_text").mapInArrow(_sets(words), "rep long, s binary, counts binary").groupBy("rep").agg(F.first("s").alias("s"), F.first("counts").alias("counts")))

    def confirmed(links: DataFrame) -> DataFrame:
        pairs = links.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("y")), "b")
        return cut(pairs.select("a", "b", "x", "y").mapInArrow(_similar(similarity), "a long, b long"))

    links = confirmed(nearest)
    found = components(links).withColumnRenamed("node", "rep")
    apart = classes.join(spare, "rep", "left_semi").join(found, "rep", "left").join(sets.select("rep", (F.octet_length("s") / 8).cast("int").alias("size"), "counts"), "rep")
    apart = cut(apart.select("fp", "rep", F.coalesce("component", "rep").alias("group"), "size", "counts"))
    rest = cut(fingerprint_links(apart, radius, forests=None, similarity=similarity).select(*ordered).where("a <> b").distinct())
    rest = rest.join(nearest, ["a", "b"], "left_anti")
    found = components(links.unionByName(confirmed(rest))).withColumnRenamed("node", "rep")
    named = cut(classes.join(found, "rep", "left").select("rep", "least", F.coalesce("component", "rep").alias("component")))
    firsts = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(firsts, "component").select("rep", "component_id")
    return prints.withColumn("rep", F.xxhash64("digest")).join(named, "rep").select(F.col("_id").alias("doc_id"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 2, radius: int = 10, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that represent their group: the one with the group's smallest doc_id; null ids stay.

    Of several rows with that id, the one whose words come first by digest stays, or one of equal rows. Null and empty
    texts are one group. All columns of docs are kept as they are, whatever their names.
    """
    groups = verified_groups(docs, shingle, radius, words, similarity)
    keep = groups.where("doc_id = component_id").select(F.col("doc_id").alias("keep")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row"))
    kept = rows.where("id is not null").join(keep.hint("shuffle_hash"), F.col("id") == F.col("keep"), "left_semi")
    # an id that stands once, as ids do, needs no choice
    twice = cut(docs.select(F.col("doc_id").cast("long").alias("more")).where("more is not null").groupBy("more").agg(F.count("*").alias("n")).where("n > 1").select("more"))
    if not twice.isEmpty():
        several = kept.join(twice, F.col("id") == F.col("more"), "left_semi")
        first = several.groupBy("id").agg(F.min_by("row", F.struct(F.md5(F.coalesce(F.col("row.text"), F.lit(""))), F.xxhash64("row.text"))).alias("row"))
        kept = kept.join(twice, F.col("id") == F.col("more"), "left_anti").unionByName(first)
    return kept.select("row.*").unionByName(rows.where("id is null").select("row.*"))

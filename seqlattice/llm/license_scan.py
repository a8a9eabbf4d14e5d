"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

Blocks are overlapping windows over a document's words, twice as long as the template and half a window apart, so that
every stretch as long as the template lies in one of them, wherever lines end. A block's tokens are its distinct words
among the templates', ordered by document frequency over all documents, rarest first. Block B meets template T if
|B n T| >= c = ceil(threshold |T|) and B holds every number of T (a version decides the license). Then the first common
token stands among the first |T| - c + 1 tokens of T and the first |B| - c + 1 of B (prefix filter), B has c tokens at
least (length filter; above, it is bounded by the window), and c - 1 tokens are left behind the common one on either
side (positional filter). Only what passes is verified. The templates are a fixed table and broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlattice.llm.common import prepare

#: Words that must follow each other, and the label they give.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Wording of notices, and the label each gives. Of five different words at least: fewer meet in prose by chance.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license as published by the free software foundation either version 3": "gpl-3",
    "gnu general public license as published by the free software foundation either version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons attribution noncommercial 4 0": "cc-by-nc",
    "creative commons attribution sharealike 4 0": "cc-by-sa",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "copyright c all rights reserved": "proprietary",
}
THRESHOLD = 0.9
#: Not in words: ASCII that is neither digit nor letter. Words of lower-cased text are the stretches between.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words by splitting at the gaps; matching the words themselves, a negated class, takes ten times as long."""
    return F.array_remove(F.split(text, GAP), "")


def tokens(text: Column) -> Column:
    return words_of(lowered(text))


def may_hold(low: Column, sets: list[list[str]]) -> Column:
    """Whether lower-cased text holds, as parts, all words of some set: plain substring search, the longest words first.

    lower() keeps every ASCII letter, so that nothing is lost; what passes is decided exactly after.
    """
    every = [reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in sorted(set(ws), key=lambda w: (-len(w), w))]) for ws in sets]
    return reduce(lambda a, b: a | b, every)


def token_order(docs: DataFrame, text: Column, templates: Mapping[str, str]) -> list[str]:
    """The templates' tokens by the number of documents that hold them, rarest first; ties by name. Counts cover all documents."""
    vocabulary = sorted({w for t in templates for w in t.split()})
    # lower() differs from lowered() only outside ASCII; it orders tokens here and decides no match
    held = F.array_intersect(F.split(F.lower(text), GAP), F.array(*[F.lit(w) for w in vocabulary]))
    counts = {r.w: r.n for r in docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row for each template token
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def block_matches(rows: DataFrame, order: list[str], templates: Mapping[str, str], threshold: float) -> DataFrame:
    """(_id, _print, label, containment) of every block of rows (_id, _print, _text) that meets a template."""
    spark = rows.sparkSession
    rank = {w: k for k, w in enumerate(order)}
    sets = [(label, len(t.split()), sorted(set(t.split()), key=rank.get)) for t, label in templates.items()]
    prefixes = []
    for label, length, own in sets:
        need = math.ceil(threshold * len(own) - 1e-9)
        prefixes += [(own[k], label, length, k, len(own), need, own, [w for w in own if w.isdigit()]) for k in range(len(own) - need + 1)]
    table = F.broadcast(spark.createDataFrame(prefixes, "token string, label string, length int, tpos int, tsize int, need int, tset array<string>, numbers array<string>"))
    tokens_ahead = sorted({x[0] for x in prefixes})
    some = f"(?i)(?<!{WORD})(?:{'|'.join(tokens_ahead)})(?!{WORD})"
    reach = 2 * max(length for _, length, _ in sets)
    # each place of a prefix token, with the words around it that any block with it may hold: bounded, however long the text
    ahead = F.array(*[F.lit(w) for w in tokens_ahead])

    def near(w: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_contains(ahead, F.get(w, i)))
        around = lambda i: F.slice(w, F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach))
        return F.transform(at, lambda i: F.struct(F.get(w, i).alias("token"), i.alias("at"), F.least(i, F.lit(reach)).alias("before"), around(i).alias("around")))

    places = F.element_at(F.transform(F.array(tokens(F.col("_text"))), near), 1)
    hits = rows.where(F.col("_text").rlike(some)).select("_id", "_print", F.explode(places).alias("x")).select("_id", "_print", "x.*")
    met = hits.join(table, "token")
    # the two blocks of the template's length that hold the place
    last = F.floor(F.col("at") / F.col("length")).cast("int") * F.col("length")
    met = met.withColumn("from", F.explode(F.filter(F.array(last - F.col("length"), last), lambda x: x >= 0)))
    block = F.slice("around", F.col("from") - F.col("at") + F.col("before") + 1, F.col("length") * 2)
    met = met.select("_id", "_print", "label", "token", "tpos", "tsize", "need", "tset", "numbers", F.array_intersect(F.array(*[F.lit(w) for w in order]), block).alias("b"))
    behind = F.least(F.col("tsize") - F.col("tpos"), F.size("b") - F.array_position("b", F.col("token")) + 1)
    met = met.where((F.size("b") >= F.col("need")) & (behind >= F.col("need")))
    overlap = F.size(F.array_intersect("b", "tset"))
    met = met.withColumn("overlap", overlap).where((F.col("overlap") >= F.col("need")) & (F.size(F.array_except("numbers", "b")) == 0))
    return met.select("_id", "_print", "label", (F.col("overlap") / F.col("tsize")).alias("containment"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    n_base counts the places where a phrase's words stand consecutively, first_word and last_word are the smallest and
    largest of these (words from 0; null without any), base_labels are their labels; labels has the labels of
    the templates that some block meets too. score is 1 with a base phrase, else the greatest containment that meets the threshold, else 0. A null text
    is empty. Null ids and repeated rows pass through. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumn("_print", F.xxhash64("_text"))
    order = token_order(docs, F.col(text_col).cast("string"), templates)
    labels = block_matches(rows, order, templates, threshold).groupBy("_id", "_print").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    labels = labels.select(F.col("_id").alias("_i"), F.col("_print").alias("_p"), "found", "best")

    split = {p: p.split() for p in phrases}
    any_phrase = f"(?i)(?<!{WORD})(?:{'|'.join(GAP.join(w) for w in split.values())})(?!{WORD})"
    rows = rows.withColumn("_low", F.lower("_text"))
    words = F.when(may_hold(F.col("_low"), list(split.values())) & F.col("_text").rlike(any_phrase), tokens(F.col("_text"))).otherwise(F.array().cast("array<string>"))
    base = rows.select("_id", "_print", F.size(words_of(F.col("_text"))).cast("long").alias("n_words"), words.alias("w"))

    def places(phrase: list[str]) -> Column:
        first = F.sequence(F.lit(0), F.size("w") - len(phrase))

        def here(i):
            found = F.get("w", i) == phrase[0]
            for k in range(1, len(phrase)):
                found = found & (F.get("w", i + k) == phrase[k])
            return found

        return F.when(F.size("w") >= len(phrase), F.filter(first, here)).otherwise(F.array().cast("array<int>"))

    for k, w in enumerate(split.values()):
        base = base.withColumn(f"p{k}", places(w))
    base = base.drop("w")
    every = F.concat(*[F.col(f"p{k}") for k in range(len(split))])
    named = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())]))
    base = base.select("_id", "_print", "n_words", every.alias("at"), F.array_distinct(named).alias("named"))
    both = base.join(labels, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_print") == F.col("_p")), "left")
    merged = F.array_union("named", F.coalesce("found", F.array().cast("array<string>")))
    return both.select(
        F.col("_id").alias(id_col), "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("named"), ",").alias("base_labels"), F.array_join(F.array_sort(merged), ",").alias("labels"),
        F.when(F.size("named") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )

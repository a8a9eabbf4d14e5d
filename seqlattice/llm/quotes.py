"""Quotation linking in conversations, in DataFrame functions only.

A line's quote level is the number of `>` marks before its text. Lines of level 0 are the message; lines above it are
passages quoted from other messages. A quoted passage (one line, marks stripped, white space collapsed, A-Z in lower
case) is hashed and joined to the first message whose own lines hold it. The message that most of the lowest-level
passages come from is the one replied to; replies of replies form threads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlattice.llm.common import cut, prepare

MARKS = r"^[ \t]*(?:>[ \t]?)+"
#: Characters that a passage has at least, to be linked to another conversation; within its own any passage is evidence.
LEAST_CHARS = 10


def level_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normal(line: Column) -> Column:
    """A passage without marks, ASCII white space collapsed, A-Z in lower case."""
    plain = F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"[\x20\x09-\x0D]+", " ")
    return F.translate(F.trim(plain), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """Every row of messages without quotes: (conv_id, turn, role, text, n_quoted, max_level, n_linked, reply_conv, reply_turn, thread_conv, thread_turn, depth).

    reply_conv and reply_turn name the message replied to, null without a linked passage; a passage is looked for in
    the own conversation's earlier turns first, then, if it has least_chars characters, in the first message anywhere
    that holds it. A mark without text quotes nothing. thread_conv,
    thread_turn and depth follow replies to their root, the message itself if it replies to none, so that (thread_conv,
    thread_turn, depth, conv_id, turn) is the reply order. A null text stays null and quotes nothing; rows with a null
    conv_id or turn keep their text, link to nothing and are linked by nothing. Repeated rows are repeated. Replies
    in a circle, possible between conversations only, have a null thread. Other columns are ignored.
    """
    prepare(messages.sparkSession)
    rows = messages.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), F.col(role_col).alias("role"), F.col(text_col).cast("string").alias("text"))
    lines = F.split("text", "\n")
    quoted = F.coalesce(F.col("text").rlike(r"(?m)^[ \t]*>"), F.lit(False))
    own = F.when(quoted, F.filter(lines, lambda x: level_of(x) == 0))
    levels = F.when(quoted, F.transform(lines, level_of))
    clean = rows.select(
        "c", "t", "role", F.when(quoted, F.array_join(own, "\n")).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.size(F.filter(levels, lambda x: x > 0)), F.lit(0)).cast("long").alias("n_quoted"), F.coalesce(F.array_max(levels), F.lit(0)).alias("max_level"),
    )
    clean = clean.withColumn("n_quoted", F.greatest("n_quoted", F.lit(0)))
    valid = rows.where("c is not null and t is not null")
    passages = valid.where(quoted).select("c", "t", F.explode(F.filter(lines, lambda x: level_of(x) > 0)).alias("line"))
    passages = passages.select("c", "t", level_of(F.col("line")).alias("level"), normal(F.col("line")).alias("p")).where("p <> ''")
    long = (F.length("p") >= least_chars).alias("long")
    passages = cut(passages.groupBy("c", "t", F.xxhash64("p").alias("h"), F.md5("p").alias("m"), long).agg(F.min("level").alias("level")))
    wanted = passages.select("h", "m").distinct()
    lines_of = valid.select("c", "t", F.explode(F.filter(lines, lambda x: level_of(x) == 0)).alias("line")).select("c", "t", normal(F.col("line")).alias("p"))
    lines_of = lines_of.where("p <> ''").select("c", "t", F.xxhash64("p").alias("h"), F.md5("p").alias("m"))
    # originals shrink to the wanted passages, then to the first message of each, before they meet the quotes
    originals = cut(lines_of.join(wanted, ["h", "m"], "left_semi").groupBy("c", "h", "m").agg(F.min("t").alias("ot")))
    anywhere = originals.groupBy("h", "m").agg(F.min(F.struct(F.col("c").alias("gc"), F.col("ot").alias("gt"))).alias("g")).select("h", "m", "g.*")
    linked = passages.join(originals, ["c", "h", "m"], "left").join(anywhere, ["h", "m"], "left")
    inside = F.col("ot") < F.col("t")
    outside = F.col("long") & (F.col("gc") != F.col("c"))
    linked = linked.select("c", "t", "level", F.when(inside, F.col("c")).when(outside, F.col("gc")).alias("rc"), F.when(inside, F.col("ot")).when(outside, F.col("gt")).alias("rt")).where("rc is not null")
    votes = linked.groupBy("c", "t", "rc", "rt").agg(F.min("level").alias("level"), F.count("*").alias("n"))
    best = votes.groupBy("c", "t").agg(F.min(F.struct(F.col("level"), (-F.col("n")).alias("n"), (F.col("rc") != F.col("c")).alias("far"), (-F.col("rt")).alias("rt"), F.col("rc"))).alias("b"), F.sum("n").alias("n_linked"))
    replies = cut(best.select("c", "t", "n_linked", F.col("b.rc").alias("rc"), (-F.col("b.rt")).alias("rt")))
    threads = _roots(replies)
    a = clean.join(replies, ["c", "t"], "left").join(threads, ["c", "t"], "left")
    no_reply = F.col("rc").isNull()
    return a.select(
        F.col("c").alias("conv_id"), F.col("t").alias("turn"), "role", "text", "n_quoted", F.col("max_level").cast("long").alias("max_level"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("rc").alias("reply_conv"), F.col("rt").alias("reply_turn"), F.when(no_reply, F.col("c")).otherwise(F.col("root_c")).alias("thread_conv"),
        F.when(no_reply, F.col("t")).otherwise(F.col("root_t")).alias("thread_turn"), F.when(no_reply, F.lit(0)).otherwise(F.col("depth")).cast("long").alias("depth"),
    )


def _roots(replies: DataFrame) -> DataFrame:
    """(c, t, root_c, root_t, depth) of every reply, by pointer doubling over replies alone; circles are left out."""
    up = replies.select("c", "t", F.col("rc").alias("root_c"), F.col("rt").alias("root_t"), F.lit(1).cast("long").alias("depth"))
    most = replies.count()
    span, before = 1, None
    while span <= most:
        nxt = up.select(F.col("c").alias("root_c"), F.col("t").alias("root_t"), F.col("root_c").alias("nc"), F.col("root_t").alias("nt"), F.col("depth").alias("nd"))
        up = cut(
            up.join(nxt, ["root_c", "root_t"], "left").select(
                "c", "t", F.coalesce("nc", "root_c").alias("root_c"), F.coalesce("nt", "root_t").alias("root_t"), (F.col("depth") + F.coalesce("nd", F.lit(0))).alias("depth")
            )
        )
        span *= 2
        now = up.agg(F.sum("depth")).first()[0]
        if now == before:
            break
        before = now
    return up.join(replies.select(F.col("c").alias("root_c"), F.col("t").alias("root_t")), ["root_c", "root_t"], "left_anti").select("c", "t", "root_c", "root_t", "depth")

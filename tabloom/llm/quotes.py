"""Quotation linking: who answers whom, by the passages a message quotes.

A line that starts with n marks `>` is a quotation of level n. Neighbouring lines of one level are a passage; it and its
lines, normalised (A-Z lower-cased, white space collapsed) and hashed, are joined to the passages and
lines that messages of the same conversation wrote themselves. A message answers the message it
quotes; the chain of quotations leads to its root. Ordered by root and turn, every message comes after
the one it answers and next to the others of its thread.

A conversation may hold a third of all rows, so nothing is gathered or ranked by conversation: joins
are on (conversation, hash) and (conversation, turn), chains are followed by pointer doubling, and
the order is a range partitioning that can cut a conversation in two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import cut

MARKS = r"^(?:[ \t]*>)+"
SPACE = r"[\x20\x09-\x0D]+"


def _normal(line: Column) -> Column:
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, SPACE, " "))


def passages(text: str = "text") -> Column:
    """Array of (level, lines): runs of lines of one level, each line normalised and without its marks;
    empty lines are left out and end no run. Level 0 is what the message says itself."""

    def line(x: Column) -> Column:
        return F.struct(F.regexp_count(F.regexp_extract(x, MARKS, 0), F.lit(">")).alias("level"), _normal(F.regexp_replace(x, MARKS, "")).alias("line"))

    every = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), line), lambda x: x["line"] != "")
    numbers = lambda lines: F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines))).otherwise(F.array().cast("array<int>"))
    level = lambda lines, i: F.element_at(lines, i)["level"]

    def cut_at(lines: Column, starts: Column) -> Column:
        end = lambda k: F.coalesce(F.try_element_at(starts, k + 2), F.size(lines) + 1)
        run = lambda i, k: F.struct(level(lines, i).alias("level"), F.transform(F.slice(lines, i, end(k) - i), lambda x: x["line"]).alias("lines"))
        return F.transform(starts, run)

    def runs(lines: Column) -> Column:
        starts = F.filter(numbers(lines), lambda i: (i == 1) | (level(lines, i) != level(lines, F.greatest(i - 1, F.lit(1)))))
        return bound(starts, lambda s: cut_at(lines, s))

    # An array of one element gives what is used several times a name, so each text is split once, in linear time.
    bound = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    return bound(every, runs).cast("array<struct<level:int,lines:array<string>>>")


def own_text(text: str = "text") -> Column:
    """The lines of a text that are no quotation, with the marks of none."""
    return F.trim(F.array_join(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: ~x.rlike(MARKS)), "\n"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content, n_quotes, n_linked, quoted_turn, reply_to, root, depth) for every row
    of messages, in the order of conv_id, root and turn.

    content is the text without quotations; n_quotes is the number of quoted passages, n_linked of
    those found in an earlier turn. A passage or line belongs to the first turn of the conversation
    that says it. quoted_turn is the turn that the lowest level quotes most of (by length of
    what is found; ties: the later turn); reply_to is that turn, or else the turn before if there is one.
    root is the end of the chain of quoted turns, depth its length; a message that quotes nothing known is
    its own root. Rows that share conv_id and turn are one message in all links. Null texts are empty;
    rows without conv_id or turn link with nothing (root null, depth 0). An empty table gives no rows.
    """
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", own_text().alias("content"), passages().alias("_p"))
    rows = rows.withColumn("n_quotes", F.size(F.filter("_p", lambda p: p["level"] > 0)).cast("long"))
    placed = messages.where("conv_id is not null and turn is not null")
    known = placed.select("conv_id", F.col("turn").cast("long").alias("turn"), F.posexplode(passages()).alias("n", "p"))
    whole = F.array_join("p.lines", " ")
    pieces = known.select("conv_id", "turn", "n", F.col("p.level").alias("level"), F.explode(F.array_distinct(F.concat(F.array(whole), F.col("p.lines")))).alias("piece"))
    pieces = pieces.select("conv_id", "turn", "n", "level", F.xxhash64("piece").alias("hash"), F.length("piece").cast("long").alias("size"))

    # One row for each quoted piece, and only the originals that are quoted.
    quoted = pieces.where("level > 0")
    wanted = quoted.select("conv_id", "hash").distinct()
    said = pieces.where("level = 0").join(wanted, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    hits = cut(quoted.join(said, ["conv_id", "hash"]).where("origin < turn"))
    found = hits.groupBy("conv_id", "turn").agg(F.count_distinct("n", "level").alias("n_linked"))
    # A piece that a message quotes twice counts once.
    each = hits.groupBy("conv_id", "turn", "level", "origin", "hash").agg(F.max("size").alias("size"))
    each = each.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("size").alias("size"))
    best = each.groupBy("conv_id", "turn").agg(F.min(F.struct("level", -F.col("size"), -F.col("origin"))).alias("b"))
    links = best.select("conv_id", "turn", (-F.col("b.col3")).alias("quoted_turn"))

    # Pointer doubling: `up` is an ancestor at distance d, until it is the end of the chain.
    chain = cut(links.select("conv_id", "turn", F.col("quoted_turn").alias("up"), F.lit(1).cast("long").alias("d")))
    while not chain.isEmpty():
        above = chain.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("_up"), F.col("d").alias("_d"))
        chain = cut(chain.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("_up", "up").alias("up"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"), F.col("_up").isNotNull().alias("moved")))
        if chain.where("moved").isEmpty():
            break
        chain = chain.drop("moved")

    follows = placed.select("conv_id", (F.col("turn").cast("long") + 1).alias("turn")).distinct().withColumn("_follows", F.lit(True))
    facts = links.join(found, ["conv_id", "turn"]).join(chain.select("conv_id", "turn", "up", "d"), ["conv_id", "turn"])
    out = rows.join(facts, ["conv_id", "turn"], "left").join(follows, ["conv_id", "turn"], "left")
    before = F.when(F.col("_follows"), F.col("turn") - 1)
    out = out.select(
        "conv_id", "turn", "role", "content", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "quoted_turn",
        F.coalesce("quoted_turn", before).alias("reply_to"), F.when(F.col("conv_id").isNotNull(), F.coalesce("up", "turn")).alias("root"), F.coalesce("d", F.lit(0)).cast("long").alias("depth"),
    )
    return out.repartitionByRange("conv_id", "root", "turn", "content").sortWithinPartitions("conv_id", "root", "turn", "role", "content")

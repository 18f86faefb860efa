"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, target / size of the source.
Laid end to end in a fixed order, the prefix sum of the document of rank k ends at k times that
number; with one random offset per source, a document is emitted once for each integer boundary its
stretch crosses.  Ordering by size makes the sample balanced on size, so the words taken come near
the target, not only the number of documents.

The rank needs no window over a source, which may hold a third of all rows: rows are counted by (source, size) and by
buckets of the tie-breaking digest within those; prefix sums run over the counts, and row_number only within a bucket.
Buckets that rows without id, or with one and the same, would overfill are dealt out again by a digest of the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
BUCKET_ROWS = 400


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code-point order, null last, take the weights in turn. Every target is
    min(most * size, weight * level), with the one level at which the targets share the sum of all
    sizes: sources are capped in the order of most * size / weight, so prefix sums give the level. It is
    that of the first source that stays below its cap; later ones would give smaller levels.
    These windows run over one row per source, not over documents.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "source", "source_size", "weight", "cap",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weights"),
        F.sum("source_size").over(every).alias("total"),
    )
    level = (F.col("total") - F.col("capped")) / F.col("weights")  # if this source and those after it are uncapped
    rows = rows.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    rows = rows.withColumn("level", F.max("level").over(every))
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"))


def offset(source: str = "source", seed: str = "mix") -> Column:
    """The random offset of a source, in [0, 1): 32 bits of a digest, the same in every run."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(source), F.lit("\x00"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: str = "mix", sized: bool = False
) -> DataFrame:
    """All columns of docs, then size, source_size, target, copies and taken (copies * size). With sized, docs has the
    sizes in a column size and a hash of the text in spread, and the text isn't read.

    Every row is returned, with copies 0 where the mix leaves it out. A null text has size 0; a null
    source is a source of its own, ordered last; null and repeated doc_ids are rows like any others
    (equal rows are interchangeable). Columns of docs with one of these names are replaced. An empty
    table gives no rows.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in docs.columns if c not in made]
    quoted = [F.col(f"`{c}`") for c in kept]
    # What ranks a row, apart from the columns of docs, whose names may be anything. The source's key is never null, so
    # windows and joins on it share one shuffle.
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    size, more = (F.col("size").cast("long"), F.col("spread")) if sized else (word_count(), F.xxhash64("text"))
    facts = F.struct(key.alias("key"), size.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("tie"), F.col("doc_id").alias("id"), more.alias("more"))
    rows = docs.select(F.struct(*quoted).alias("_row"), facts.alias("f")).select("_row", "f.*")
    total = docs.count()
    digits = max(0, min(8, math.ceil(math.log(max(1, total) / BUCKET_ROWS, 16))))
    rows = rows.withColumn("bucket", F.substring("tie", 1, digits))
    # One row for each (source, size, bucket) that occurs.
    counted = cut(rows.groupBy("key", "size", "bucket").agg(F.count("*").alias("n")))
    whole = counted.groupBy("key", "size").agg(F.sum("n").alias("n"))
    source = F.when(F.col("key") != "n", F.expr("substring(key, 2)"))
    sizes = whole.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).select(source.alias("source"), "source_size")
    targets = source_targets(sizes, weights, most).withColumn("u", offset("source", seed))
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), "source_size", "target", "u")
    overfull = [r.bucket for r in counted.where(F.col("n") > 20 * BUCKET_ROWS).select("bucket").distinct().limit(1_000).collect()]
    if overfull:
        rows = rows.withColumn("deal", F.when(F.col("bucket").isin(overfull), F.pmod(F.xxhash64("more"), F.lit(256)).cast("int")).otherwise(F.lit(0)))
        counted = cut(rows.groupBy("key", "size", "bucket", "deal").agg(F.count("*").alias("n")))
    else:
        rows, counted = rows.withColumn("deal", F.lit(0)), counted.withColumn("deal", F.lit(0))

    sizes_before = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("key", "size", F.coalesce(F.sum("n").over(sizes_before), F.lit(0)).alias("outer"))
    buckets_before = Window.partitionBy("key", "size").orderBy("bucket", "deal").rowsBetween(Window.unboundedPreceding, -1)
    inner = counted.select("key", "size", "bucket", "deal", F.coalesce(F.sum("n").over(buckets_before), F.lit(0)).alias("inner"))
    place = inner.join(before, ["key", "size"]).select("key", "size", "bucket", "deal", (F.col("inner") + F.col("outer")).alias("before"))
    within = Window.partitionBy("key", "size", "bucket", "deal").orderBy("tie", "id", "more")
    ranked = rows.withColumn("rank", F.row_number().over(within))
    joined = ranked.join(place, ["key", "size", "bucket", "deal"]).select("_row", "key", "size", (F.col("rank") + F.col("before")).alias("k"))
    joined = joined.join(targets, "key")  # a row for each source, small enough for Spark to broadcast
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("step", step)
    # Whole steps are counted apart, in whole numbers; boundaries only see what is left, below one copy.
    part = F.col("step") - F.floor("step")
    crossed = F.floor(F.col("u") + part * F.col("k")) - F.floor(F.col("u") + part * (F.col("k") - 1))
    out = joined.withColumn("copies", (F.floor("step") + F.least(crossed, F.lit(1))).cast("long"))
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in kept), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each document of a mix as often as the mix takes it, with the number of the copy, from 1, in `copy`; a column of
    that name is replaced. Documents that the mix leaves out, and an empty table, give no rows."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))

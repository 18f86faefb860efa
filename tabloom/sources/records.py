"""Records of delimited files whose quoted fields may hold line breaks, from ranges of the files in parallel.

Where a range of a file begins, one cannot see whether that is within quotes. So each range first says what it ends in for
both beginnings; the ranges' answers, put together in the order of the file, give each range's true beginning; then
each range cuts its own records. What a range begins of a record that it doesn't end is joined with the stretches of the next ones.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'


def quoted_after(line: str, quoted: bool, delimiter: str) -> bool:
    """Whether a line that begins within quotes or not ends within them. A quote opens where a field begins only; within quotes
    two stand for one, and behind the closing one the rest of the field is plain."""
    at = 0
    while True:
        if not quoted:
            if not line.startswith(QUOTE, at):
                at = line.find(delimiter, at)
                if at < 0:
                    return False
                at += len(delimiter)
                continue
            at += 1
        while (at := line.find(QUOTE, at)) >= 0 and line.startswith(QUOTE, at + 1):
            at += 2
        if at < 0:
            return True
        at = line.find(delimiter, at + 1)
        if at < 0:
            return False
        at, quoted = at + len(delimiter), False


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, range, line): lines by line feed, in order within a range, a stretch of a file that one task reads."""
    raw = spark.read.option("lineSep", "\n").text(path)
    line = F.col("value") if encoding.upper().replace("-", "") in ("UTF8", "ASCII") else F.decode(F.col("value").cast("binary"), encoding)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), line.alias("line"))


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """((file, range), lines) of a batch, in order."""
    files, starts, lines = (batch.column(k).to_pylist() for k in range(3))
    key = list(zip(files, starts, strict=True))
    cuts = [0, *(k for k in range(1, len(key)) if key[k] != key[k - 1]), len(key)]
    for s, e in zip(cuts, cuts[1:], strict=False):
        if e > s:
            yield key[s], lines[s:e]


def _ends(lines: DataFrame, delimiter: str) -> DataFrame:
    """(file, range, ends, breaks): whether each range ends within quotes when it begins outside (1) and inside (2), as two bits,
    and whether any of its lines does in the first case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, outside, inside, breaks = None, False, True, False

        def row() -> pa.RecordBatch:
            made = [[now[0]], [now[1]], [int(outside) + 2 * int(inside)], [breaks]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, (pa.string(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], names=["file", "range", "ends", "breaks"])

        for batch in batches:
            for key, some in _stretches(batch):
                if key != now:
                    if now:
                        yield row()
                    now, outside, inside, breaks = key, False, True, False
                for line in some:
                    if QUOTE in line:
                        # Both go on alike from where they meet.
                        same = outside == inside
                        outside = quoted_after(line, outside, delimiter)
                        inside = outside if same else quoted_after(line, inside, delimiter)
                        breaks = breaks or outside
        if now:
            yield row()

    return lines.mapInArrow(run, "file string, range long, ends int, breaks boolean")


def beginnings(ends: DataFrame) -> DataFrame:
    """ends with `inside`, whether the range begins within quotes: the last range before that ends alike whatever its beginning
    says what the next one begins with, and those since that turn it round do so in pairs."""
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    turned = F.coalesce(F.sum((F.col("ends") == 1).cast("int")).over(before), F.lit(0))
    fixed = F.when(F.col("ends").isin(0, 3), F.struct((F.col("ends") == 3).cast("int").alias("value"), F.col("turned").alias("turned")))
    last = F.last(fixed, ignorenulls=True).over(before)
    since = F.coalesce(last["value"], F.lit(0)) + F.col("turned") - F.coalesce(last["turned"], F.lit(0))
    return ends.withColumn("turned", turned).withColumn("inside", since % 2 == 1).drop("turned")


#: What a row of `_cut` is: a record, or of a record in several ranges its beginning, a whole range, or its end.
WHOLE, BEGINS, WITHIN, ENDS = range(4)


def _cut(lines: DataFrame, delimiter: str, inside) -> DataFrame:
    """(file, range, number, part, text): each range's records, and stretches of records that cross ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, quoted, part, number = None, [], False, WHOLE, 0
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["file", "range", "number", "part", "text"])

        def close(kind: int) -> None:
            nonlocal held, number
            out.append((*now, number, kind, "\n".join(held)))
            held, number = [], number + 1

        def leave() -> None:
            if held:
                close(WITHIN if part == ENDS else BEGINS)

        for batch in batches:
            for key, some in _stretches(batch):
                if key != now:
                    leave()
                    now, number = key, 0
                    quoted = key[1] in inside.value.get(key[0], ())
                    part = ENDS if quoted else WHOLE
                for line in some:
                    held.append(line)
                    if QUOTE in line:
                        quoted = quoted_after(line, quoted, delimiter)
                    if not quoted:
                        close(part)
                        part = WHOLE
                    if len(out) >= 10_000:
                        yield made()
                        out = []
        if now:
            leave()
        if out:
            yield made()

    return lines.mapInArrow(run, "file string, range long, number long, part int, text string")


def _joined(cut: DataFrame) -> DataFrame:
    """Records, those of several ranges put together."""
    order = Window.partitionBy("file").orderBy("range", F.desc("part"))
    parts = cut.where(F.col("part") != WHOLE).withColumn("record", F.sum((F.col("part") == BEGINS).cast("int")).over(order))
    pieces = F.sort_array(F.collect_list(F.struct("range", "part", "number", "text")))
    whole = parts.groupBy("file", "record").agg(pieces.alias("p")).select("file", F.col("p")[0]["range"].alias("range"), F.col("p")[0]["number"].alias("number"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return cut.where(F.col("part") == WHOLE).select("file", "range", "number", "text").unionByName(whole)


def _names(header: str, delimiter: str) -> list[str]:
    """Column names of the header's record; repeated ones are numbered, and empty ones called by their place."""
    out: list[str] = []
    for k, name in enumerate(next(csv.reader([header.removeprefix("﻿")], delimiter=delimiter))):
        name = name.rstrip("\r") or f"Unnamed: {k}"
        again = 0
        while (f"{name}.{again}" if again else name) in out:
            again += 1
        out.append(f"{name}.{again}" if again else name)
    return out


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Rows of a delimited file, or of a folder of files with a header each, as strings. Quoted fields may hold delimiters, doubled
    quotes and line breaks; a record may cross any number of ranges. Blank lines are skipped; of records with too few
    fields the rest is null, and fields beyond the header's are left out. A quote that nothing closes goes on to the file's end. Files
    in an encoding of two bytes a character must not have line breaks in fields.

    Where no line break is quoted Spark's own reader takes the lines. Otherwise the places of the ranges that begin within
    quotes, eight bytes each, go to the tasks."""
    wide = encoding.upper().startswith(("UTF-16", "UTF-32", "UTF16", "UTF32"))
    options = {"sep": delimiter, "quote": QUOTE, "escape": QUOTE, "encoding": encoding}
    if wide:
        return spark.read.csv(path, header=True, inferSchema=False, **options)
    lines = _lines(spark, path, encoding)
    ends = beginnings(_ends(lines, delimiter)).cache()
    try:
        breaks = ends.where("breaks OR inside").limit(1).count()
        starts: dict[str, list[int]] = {}
        for row in ends.where("inside").select("file", "range").toLocalIterator():
            starts.setdefault(row.file, []).append(row.range)
    finally:
        ends.unpersist()
    inside = spark.sparkContext.broadcast({f: set(s) for f, s in starts.items()})
    first = lines.where("range = 0")
    heads = _joined(_cut(lines, delimiter, inside)) if breaks else first.select("file", "range", F.monotonically_increasing_id().alias("number"), F.col("line").alias("text"))
    filled = F.regexp_replace("text", "[\r\n]", "") != ""
    top = heads.where((F.col("range") == 0) & filled).groupBy("file").agg(F.min_by("text", "number").alias("text"), F.min("number").alias("number"))
    header = top.orderBy("file").first()
    if header is None:
        raise ValueError(f"no columns in {path}")
    names = _names(header.text, delimiter)
    schema = T.StructType([T.StructField(f"_{k}", T.StringType()) for k in range(len(names))])
    if not breaks:
        rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=True, **options)
    else:
        records = heads.join(top.select("file", F.lit(0).cast("long").alias("range"), "number"), ["file", "range", "number"], "left_anti")
        text = F.regexp_replace("text", "\r$", "")
        rows = records.where(filled).select(F.from_csv(text, schema.simpleString()[7:-1].replace(":", " "), {"sep": delimiter, "quote": QUOTE, "escape": QUOTE}).alias("_r")).select("_r.*")
    return rows.toDF(*names)

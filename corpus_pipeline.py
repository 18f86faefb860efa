"""Corpus pipeline: documents through five stages, each one of the numbered operators.

Every stage takes all that the one before it kept, and returns the columns of documents; the last adds
what the mix says of each copy. run() writes each stage as Parquet into the folder of the checkpoints
that executors share, and reads it again, so a lost executor costs one stage's tasks at most; the folder of a
stage goes when the next one is written.

In every stage an empty table gives no rows, columns with the names of an operator's own keep their values, and rows
that are equal in all columns are judged alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm.chunks import without_repeats
from tabloom.llm.common import shared_dir, table
from tabloom.llm.decontaminate import decontaminate
from tabloom.llm.minhash import drop_near_duplicates
from tabloom.llm.mixing import emit_copies, mix_sources
from tabloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity is 0.5 or more, by a model of the labelled ones. Null and empty texts have the
    score of no words."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links between sets of 5-word shingles of similarity 0.8 or more. Rows without doc_id
    or without words stay; rows that share a doc_id are one document."""
    return drop_near_duplicates(docs, n=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks that stand elsewhere before; n_chars follows. A document of which only white space is left
    goes, unless it had nothing else; null texts become empty ones."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten words in a row of a benchmark item, or all of one with fewer. Null and empty texts
    stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy that the mix to target weights takes, numbered in `copy`, with size, source_size and target; a null source is a
    source of its own, and texts without words are taken as often as the others of their source. Columns of docs with
    these names are replaced."""
    return emit_copies(mix_sources(docs)).drop("copies", "taken")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The stages are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark, 'pipeline')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        folder = f"{place}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = folder
    return docs

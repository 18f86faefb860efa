"""Out-of-core SQL over the rows of a task: each task loads its rows into a duckdb database of its own that spills to disk."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabloom.llm.common import shared_dir

#: Memory of a task's database; beyond it, tables and aggregates are spilled.
MEMORY = "256MB"
ROWS = 50_000


def spill_folder(spark: SparkSession) -> str:
    """A path in the shared folder that duckdb can write to. Where that folder is no mounted file system, the caller has to name one."""
    named = shared_dir(spark, "spill")
    if "://" in named and not named.startswith("file://"):
        raise RuntimeError(f"{named} is not mounted: name a mounted folder for spilled rows")
    return named.removeprefix("file://").removeprefix("file:")


def run_sql(df: DataFrame, sql: str, schema: str, spill: str) -> DataFrame:
    """The rows of `sql` over each partition of df as table `rows`. A task's database goes when the task ends, so a lost task
    runs anew from its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="spill-", dir=spill) as folder, duckdb.connect() as task:
            task.execute(f"SET memory_limit = '{MEMORY}'; SET threads = 1; SET preserve_insertion_order = false")
            task.execute("SET temp_directory = $1", [folder])
            empty = True
            for batch in batches:
                # Named in the next statement.
                task.register("arrived", pa.Table.from_batches([batch]))
                task.execute("CREATE TABLE rows AS FROM arrived" if empty else "INSERT INTO rows FROM arrived")
                task.unregister("arrived")
                empty = False
            if not empty:
                yield from task.sql(sql).to_arrow_reader(ROWS)

    return df.mapInArrow(run, schema)

"""Session helpers of the operators: tables, checkpoints and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share. Where the session names none, a
    temporary one in local mode, as in tests; on a cluster that would lose data, so it is refused."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix=f"spark-{what}-")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark, "checkpoint"))
    return df.checkpoint()


def written(df: DataFrame, what: str) -> DataFrame:
    """df written as a Parquet table in the shared folder, and read from there; its lineage ends there."""
    path = f"{shared_dir(df.sparkSession, what)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that `written` made and nothing reads any more."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than this part of all rows is hot; so there are fewer than HOT_PART such keys.
HOT_PART = 1_000
#: Tasks that the rows of a hot key are dealt to.
SPREAD = 128


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> list:
    """The keys of counts (a row for each) with more than 1 / HOT_PART of the total, fewer than HOT_PART of them."""
    return [r[0] for r in counts.where(F.col(n) > max(SPREAD, total // HOT_PART)).select(key).limit(HOT_PART).collect()]


def join_hot(left: DataFrame, right: DataFrame, on: str | list[str], hot: list, how: str = "inner") -> DataFrame:
    """left.join(right, on, how), where right has a row for each key. Rows of left with a hot value of the first column of
    `on` are dealt to SPREAD tasks by a hash of the row, and right's row for it is repeated in each."""
    on = [on] if isinstance(on, str) else on
    if not hot:
        return left.join(right, on, how)
    is_hot = F.col(on[0]).isin(hot)
    salt = F.when(is_hot, F.pmod(F.xxhash64(*left.columns), F.lit(SPREAD)).cast("int")).otherwise(F.lit(0))
    each = F.when(is_hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("_salt", salt).join(right.withColumn("_salt", F.explode(each)), [*on, "_salt"], how).drop("_salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each id that has a link.

    Alternates the large-star and small-star steps: every round is two aggregations by id and two
    joins, in which the smallest neighbour of a node is one row, so a node of very many links is
    only the long side of a join that can be split.  Links never leave the executors.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = cut(edges)
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Here u > v in every row: u's smaller neighbours and u itself are linked to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        last, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )

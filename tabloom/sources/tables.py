"""Datasets, handles and saved objects."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.sources.records import read_delimited

#: Strings of a CSV file that mean "missing". Fixed values.
MISSING = ["", "NA", "N/A", "n/a", "NaN", "nan", "-NaN", "-nan", "null", "NULL", "None", "<NA>", "#N/A", "#NA", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN", "#N/A N/A"]


def handle(*parts: object) -> str:
    """Twelve hex digits that name what was computed from these parts."""
    return hashlib.sha1(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:12]


def store_dir(spark: SparkSession) -> str:
    return spark.conf.get("spark.tabloom.store", None) or os.environ.get("TABLOOM_STORE") or spark.conf.get("spark.sql.warehouse.dir") + "/tabloom"


def load_dataset(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None) -> tuple[str, DataFrame]:
    """(handle, rows) of a Parquet (by its suffix) or else CSV file or folder, whose fields may hold line breaks. NaN becomes null. Spark
    raises if the path doesn't exist. The handle covers the path, the reader's options, and size and time of the last
    change of its files, so an edited file has another one."""
    if path.lower().endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = read_delimited(spark, path, delimiter or ",", encoding or "UTF-8")
        df = df.select(*(F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns))
        df = typed(df)
    double = (T.DoubleType, T.FloatType)
    df = df.select(*(F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, double) else F.col(f"`{f.name}`") for f in df.schema))
    return handle(path, delimiter, encoding, stamp(spark, path)), df


def stamp(spark: SparkSession, path: str) -> list[int]:
    """Bytes, number of files and latest change of what lies at a path; one listing by the driver."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(at)
    inside = fs.listStatus(at) or []
    return [summary.getLength(), summary.getFileCount(), max([fs.getFileStatus(at).getModificationTime(), *(f.getModificationTime() for f in inside)])]


def typed(df: DataFrame) -> DataFrame:
    """String columns as long, double or boolean where all their known values are such; one pass."""
    kinds = ("bigint", "double", "boolean")
    fits = [F.coalesce(F.every(F.expr(f"try_cast(`{c}` AS {k}) IS NOT NULL OR `{c}` IS NULL")), F.lit(False)).alias(f"{i}_{k}") for i, c in enumerate(df.columns) for k in kinds]
    known = [F.count(f"`{c}`").alias(f"{i}_n") for i, c in enumerate(df.columns)]
    row = df.agg(*fits, *known).first()
    kind = lambda i: next((k for k in kinds if row[f"{i}_n"] and row[f"{i}_{k}"]), "string")
    return df.select(*(F.col(f"`{c}`").cast(kind(i)).alias(c) for i, c in enumerate(df.columns)))


def save(df: DataFrame, folder: str, name: str, mode: str = "errorifexists") -> str:
    path = f"{store_dir(df.sparkSession)}/{folder}/{name}.parquet"
    df.write.mode(mode).parquet(path)
    return path


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{store_dir(spark)}/{folder}/{name}.parquet")


def exists(spark: SparkSession, folder: str, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store_dir(spark)}/{folder}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def save_split(df: DataFrame, name: str, **meta: object) -> str:
    """Rows with the column part (train or test), partitioned by it, so that reading one never scans the other. meta (target,
    task, strategy and so on) is kept with the sizes of the parts."""
    spark = df.sparkSession
    path = f"{store_dir(spark)}/splits/{name}"
    df.write.mode("overwrite").partitionBy("part").parquet(path)
    sizes = {f"n_{r.part}": r["count"] for r in spark.read.parquet(path).groupBy("part").count().collect()}
    facts = json.dumps({"n_train": 0, "n_test": 0} | sizes | meta, sort_keys=True, default=str)
    spark.createDataFrame([(facts,)], "facts string").coalesce(1).write.mode("overwrite").parquet(f"{path}_meta")
    return path


def split_meta(spark: SparkSession, name: str) -> dict:
    return json.loads(spark.read.parquet(f"{store_dir(spark)}/splits/{name}_meta").first().facts)


def save_folds(df: DataFrame, name: str, split: str, strategy: str, fold: str = "fold") -> str:
    """Training rows with their fold, partitioned by it, and what they were made from; load_folds reads both."""
    spark = df.sparkSession
    path = f"{store_dir(spark)}/folds/{name}"
    df.write.mode("overwrite").partitionBy(fold).parquet(path)
    n = spark.read.parquet(path).select(fold).distinct().count()
    facts = json.dumps({"split_id": split, "strategy": strategy, "n_folds": n, "fold": fold}, sort_keys=True)
    spark.createDataFrame([(facts,)], "facts string").coalesce(1).write.mode("overwrite").parquet(f"{path}_meta")
    return path


def load_folds(spark: SparkSession, name: str) -> tuple[DataFrame, dict]:
    path = f"{store_dir(spark)}/folds/{name}"
    return spark.read.parquet(path), json.loads(spark.read.parquet(f"{path}_meta").first().facts)


def load_part(spark: SparkSession, name: str, part: str) -> DataFrame:
    return spark.read.parquet(f"{store_dir(spark)}/splits/{name}").where(F.col("part") == part).drop("part")

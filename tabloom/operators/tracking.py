"""Runs and past cases as append-only Parquet tables; the answers are queries over them."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.sources.tables import exists, handle, load, save, store_dir

BUCKETS = ["tiny", "small", "medium", "large"]
EVENTS = "experiment string, run string, kind string, key string, value string, number double, at double"


def _append(spark: SparkSession, rows: list[tuple]) -> None:
    save(spark.createDataFrame(rows, EVENTS), "tracking", "events", mode="append")


def create_experiment(spark: SparkSession, name: str) -> str:
    return handle("experiment", name)


def start_run(spark: SparkSession, experiment: str) -> str:
    run = uuid.uuid4().hex
    _append(spark, [(experiment, run, "status", "status", "RUNNING", None, time.time())])
    return run


def end_run(spark: SparkSession, experiment: str, run: str, status: str = "finished") -> None:
    _append(spark, [(experiment, run, "status", "status", "FINISHED" if status == "finished" else "FAILED", None, time.time())])


def log_parameters(spark: SparkSession, experiment: str, run: str, values: dict | None, **handles: str) -> list[str]:
    """The names logged: the handles of what the run used (split_id, folds_id and the like), then its parameters."""
    every = handles | {str(k): v for k, v in (values or {}).items()}
    _append(spark, [(experiment, run, "param", k, str(v)[:500], None, time.time()) for k, v in every.items()])
    return list(every)


def log_artifact(spark: SparkSession, experiment: str, run: str, path: str) -> str:
    """Copies a file or folder into the store, beside the run, and logs its place."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, goal = hadoop.Path(path), hadoop.Path(f"{store_dir(spark)}/tracking/artifacts/{run}/{path.rstrip('/').rsplit('/', 1)[-1]}")
    conf = spark._jsc.hadoopConfiguration()
    fs, to = source.getFileSystem(conf), goal.getFileSystem(conf)
    if not fs.exists(source):
        raise FileNotFoundError(path)
    to.mkdirs(goal.getParent())
    hadoop.FileUtil.copy(fs, source, to, goal, False, True, conf)
    _append(spark, [(experiment, run, "artifact", goal.getName(), goal.toString(), None, time.time())])
    return goal.toString()


def log_metrics(spark: SparkSession, experiment: str, run: str, values: dict) -> list[str]:
    """The names logged; values that are no numbers are left out."""
    rows = []
    for k, v in (values or {}).items():
        try:
            rows.append((experiment, run, "metric", k, None, float(v), time.time()))
        except (TypeError, ValueError):
            continue
    if rows:
        _append(spark, rows)
    return [r[3] for r in rows]


def events(spark: SparkSession) -> DataFrame:
    return load(spark, "tracking", "events") if exists(spark, "tracking", "events") else spark.createDataFrame([], EVENTS)


def latest(events: DataFrame) -> DataFrame:
    """The last value of each key of each run."""
    return events.groupBy("experiment", "run", "kind", "key").agg(F.max_by("value", "at").alias("value"), F.max_by("number", "at").alias("number"))


def get_run(spark: SparkSession, run: str) -> DataFrame:
    return latest(events(spark).where(F.col("run") == run))


def compare_runs(events: DataFrame, experiment: str, metric: str, mode: str = "max") -> DataFrame:
    """(run, number), best first; runs without the metric are absent."""
    rows = latest(events).where((F.col("experiment") == experiment) & (F.col("kind") == "metric") & (F.col("key") == metric))
    order = F.desc("number") if mode == "max" else F.asc("number")
    return rows.select("run", "number").orderBy(order, "run")


def best_run(events: DataFrame, experiment: str, metric: str, mode: str = "max") -> dict | None:
    """run, metrics and params of the best run by a metric (ties: the smaller name); None without one."""
    top = compare_runs(events, experiment, metric, mode).first()
    if top is None:
        return None
    rows = latest(events.where((F.col("experiment") == experiment) & (F.col("run") == top.run))).collect()  # of one run
    return {"run": top.run, "metrics": {r.key: r.number for r in rows if r.kind == "metric"}, "params": {r.key: r.value for r in rows if r.kind == "param"}}


def row_bucket(n: int) -> str:
    return BUCKETS[0] if n < 1_000 else BUCKETS[1] if n < 10_000 else BUCKETS[2] if n < 100_000 else BUCKETS[3]


def fingerprint(n_rows: int, roles: DataFrame) -> dict:
    mix = {r.role: r["count"] for r in roles.groupBy("role").count().collect()}  # a row for each role
    return {"row_bucket": row_bucket(n_rows), "n_columns": sum(mix.values()), "role_mix": mix}


def store_case(spark: SparkSession, fp: dict, task: str, approach: str, outcome: dict, scope: str = "private") -> str:
    case = uuid.uuid4().hex
    row = (case, fp["row_bucket"], fp["n_columns"], fp["role_mix"], task, approach, json.dumps(outcome, sort_keys=True), scope)
    save(spark.createDataFrame([row], "id string, row_bucket string, n_columns int, role_mix map<string,int>, task string, approach string, outcome string, scope string"), "tracking", "cases", mode="append")
    return case


def distance(fp: dict) -> Column:
    """Of a case (columns row_bucket, n_columns, role_mix) from a fingerprint."""
    mine = F.create_map(*[x for r, n in fp["role_mix"].items() for x in (F.lit(r), F.lit(n))]) if fp["role_mix"] else F.expr("map()").cast("map<string,int>")
    total = lambda m: F.greatest(F.aggregate(F.map_values(m), F.lit(0), lambda s, x: s + x), F.lit(1))
    share = lambda m, r: F.coalesce(F.try_element_at(m, r), F.lit(0)) / total(m)
    roles = F.array_union(F.map_keys(mine), F.map_keys("role_mix"))
    mix = F.aggregate(roles, F.lit(0.0), lambda s, r: s + F.abs(share(mine, r) - share(F.col("role_mix"), r))) / F.greatest(F.size(roles), F.lit(1))
    bucket = F.abs(F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("row_bucket")) - (BUCKETS.index(fp["row_bucket"]) + 1))
    columns = F.abs(F.col("n_columns") - fp["n_columns"]) / F.greatest(F.col("n_columns"), F.lit(fp["n_columns"]), F.lit(1))
    return F.round(0.3 * bucket + 0.2 * columns + 0.5 * mix, 4)


def similar_cases(cases: DataFrame, fp: dict, task: str, k: int = 5, scope: str = "all") -> DataFrame:
    rows = cases.where(F.col("task") == task)
    rows = rows if scope in ("all", "shared") else rows.where(F.col("scope") == scope)
    return rows.withColumn("distance", distance(fp)).orderBy("distance", "id").limit(k)

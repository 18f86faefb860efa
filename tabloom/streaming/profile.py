"""Profile of a stream of numbers by windows of event time, with the expressions of the batch profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_profile(stream: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """(window_start, by..., n, mean, std, min, max); rows later than `late` are dropped by the watermark."""
    x = F.col(value).cast("double")
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = rows.groupBy(F.window(time, width).alias("w"), *(by or [])).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return out.select(F.col("w.start").alias("window_start"), *(by or []), "n", "mean", "std", "min", "max")

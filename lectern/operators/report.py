"""Quality reports: long metric tables and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivoted(wide: DataFrame, metrics: list[str], key: str = "clip_id") -> DataFrame:
    """clip_id, metric, value; metrics that weren't computed are left out."""
    return wide.unpivot([key], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value").where("value is not null")


def summary(metrics: DataFrame, names: list[str] | None = None) -> DataFrame:
    """metric, n, mean, std (sample; 0 for one value), least, most; named metrics without values have n 0 and nulls."""
    out = metrics.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.when(F.count("value") == 1, 0.0).otherwise(F.stddev_samp("value")).alias("std"), F.min("value").alias("least"), F.max("value").alias("most"))
    if names is None:
        return out
    named = metrics.sparkSession.createDataFrame([(n,) for n in names], "metric string")
    return named.join(out, "metric", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def processed(clips: DataFrame, status_col: str = "status") -> DataFrame:
    """n_processed, n_failed: clips that were read and judged, and those missing or broken."""
    ok = F.col(status_col) == "ok"
    return clips.agg(F.count_if(ok).alias("n_processed"), F.count_if(~ok).alias("n_failed"))

"""Roll-ups of metric buckets: frame-weighted means, rates and their groupings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.times import bucket_start


def rollup_columns(when: Column | None = None) -> list[Column]:
    """The measures of a set of metric rows (of those where ``when`` holds): sums, rates, and means weighted by frames.

    Speeds are weighted by the tracks of their bucket, 1 at least; without frames the weighted means are 0.
    """
    pick = (lambda x: x) if when is None else (lambda x: F.when(when, x))
    frames = F.sum(pick(F.col("frames")))
    seconds = F.sum(pick(F.col("bucket_seconds")))
    weight = F.when(F.col("avg_speed_kmh").isNotNull(), F.greatest(F.col("new_tracks"), F.lit(1)))
    by_frames = lambda c: F.coalesce(F.try_divide(F.sum(pick(F.col(c) * F.col("frames"))), F.nullif(frames, F.lit(0))), F.lit(0.0))
    return [
        F.sum(pick(F.col("new_tracks"))).cast("long").alias("vehicles"),
        F.round(F.sum(pick(F.col("new_tracks"))) / (F.when(seconds > 0, seconds).otherwise(1) / 60.0), 2).alias("rate_per_min"),
        F.round(F.try_divide(F.sum(pick(F.col("avg_speed_kmh") * weight)), F.sum(pick(weight))), 1).alias("avg_speed_kmh"),
        F.round(by_frames("occupancy"), 4).alias("occupancy"),
        F.round(by_frames("avg_stationary"), 2).alias("queue"),
        F.round(by_frames("avg_vehicles_in_frame"), 2).alias("density"),
        F.max(pick(F.col("max_vehicles_in_frame"))).alias("max_in_frame"),
        F.count(pick(F.lit(1))).alias("buckets"),
        seconds.cast("long").alias("covered_s"),
    ]


def rollup(metrics: DataFrame, *by: str) -> DataFrame:
    """Measures of each group of ``by``; of all rows without it (no rows give none)."""
    return metrics.groupBy(*by).agg(*rollup_columns()).where("buckets > 0")


def time_series(metrics: DataFrame, seconds: int, *by: str) -> DataFrame:
    """Measures of each epoch-aligned bucket of ``seconds``; metrics have ``start_s``."""
    return metrics.withColumn("ts_s", bucket_start(F.col("start_s"), seconds)).groupBy("ts_s", *by).agg(*rollup_columns())


def totals_and_groups(df: DataFrame, groups: Sequence[str], measures: Sequence[Column]) -> DataFrame:
    """Measures of each value of the columns together and of the whole in one pass; the whole has nulls and ``is_total``."""
    return df.rollup(*groups).agg(*measures, F.grouping_id().alias("g")).where(f"g = 0 or g = {2 ** len(groups) - 1}").withColumn("is_total", F.col("g") > 0).drop("g")


def from_observations(obs: DataFrame, seconds: int = 3600) -> DataFrame:
    """Metric buckets of observations: what a sensor would have sent for each bucket."""
    start = bucket_start(F.col("t"), seconds)
    out = obs.withColumn("start_s", start).groupBy("camera_id", "start_s").agg(
        F.count("*").alias("frames"),
        F.count_distinct("vehicle_id").alias("new_tracks"),
        F.avg("k").alias("avg_vehicles_in_frame"),
        F.max("k").alias("max_vehicles_in_frame"),
        (F.avg("speed_kmh") / 1000).alias("occupancy"),
        (F.avg("k") / 10).alias("avg_stationary"),
        F.avg(F.when(F.col("k") > 1, F.col("speed_kmh") / 5)).alias("avg_speed_kmh"),
    )
    return out.withColumn("bucket_seconds", F.lit(seconds))

"""Explainable congestion scores, hotspots, network snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.scores import clamp, congestion_level, weighted_mean
from kerbline.operators.metrics import rollup_columns

#: Weights of the components, and what counts as free or saturated.
WEIGHTS = {"speed": 0.35, "occupancy": 0.25, "queue": 0.2, "volume": 0.1, "travel_time": 0.1}
FREE_FLOW_KMH, QUEUE_FULL, OCCUPANCY_FULL, WINDOW_S, BASELINE_S = 40.0, 6.0, 0.35, 300, 21_600


def components(speed: Column, occupancy: Column, queue: Column, rate: Column, usual_rate: Column, travel_ratio: Column, free: float, occupancy_full: float, queue_full: float) -> dict[str, Column]:
    """Values from 0 to 1, null where there is too little to tell."""
    return {
        "speed": clamp(1 - speed / free),
        "occupancy": F.least(F.lit(1.0), occupancy / occupancy_full),
        "queue": F.least(F.lit(1.0), queue / queue_full),
        "volume": clamp(F.try_divide(rate, usual_rate) - 1),
        "travel_time": clamp((travel_ratio - 1) / 1.5),
    }


def congestion(metrics: DataFrame, ratios: DataFrame, now: float, window_s: int = WINDOW_S, baseline_s: int = BASELINE_S, free: float = FREE_FLOW_KMH, occupancy_full: float = OCCUPANCY_FULL, queue_full: float = QUEUE_FULL, weights: dict[str, float] | None = None) -> DataFrame:
    """Of each camera with metrics in the window: its components, score from 0 to 100, level, and components by their share.

    One pass over the metrics of window and baseline. The volume counts only where the baseline covers two windows; what
    is missing gives its weight to the others.
    """
    weights = weights or WEIGHTS
    rows = metrics.where((F.col("start_s") >= now - baseline_s) & (F.col("start_s") < now))
    recent = F.col("start_s") >= now - window_s
    current, usual = (rows.groupBy("camera_id").agg(*rollup_columns(w)) for w in (recent, ~recent))
    usual = usual.where((F.col("covered_s") >= 2 * window_s) & (F.col("rate_per_min") > 0)).select("camera_id", F.col("rate_per_min").alias("usual_rate"))
    out = current.where("buckets > 0").join(usual, "camera_id", "left").join(ratios, "camera_id", "left")
    parts = components(*[F.col(c) for c in ("avg_speed_kmh", "occupancy", "queue", "rate_per_min", "usual_rate", "travel_ratio")], free, occupancy_full, queue_full)
    out = out.withColumns({f"c_{k}": v for k, v in parts.items()})
    score = 100 * weighted_mean({k: (weights[k], F.col(f"c_{k}")) for k in parts})
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-weights[k] * F.col(f"c_{k}")).alias("w"), F.lit(k).alias("name")) for k in parts]), lambda x: x["w"].isNotNull()))
    out = out.withColumn("raw_score", score).withColumn("level", congestion_level(F.col("raw_score"))).withColumn("score", F.round("raw_score", 1))
    return out.withColumn("ranked", F.array_join(F.transform(ranked, lambda x: x["name"]), ",")).drop("raw_score")


def hotspots(metrics: DataFrame, alerts: DataFrame, free: float = FREE_FLOW_KMH, occupancy_full: float = OCCUPANCY_FULL, queue_full: float = QUEUE_FULL) -> DataFrame:
    """Cameras by the score of the whole period, with the peak of single buckets and their alerts; ``rank`` from 1."""
    from pyspark.sql.window import Window

    peak = F.round(F.coalesce(F.max(100 * F.least(F.lit(1.0), F.col("avg_stationary") / queue_full)), F.lit(0.0)), 1)
    out = metrics.groupBy("camera_id").agg(*rollup_columns(), peak.alias("peak_queue_score")).join(alerts.groupBy("camera_id").agg(F.count("*").alias("alerts")), "camera_id", "left").fillna(0, ["alerts"])
    parts = {
        "occupancy": (WEIGHTS["occupancy"], F.least(F.lit(1.0), F.col("occupancy") / occupancy_full)),
        "queue": (WEIGHTS["queue"], F.least(F.lit(1.0), F.col("queue") / queue_full)),
        "speed": (WEIGHTS["speed"], F.greatest(F.lit(0.0), 1 - F.col("avg_speed_kmh") / free)),
    }
    out = out.withColumn("raw", 100 * weighted_mean(parts)).withColumn("score", F.round("raw", 1)).withColumn("level", congestion_level(F.col("raw")))
    order = Window.orderBy(F.desc("score"), F.desc("alerts"), "camera_id")  # one row for each camera
    return out.withColumn("rank", F.row_number().over(order)).select("camera_id", "score", "level", "peak_queue_score", "alerts", "vehicles", "avg_speed_kmh", "queue", "occupancy", "rank")


def snapshot(scores: DataFrame, observations: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: sightings, distinct vehicles, open alerts, the mean score and the worst camera."""
    a = observations.agg(F.count("*").alias("observations"), F.count_distinct("vehicle_id").alias("vehicles"))
    b = scores.agg(F.round(F.avg("score"), 1).alias("mean_score"), F.max_by("camera_id", F.struct("score", "camera_id")).alias("worst_camera"))
    c = alerts.agg(F.count(F.when(F.col("status") != "RESOLVED", 1)).alias("open_alerts"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(a).join(one(b), "_one").join(one(c), "_one").drop("_one")

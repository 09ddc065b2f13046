"""Travel times: segment samples, baselines, anomalies, inbound ratios, incident impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.operators.metrics import rollup_columns
from kerbline.operators.quantiles import medians


def segment_samples(points: DataFrame, since: float, until: float, levels: tuple[str, ...] = ("HIGH", "MEDIUM")) -> DataFrame:
    """from_id, to_id and travel_s of the segments in [since, until) between two cameras, of the given confidence."""
    kept = points.where((F.col("t") >= since) & (F.col("t") < until) & F.col("segment_travel_s").isNotNull() & (F.col("from_camera_id") != F.col("camera_id")))
    if "confidence_level" in points.columns:
        kept = kept.where(F.col("confidence_level").isin(*levels))
    return kept.select(F.col("from_camera_id").alias("from_id"), F.col("camera_id").alias("to_id"), F.col("segment_travel_s").alias("travel_s"))


def segment_medians(samples: DataFrame) -> DataFrame:
    """Of each segment the median of its samples and how many there are."""
    return medians(samples, ["from_id", "to_id"], "travel_s", "median_s")


def baselines(points: DataFrame, edges: DataFrame, now: float, baseline_s: float = 21_600, exclude_recent_s: float = 900, min_samples: int = 5) -> DataFrame:
    """Usual seconds of each allowed edge: the observed median with enough samples, else the edge's typical time."""
    history = segment_medians(segment_samples(points, now - baseline_s, now - exclude_recent_s))
    out = edges.where("allowed").select("from_id", "to_id", "typical_travel_s").join(history, ["from_id", "to_id"], "left").fillna(0, ["samples"])
    observed = F.col("samples") >= min_samples
    return out.select("from_id", "to_id", F.when(observed, F.col("median_s")).otherwise(F.col("typical_travel_s")).alias("seconds"), F.when(observed, "observed").otherwise("topology_prior").alias("source"), "samples")


def path_seconds(paths: DataFrame, base: DataFrame, fallback: str = "typical_travel_s") -> DataFrame:
    """``paths`` (any columns, cameras: array) with baseline_s: the sum over the hops; the fallback where a hop is unknown or the sum 0."""
    keyed = paths.withColumn("_path", F.concat_ws(">", "cameras"))
    hops = keyed.select("_path", F.explode(F.transform(F.sequence(F.lit(1), F.size("cameras") - 1), lambda i: F.struct(F.element_at("cameras", i).alias("from_id"), F.element_at("cameras", i + 1).alias("to_id")))).alias("hop")).select("_path", "hop.*").distinct()
    sums = hops.join(base.select("from_id", "to_id", "seconds"), ["from_id", "to_id"], "left").groupBy("_path").agg(F.sum("seconds").alias("s"), F.count(F.when(F.col("seconds").isNull(), 1)).alias("unknown"))
    known = (F.col("unknown") == 0) & (F.col("s") > 0)
    return keyed.join(sums, "_path", "left").withColumn("baseline_s", F.when(known, F.col("s")).otherwise(F.col(fallback))).drop("_path", "s", "unknown")


def anomalies(points: DataFrame, base: DataFrame, now: float, window_s: float, ratio: float, min_samples: int) -> DataFrame:
    """Edges whose recent median is compared with the baseline, the worst first by ``ratio``."""
    recent = segment_medians(segment_samples(points, now - window_s, now)).where(F.col("samples") >= min_samples)
    out = recent.join(base.select("from_id", "to_id", "seconds", "source"), ["from_id", "to_id"])
    r = F.col("median_s") / F.greatest(F.col("seconds"), F.lit(1.0))
    return out.select("from_id", "to_id", F.round("median_s", 1).alias("median_s"), F.round("seconds", 1).alias("baseline_s"), F.col("source").alias("baseline_source"), F.round(r, 2).alias("ratio"), "samples", (r >= ratio).alias("anomalous"))


def inbound_ratios(samples: DataFrame, base: DataFrame) -> DataFrame:
    """Of each camera: the mean over incoming edges of median to baseline, weighted by samples."""
    per_edge = segment_medians(samples).join(base.select("from_id", "to_id", "seconds"), ["from_id", "to_id"])
    r = F.col("median_s") / F.greatest(F.col("seconds"), F.lit(1.0))
    return per_edge.groupBy(F.col("to_id").alias("camera_id")).agg(F.round(F.sum(r * F.col("samples")) / F.sum("samples"), 2).alias("travel_ratio"))


def incident_measures(metrics: DataFrame, start: float, end: float) -> DataFrame:
    """Of each camera: measures during an incident, in the period before (as long, 15 minutes at least), and their differences."""
    before = start - max(end - start, 900)
    rows = metrics.where((F.col("start_s") >= before) & (F.col("start_s") < end)).withColumn("phase", F.when(F.col("start_s") >= start, "during").otherwise("before"))
    measures = ("rate_per_min", "avg_speed_kmh", "occupancy", "queue")
    out = rows.groupBy("camera_id", "phase").agg(*rollup_columns())
    pick = lambda phase, m: F.max(F.when(F.col("phase") == phase, F.col(m)))
    return out.groupBy("camera_id").agg(*[pick("during", m).alias(f"during_{m}") for m in measures], *[F.round(pick("during", m) - pick("before", m), 3).alias(f"delta_{m}") for m in measures])


def incident_sites(edges: DataFrame, cameras: DataFrame, camera: str) -> DataFrame:
    """camera_id and role (site, upstream, downstream) of an incident's camera and its neighbours of the same scope."""
    allowed, site = edges.where("allowed"), cameras.where(F.col("camera_id") == camera)
    up = allowed.where(F.col("to_id") == camera).select(F.col("from_id").alias("camera_id"), F.lit("upstream").alias("role"))
    down = allowed.where(F.col("from_id") == camera).select(F.col("to_id").alias("camera_id"), F.lit("downstream").alias("role"))
    same = cameras.join(F.broadcast(site.select("is_demo")), "is_demo", "left_semi").select("camera_id")  # one camera's scope
    return up.unionByName(down).distinct().join(same, "camera_id", "left_semi").unionByName(site.select("camera_id", F.lit("site").alias("role")))


def incident_impact(obs: DataFrame, points: DataFrame, edges: DataFrame, cameras: DataFrame, alerts: DataFrame, camera: str, start: float, end: float) -> DataFrame:
    """One row: vehicles at the site or upstream during an incident, alerts at all its cameras, vehicle-hours lost, and a summary."""
    sites = incident_sites(edges, cameras, camera)
    during = lambda df: df.where((F.col("t") >= start) & (F.col("t") < end))
    vehicles = during(obs).join(sites.where("role <> 'downstream'"), "camera_id", "left_semi").agg(F.count_distinct("vehicle_id").alias("vehicles_affected"))
    raised = during(alerts).join(sites, "camera_id", "left_semi").agg(F.count("*").alias("alerts"))
    lost = incident_segments(points, edges, camera, start, end).agg(F.count("*").alias("segments"), F.round(F.coalesce(F.sum("extra_s"), F.lit(0.0)) / 3600, 3).alias("vehicle_hours"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  each is one row
    out = one(vehicles).join(one(raised), "_one").join(one(lost), "_one").drop("_one")
    text = F.format_string("%d vehicles, %d alerts, %s vehicle-hours on %d segments", "vehicles_affected", "alerts", F.col("vehicle_hours").cast("string"), "segments")
    return out.select(F.lit(camera).alias("camera_id"), "vehicles_affected", "alerts", "segments", "vehicle_hours", text.alias("summary"))


def incident_segments(points: DataFrame, edges: DataFrame, camera: str, start: float, end: float) -> DataFrame:
    """Segments at the camera during an incident against the period before, or the edge's typical time: extra seconds for each vehicle."""
    before = start - max(end - start, 900)
    touches = (F.col("from_id") == camera) | (F.col("to_id") == camera)
    now = segment_medians(segment_samples(points, start, end)).where(touches)
    prior = segment_medians(segment_samples(points, before, start)).select("from_id", "to_id", F.col("median_s").alias("prior_s"))
    out = now.join(prior, ["from_id", "to_id"], "left").join(edges.select("from_id", "to_id", "typical_travel_s"), ["from_id", "to_id"], "left")
    usual = F.coalesce("prior_s", "typical_travel_s")
    extra = F.coalesce(F.greatest(F.lit(0.0), F.col("median_s") - usual), F.lit(0.0))
    return out.select("from_id", "to_id", F.round("median_s", 1).alias("median_s"), F.round(usual, 1).alias("before_s"), "samples", F.round(extra, 1).alias("extra_s_per_vehicle"), (extra * F.col("samples")).alias("extra_s"))


def cumulative_path(steps: DataFrame) -> DataFrame:
    """Arrival seconds along a path (path_id, position, seconds)."""
    order = Window.partitionBy("path_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("eta_s", F.sum("seconds").over(order))

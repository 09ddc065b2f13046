"""The test tables as sightings, metrics, samples and a road graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.scores import congestion_level
from kerbline.functions.times import epoch_seconds
from kerbline.operators import graph, journeys, metrics

#: The time that time-relative queries take as now, and the gap that ends a journey in these tables.
NOW, GAP_S = 1_706_572_800.0, 21_600

#: A small road graph over the event types: one closed edge, and nothing leads to ``error``.
EDGES = [
    ("view", "click", 1200.0, 48.0, 9000.0, True), ("click", "view", 1200.0, 48.0, 9500.0, True), ("click", "signup", 900.0, 36.0, 8000.0, True), ("signup", "purchase", 1500.0, 60.0, 9900.0, True),
    ("purchase", "view", 3000.0, 120.0, 10_500.0, True), ("view", "purchase", 2900.0, 116.0, 9700.0, True), ("click", "purchase", 700.0, 28.0, 8800.0, False), ("error", "view", 800.0, 32.0, 9100.0, True),
    ("signup", "click", 1000.0, 40.0, 8600.0, True), ("purchase", "signup", 1600.0, 64.0, 9300.0, True),
]
CAMERAS = [("view", 26.85, 80.94, False, False), ("click", 26.86, 80.95, False, False), ("signup", 26.87, 80.93, True, False), ("purchase", 26.88, 80.96, True, True), ("error", 26.9, 80.99, False, True)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as sightings: user as vehicle, event type as camera, value as speed, k of the properties as a small number."""
    k = F.get_json_object("props", "$.k").cast("int")
    digits = F.lpad((F.col("user_id") % 10_000).cast("string"), 4, "0")
    return read(spark, sf_dir, "events").select(
        "event_id", epoch_seconds(F.col("ts")).alias("t"), F.col("user_id").alias("vehicle_id"), F.col("event_type").alias("camera_id"), F.col("value").alias("speed_kmh"), k.alias("k"),
        F.when(k % 5 != 0, F.concat(F.lit("UP32AB"), digits)).alias("plate"), (0.5 + k / 200).alias("confidence"), (F.col("user_id") % 4 == 0).alias("is_demo"),
    )


OBS = """obs AS (
  SELECT event_id, epoch_us(ts) / 1e6 AS t, user_id AS vehicle_id, event_type AS camera_id, value AS speed_kmh, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 <> 0 THEN 'UP32AB' || lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0') END AS plate,
    0.5::DOUBLE + CAST(json_extract_string(props, '$.k') AS INTEGER) / 200.0::DOUBLE AS confidence, user_id % 4 = 0 AS is_demo
  FROM events)"""


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "from_id string, to_id string, distance_m double, min_travel_s double, typical_travel_s double, allowed boolean")


EDGES_SQL = "edges(from_id, to_id, distance_m, min_travel_s, typical_travel_s, allowed) AS (VALUES " + ", ".join(f"('{a}', '{b}', {d}::DOUBLE, {m}::DOUBLE, {t}::DOUBLE, {str(ok).lower()})" for a, b, d, m, t, ok in EDGES) + ")"


def cameras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAMERAS, "camera_id string, latitude double, longitude double, one_way boolean, is_demo boolean")


CAMERAS_SQL = "cameras(camera_id, latitude, longitude, one_way, is_demo) AS (VALUES " + ", ".join(f"('{c}', {a}::DOUBLE, {o}::DOUBLE, {str(w).lower()}, {str(d).lower()})" for c, a, o, w, d in CAMERAS) + ")"


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journeys.trajectory(observations(spark, sf_dir), GAP_S)


TRAJECTORY = f"""gaps AS (
  SELECT *, lag(t) OVER w AS t0, lag(camera_id) OVER w AS c0, row_number() OVER w - 1 AS seq FROM obs WINDOW w AS (PARTITION BY vehicle_id ORDER BY t, event_id)),
points AS (
  SELECT * EXCLUDE (t0, c0), CAST(sum(CASE WHEN t - t0 > {GAP_S} THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY t, event_id) AS BIGINT) AS journey_index,
    CASE WHEN t - t0 <= {GAP_S} THEN c0 END AS from_camera_id, CASE WHEN t - t0 <= {GAP_S} THEN round(t - t0, 2) END AS segment_travel_s FROM gaps)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.from_observations(observations(spark, sf_dir))


METRICS = """metrics AS (
  SELECT camera_id, CAST(floor(t / 3600) * 3600 AS BIGINT) AS start_s, count(*) AS frames, count(DISTINCT vehicle_id) AS new_tracks, avg(k) AS avg_vehicles_in_frame,
    max(k) AS max_vehicles_in_frame, avg(speed_kmh) / 1000 AS occupancy, avg(k) / 10 AS avg_stationary, avg(CASE WHEN k > 1 THEN speed_kmh / 5 END) AS avg_speed_kmh, 3600 AS bucket_seconds
  FROM obs GROUP BY ALL)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings as health samples of their camera."""
    obs = observations(spark, sf_dir)
    status = F.when(F.col("k") < 3, "OFFLINE").when(F.col("k") < 10, "DEGRADED").otherwise("ONLINE")
    return obs.select(
        "event_id", "t", "camera_id", status.alias("status"), F.floor(F.col("event_id") / 500).alias("reconnects"), (F.col("speed_kmh") / 40).alias("processing_fps"), (F.col("speed_kmh") / 10).alias("input_fps"),
        F.when(F.col("k") % 3 != 0, F.col("speed_kmh")).alias("blur_score"), F.when(F.col("k") % 4 != 0, F.col("k") * 1.0).alias("brightness"), (F.col("k") % 6).alias("vehicles_detected"), (F.col("k") % 3).alias("plates_read"),
        F.when(F.col("k") % 2 == 0, F.col("confidence")).alias("avg_ocr_confidence"), F.col("k").alias("frames_dropped"), (F.col("k") + 20).alias("frames_processed"),
    )


SAMPLES = """samples AS (
  SELECT event_id, t, camera_id, CASE WHEN k < 3 THEN 'OFFLINE' WHEN k < 10 THEN 'DEGRADED' ELSE 'ONLINE' END AS status, event_id // 500 AS reconnects, speed_kmh / 40 AS processing_fps, speed_kmh / 10 AS input_fps,
    CASE WHEN k % 3 <> 0 THEN speed_kmh END AS blur_score, CASE WHEN k % 4 <> 0 THEN k * 1.0::DOUBLE END AS brightness, k % 6 AS vehicles_detected, k % 3 AS plates_read,
    CASE WHEN k % 2 = 0 THEN confidence END AS avg_ocr_confidence, k AS frames_dropped, k + 20 AS frames_processed FROM obs)"""

#: Cheapest paths by distance over the edges, loops included, the first of equal cost.
PATHS_SQL = """walks AS (
  SELECT from_id, to_id, distance_m AS cost, [from_id, to_id] AS cameras, min_travel_s, typical_travel_s FROM edges WHERE allowed
  UNION ALL
  SELECT w.from_id, e.to_id, w.cost + e.distance_m, list_append(w.cameras, e.to_id), w.min_travel_s + e.min_travel_s, w.typical_travel_s + e.typical_travel_s
  FROM walks w JOIN edges e ON w.to_id = e.from_id AND e.allowed WHERE w.from_id <> w.to_id AND (e.to_id = w.from_id OR NOT list_contains(w.cameras, e.to_id))),
paths AS (
  SELECT * FROM walks QUALIFY row_number() OVER (PARTITION BY from_id, to_id ORDER BY cost, cameras) = 1)"""


def paths(spark: SparkSession) -> DataFrame:
    return graph.shortest_paths(edges(spark))


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-way ring road through the nations in the order of their keys, with short cuts at those of the first region.

    A segment's length goes by the customers of its nation, so that the graph comes from the tables; it is up to 24 hops wide.
    """
    nations, each = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    there = nations.join(each, F.col("n_nationkey") == F.col("c_nationkey"), "left").fillna(0, ["n"])
    name = lambda k: F.format_string("N%02d", k % 25)
    step = F.explode(F.when(F.col("n_regionkey") == 0, F.array(F.lit(1), F.lit(4))).otherwise(F.array(F.lit(1))))
    out = there.withColumn("step", step).select(name(F.col("n_nationkey")).alias("from_id"), name(F.col("n_nationkey") + F.col("step")).alias("to_id"), ((500 + 10 * F.col("n")) * F.col("step")).cast("double").alias("distance_m"), F.lit(True).alias("allowed"))
    return out.withColumns({"min_travel_s": F.col("distance_m") / 25, "typical_travel_s": F.col("distance_m") / 10})


NETWORK_SQL = """edges AS (
  SELECT printf('N%02d', n_nationkey % 25) AS from_id, printf('N%02d', (n_nationkey + step) % 25) AS to_id, ((500 + 10 * coalesce(n, 0)) * step)::DOUBLE AS distance_m, true AS allowed,
    ((500 + 10 * coalesce(n, 0)) * step)::DOUBLE / 25 AS min_travel_s, ((500 + 10 * coalesce(n, 0)) * step)::DOUBLE / 10 AS typical_travel_s
  FROM (SELECT *, unnest(CASE WHEN n_regionkey = 0 THEN [1, 4] ELSE [1] END) AS step FROM nation) LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL) ON n_nationkey = c_nationkey)"""


def network_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras at the nodes of ``network`` but those of the last region, in a ring about a point; one-way where the key is even."""
    nations = read(spark, sf_dir, "nation").where("n_regionkey < 4")
    angle = F.radians(F.col("n_nationkey") * 14.4)
    return nations.select(F.format_string("N%02d", "n_nationkey").alias("camera_id"), F.round(26.8 + 0.1 * F.sin(angle), 6).alias("latitude"), F.round(80.9 + 0.1 * F.cos(angle), 6).alias("longitude"), (F.col("n_nationkey") % 2 == 0).alias("one_way"), (F.col("n_regionkey") == 0).alias("is_demo"))


NETWORK_CAMERAS_SQL = """cameras AS (
  SELECT printf('N%02d', n_nationkey) AS camera_id, round(26.8::DOUBLE + 0.1::DOUBLE * sin(radians(n_nationkey * 14.4::DOUBLE)), 6) AS latitude, round(80.9::DOUBLE + 0.1::DOUBLE * cos(radians(n_nationkey * 14.4::DOUBLE)), 6) AS longitude, n_nationkey % 2 = 0 AS one_way, n_regionkey = 0 AS is_demo
  FROM nation WHERE n_regionkey < 4)"""


def network_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """camera_id, score and level of congestion of the nodes of ``network`` that have suppliers, by their number."""
    each = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    found = each.select(F.format_string("N%02d", "s_nationkey").alias("camera_id"), (F.col("n") * 7 % 101).cast("double").alias("score"))
    return found.withColumn("level", congestion_level(F.col("score")))


NETWORK_LOAD_SQL = """loads AS (SELECT printf('N%02d', s_nationkey) AS camera_id, (count(*) * 7 % 101)::DOUBLE AS score FROM supplier GROUP BY s_nationkey)"""


_PARTS = {"network_cameras": NETWORK_CAMERAS_SQL, "network_load": NETWORK_LOAD_SQL, "obs": OBS, "edges": EDGES_SQL, "cameras": CAMERAS_SQL, "points": TRAJECTORY, "metrics": METRICS, "samples": SAMPLES, "paths": PATHS_SQL, "network": NETWORK_SQL}


def with_(*names: str) -> str:
    return ("WITH RECURSIVE " if "paths" in names else "WITH ") + ",\n".join(_PARTS[x] for x in names) + "\n"

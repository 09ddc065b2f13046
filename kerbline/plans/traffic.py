"""Queries on metrics, congestion and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions.scores import clamp, confidence_level, congestion_level, weighted_mean
from kerbline.functions.times import bucket_start
from kerbline.operators import congestion, health, metrics
from kerbline.operators.quantiles import medians
from kerbline.operators.travel import baselines, inbound_ratios, segment_samples
from kerbline.plans.registry import query
from kerbline.sources import tables as T


def rollup_sql(where: str = "true") -> str:
    """Measures of metric rows, of those where a condition holds."""
    s = lambda x: f"sum({x}) FILTER (WHERE {where})"
    by_frames = lambda c: f"coalesce({s(f'{c} * frames')} / nullif({s('frames')}, 0), 0.0::DOUBLE)"
    w = "CASE WHEN avg_speed_kmh IS NOT NULL THEN greatest(new_tracks, 1) END"
    return f"""CAST({s("new_tracks")} AS BIGINT) AS vehicles, round({s("new_tracks")} / (CASE WHEN {s("bucket_seconds")} > 0 THEN {s("bucket_seconds")} ELSE 1 END / 60.0::DOUBLE), 2) AS rate_per_min,
  round({s(f"avg_speed_kmh * {w}")} / {s(w)}, 1) AS avg_speed_kmh, round({by_frames("occupancy")}, 4) AS occupancy, round({by_frames("avg_stationary")}, 2) AS queue,
  round({by_frames("avg_vehicles_in_frame")}, 2) AS density, max(max_vehicles_in_frame) FILTER (WHERE {where}) AS max_in_frame, count(*) FILTER (WHERE {where}) AS buckets, CAST({s("bucket_seconds")} AS BIGINT) AS covered_s"""


@query(T.with_("obs", "metrics") + f"SELECT {rollup_sql()} FROM metrics")
def agg_metrics(spark, sf_dir):
    return metrics.rollup(T.hourly(spark, sf_dir))


@query(T.with_("obs", "metrics") + f"SELECT camera_id, {rollup_sql()} FROM metrics GROUP BY camera_id")
def agg_by_camera(spark, sf_dir):
    return metrics.rollup(T.hourly(spark, sf_dir), "camera_id")


@query(T.with_("obs", "metrics") + f"SELECT CAST(floor(start_s / 86400) * 86400 AS BIGINT) AS ts_s, {rollup_sql()} FROM metrics GROUP BY 1")
def agg_timeseries(spark, sf_dir):
    return metrics.time_series(T.hourly(spark, sf_dir), 86_400)


@query(T.with_("obs", "metrics") + f"SELECT camera_id, camera_id IS NULL AS is_total, {rollup_sql()} FROM metrics GROUP BY GROUPING SETS ((camera_id), ())")
def agg_total_and_groups(spark, sf_dir):
    return metrics.totals_and_groups(T.hourly(spark, sf_dir), ["camera_id"], metrics.rollup_columns())


@query("""SELECT l_returnflag, l_linestatus, l_returnflag IS NULL AS is_total, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())""")
def agg_lineitem_totals(spark, sf_dir):
    line = T.read(spark, sf_dir, "lineitem")
    measures = [F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")]
    return metrics.totals_and_groups(line, ["l_returnflag", "l_linestatus"], measures)


@query(T.with_("obs") + "SELECT camera_id, k % 4 AS vehicle_class, count(*) AS n FROM obs GROUP BY ALL")
def agg_class_mix(spark, sf_dir):
    return T.observations(spark, sf_dir).groupBy("camera_id", (F.col("k") % 4).alias("vehicle_class")).agg(F.count("*").alias("n"))


@query(T.with_("obs") + "SELECT camera_id, round(count(plate) / count(*)::DOUBLE, 3) AS plate_read_rate FROM obs GROUP BY camera_id")
def agg_ratio_nonnull(spark, sf_dir):
    return T.observations(spark, sf_dir).groupBy("camera_id").agg(F.round(F.try_divide(F.count("plate"), F.count("*")), 3).alias("plate_read_rate"))


@query(T.with_("obs") + "SELECT camera_id, count(DISTINCT vehicle_id) AS vehicles FROM obs GROUP BY camera_id")
def agg_count_distinct(spark, sf_dir):
    return T.observations(spark, sf_dir).groupBy("camera_id").agg(F.count_distinct("vehicle_id").alias("vehicles"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS severity, count(*) AS n FROM orders GROUP BY ALL")
def agg_group_counts(spark, sf_dir):
    return T.read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("severity")).agg(F.count("*").alias("n"))


@query(T.with_("obs") + "SELECT camera_id, median(speed_kmh) AS median_speed FROM obs GROUP BY camera_id")
def agg_median(spark, sf_dir):
    return medians(T.observations(spark, sf_dir), ["camera_id"], "speed_kmh", "median_speed").drop("samples")


@query(T.with_("obs") + f"SELECT camera_id, count(*) AS last_day FROM obs WHERE t >= {T.NOW - 86400} AND t < {T.NOW} GROUP BY camera_id")
def agg_throughput(spark, sf_dir):
    return T.observations(spark, sf_dir).where((F.col("t") >= T.NOW - 86_400) & (F.col("t") < T.NOW)).groupBy("camera_id").agg(F.count("*").alias("last_day"))


@query(T.with_("obs") + "SELECT camera_id, CAST(floor(t / 900) * 900 AS BIGINT) AS bucket_s, count(*) AS n FROM obs GROUP BY ALL")
def date_bucket(spark, sf_dir):
    return T.observations(spark, sf_dir).groupBy("camera_id", bucket_start(F.col("t"), 900).alias("bucket_s")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN value >= 75 THEN 'SEVERE' WHEN value >= 55 THEN 'HEAVY' WHEN value >= 30 THEN 'MODERATE' ELSE 'FREE' END AS level, CASE WHEN value / 500 >= 0.8 THEN 'HIGH' WHEN value / 500 >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level FROM events")
def math_level(spark, sf_dir):
    return T.read(spark, sf_dir, "events").select("event_id", congestion_level(F.col("value")).alias("level"), confidence_level(F.col("value") / 500).alias("confidence_level"))


@query(T.with_("obs") + """SELECT event_id, round((0.35 * least(1, greatest(0, speed_kmh / 500)) + CASE WHEN k % 3 = 0 THEN 0 ELSE 0.25 * k / 100.0::DOUBLE END) / (0.35 + CASE WHEN k % 3 = 0 THEN 0 ELSE 0.25 END), 6) AS score FROM obs""")
def math_clamp_renorm(spark, sf_dir):
    parts = {"a": (0.35, clamp(F.col("speed_kmh") / 500)), "b": (0.25, F.when(F.col("k") % 3 != 0, F.col("k") / 100))}
    return T.observations(spark, sf_dir).select("event_id", F.round(weighted_mean(parts), 6).alias("score"))


_WINDOW, _BASELINE = 4 * 86_400, 20 * 86_400

_RATIOS = f"""samples_now AS (SELECT from_camera_id AS from_id, camera_id AS to_id, median(segment_travel_s) AS median_s, count(*) AS samples FROM points
  WHERE t >= {T.NOW - _WINDOW} AND t < {T.NOW} AND segment_travel_s IS NOT NULL AND from_camera_id <> camera_id GROUP BY ALL),
history AS (SELECT from_camera_id AS from_id, camera_id AS to_id, median(segment_travel_s) AS median_s, count(*) AS samples FROM points
  WHERE t >= {T.NOW - _BASELINE} AND t < {T.NOW - _WINDOW} AND segment_travel_s IS NOT NULL AND from_camera_id <> camera_id GROUP BY ALL),
base AS (SELECT e.from_id, e.to_id, CASE WHEN coalesce(samples, 0) >= 5 THEN median_s ELSE typical_travel_s END AS seconds, CASE WHEN coalesce(samples, 0) >= 5 THEN 'observed' ELSE 'topology_prior' END AS source, coalesce(samples, 0) AS samples
  FROM edges e LEFT JOIN history h ON h.from_id = e.from_id AND h.to_id = e.to_id WHERE allowed),
ratios AS (SELECT s.to_id AS camera_id, round(sum(s.median_s / greatest(b.seconds, 1) * s.samples) / sum(s.samples), 2) AS travel_ratio FROM samples_now s JOIN base b USING (from_id, to_id) GROUP BY s.to_id)"""


def _ratios(spark, sf_dir):
    points = T.trajectory(spark, sf_dir)
    base = baselines(points, T.edges(spark), T.NOW, _BASELINE, _WINDOW)
    return inbound_ratios(segment_samples(points, T.NOW - _WINDOW, T.NOW), base)


@query(T.with_("obs", "edges", "points") + ", " + _RATIOS + " SELECT * FROM ratios")
def agg_inbound_ratio(spark, sf_dir):
    return _ratios(spark, sf_dir)


_NOW_ROWS = f"start_s >= {T.NOW - _WINDOW}"
_CONGESTION = f"""cur AS (SELECT camera_id, {rollup_sql(_NOW_ROWS)} FROM metrics WHERE start_s >= {T.NOW - _BASELINE} AND start_s < {T.NOW} GROUP BY camera_id),
usual AS (SELECT camera_id, {rollup_sql(f"NOT ({_NOW_ROWS})")} FROM metrics WHERE start_s >= {T.NOW - _BASELINE} AND start_s < {T.NOW} GROUP BY camera_id),
parts AS (SELECT c.camera_id, least(1, greatest(0, 1 - c.avg_speed_kmh / 40)) AS s, least(1, c.occupancy / 0.35) AS o, least(1, c.queue / 6) AS q,
    CASE WHEN u.covered_s >= {2 * _WINDOW} AND u.rate_per_min > 0 THEN least(1, greatest(0, c.rate_per_min / u.rate_per_min - 1)) END AS v, least(1, greatest(0, (r.travel_ratio - 1) / 1.5)) AS tt
  FROM cur c LEFT JOIN usual u USING (camera_id) LEFT JOIN ratios r USING (camera_id) WHERE c.buckets > 0),
scored AS (SELECT camera_id, 100 * (coalesce(0.35 * s, 0) + 0.25 * o + 0.2 * q + coalesce(0.1 * v, 0) + CASE WHEN r IS NULL THEN 0 ELSE 0.1 * tt END)
    / (CASE WHEN s IS NULL THEN 0 ELSE 0.35 END + 0.45 + CASE WHEN v IS NULL THEN 0 ELSE 0.1 END + CASE WHEN r IS NULL THEN 0 ELSE 0.1 END) AS score FROM (SELECT p.*, r.travel_ratio AS r FROM parts p LEFT JOIN ratios r USING (camera_id)))"""


@query(T.with_("obs", "edges", "points", "metrics") + ", " + _RATIOS + ", " + _CONGESTION + """
SELECT camera_id, round(score, 1) AS score, CASE WHEN score >= 75 THEN 'SEVERE' WHEN score >= 55 THEN 'HEAVY' WHEN score >= 30 THEN 'MODERATE' ELSE 'FREE' END AS level FROM scored""")
def an_congestion(spark, sf_dir):
    found = congestion.congestion(T.hourly(spark, sf_dir), _ratios(spark, sf_dir), T.NOW, _WINDOW, _BASELINE)
    return found.select("camera_id", "score", "level")


@query()
def srt_component_rank(spark, sf_dir):
    found = congestion.congestion(T.hourly(spark, sf_dir), _ratios(spark, sf_dir), T.NOW, _WINDOW, _BASELINE)
    return found.select("camera_id", "ranked", "score", "level", *[F.round(f"c_{k}", 3).alias(k) for k in congestion.WEIGHTS])


@query(T.with_("obs", "metrics") + f""", a AS (SELECT camera_id, {rollup_sql()}, round(max(100 * least(1, avg_stationary / 6)), 1) AS peak_queue_score FROM metrics GROUP BY camera_id),
n AS (SELECT camera_id, count(*) AS alerts FROM obs WHERE k >= 95 GROUP BY camera_id),
s AS (SELECT a.*, coalesce(alerts, 0) AS alerts, 100 * (0.25 * least(1, occupancy / 0.35) + 0.2 * least(1, queue / 6) + coalesce(0.35 * greatest(0, 1 - avg_speed_kmh / 40), 0)) / (0.45 + CASE WHEN avg_speed_kmh IS NULL THEN 0 ELSE 0.35 END) AS raw FROM a LEFT JOIN n USING (camera_id))
SELECT camera_id, round(raw, 1) AS score, CASE WHEN raw >= 75 THEN 'SEVERE' WHEN raw >= 55 THEN 'HEAVY' WHEN raw >= 30 THEN 'MODERATE' ELSE 'FREE' END AS level, peak_queue_score, alerts, vehicles, avg_speed_kmh, queue, occupancy,
  CAST(row_number() OVER (ORDER BY round(raw, 1) DESC, alerts DESC, camera_id) AS INTEGER) AS rank FROM s""")
def an_hotspots(spark, sf_dir):
    return congestion.hotspots(T.hourly(spark, sf_dir), T.observations(spark, sf_dir).where("k >= 95"))


@query(T.with_("obs", "metrics") + f""", n AS (SELECT camera_id, count(*) AS alerts FROM obs WHERE k >= 95 GROUP BY camera_id), a AS (SELECT camera_id, {rollup_sql()} FROM metrics GROUP BY camera_id),
s AS (SELECT camera_id, round(100 * (0.25 * least(1, occupancy / 0.35) + 0.2 * least(1, queue / 6) + coalesce(0.35 * greatest(0, 1 - avg_speed_kmh / 40), 0)) / (0.45 + CASE WHEN avg_speed_kmh IS NULL THEN 0 ELSE 0.35 END), 1) AS score FROM a)
SELECT (SELECT count(*) FROM obs) AS observations, (SELECT count(DISTINCT vehicle_id) FROM obs) AS vehicles, (SELECT count(*) FROM obs WHERE k >= 95 AND k % 2 = 0) AS open_alerts,
  (SELECT round(avg(score), 1) FROM s) AS mean_score, (SELECT camera_id FROM s ORDER BY score DESC, camera_id DESC LIMIT 1) AS worst_camera""")
def agg_snapshot(spark, sf_dir):
    obs = T.observations(spark, sf_dir)
    alerts = obs.where("k >= 95").withColumn("status", F.when(F.col("k") % 2 == 0, "NEW").otherwise("RESOLVED"))
    return congestion.snapshot(congestion.hotspots(T.hourly(spark, sf_dir), alerts), obs, alerts)


@query(T.with_("obs") + """SELECT event_id, CASE WHEN t > min(t) OVER w THEN round((count(*) OVER w - 1) / (t - min(t) OVER w), 4) ELSE 0 END AS fps
FROM obs WINDOW w AS (PARTITION BY camera_id ORDER BY t RANGE BETWEEN 1800.0::DOUBLE PRECEDING AND CURRENT ROW)""")
def win_fps(spark, sf_dir):
    return health.fps(T.observations(spark, sf_dir), 1800).select("event_id", "fps")


@query(T.with_("obs", "samples") + """SELECT camera_id, median(blur_score) FILTER (WHERE i <= n // 2) AS early, median(blur_score) FILTER (WHERE i > n // 2) AS late FROM (
  SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY camera_id) AS n FROM samples WHERE blur_score IS NOT NULL) WHERE n >= 4 GROUP BY camera_id""")
def win_split_halves(spark, sf_dir):
    return health.split_halves(T.samples(spark, sf_dir), "blur_score")


@query(T.with_("obs", "samples") + """SELECT camera_id, median(brightness) AS tail FROM (SELECT * FROM samples WHERE brightness IS NOT NULL QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY t DESC, event_id DESC) <= 4) GROUP BY camera_id""")
def win_tail(spark, sf_dir):
    return health.tail_median(T.samples(spark, sf_dir), "brightness")


@query(T.with_("obs", "samples") + """SELECT event_id, CASE WHEN p IS NULL OR frames_dropped < p THEN frames_dropped ELSE frames_dropped - p END AS frames_dropped_delta
FROM (SELECT *, lag(frames_dropped) OVER (PARTITION BY camera_id ORDER BY t, event_id) AS p FROM samples)""")
def win_counter_delta(spark, sf_dir):
    return health.counter_deltas(T.samples(spark, sf_dir), "frames_dropped").select("event_id", "frames_dropped_delta")


@query(T.with_("obs", "samples") + f""", w AS (SELECT * FROM samples WHERE t >= {T.NOW - 5 * 86400} AND t <= {T.NOW}),
h AS (SELECT camera_id, median(blur_score) FILTER (WHERE i <= n // 2) AS early, median(blur_score) FILTER (WHERE i > n // 2) AS late FROM (
  SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY camera_id) AS n FROM w WHERE blur_score IS NOT NULL) WHERE n >= 4 GROUP BY camera_id),
d AS (SELECT camera_id, median(brightness) AS tail FROM (SELECT * FROM w WHERE brightness IS NOT NULL QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY t DESC, event_id DESC) <= 4) GROUP BY camera_id),
b AS (SELECT camera_id, count(*) AS samples, avg(CASE WHEN status IN ('ONLINE', 'DEGRADED') THEN 1.0 ELSE 0.0 END) AS up, max(reconnects) - min(reconnects) AS reconnects, median(processing_fps) FILTER (WHERE processing_fps > 0) AS processing,
  median(input_fps) FILTER (WHERE input_fps > 0) AS input, sum(vehicles_detected)::DOUBLE AS vehicles, sum(plates_read)::DOUBLE AS plates, sum(avg_ocr_confidence * plates_read) FILTER (WHERE plates_read > 0) / sum(plates_read) FILTER (WHERE avg_ocr_confidence IS NOT NULL AND plates_read > 0) AS ocr,
  arg_max(frames_dropped, {{t: t, e: event_id}}) AS dropped, arg_max(frames_processed, {{t: t, e: event_id}}) AS processed FROM w GROUP BY camera_id),
p AS (SELECT b.camera_id, samples, CASE WHEN up < 0.99 THEN (1 - up) * 40 ELSE 0.0::DOUBLE END AS p_availability, CASE WHEN reconnects > 0 THEN least(15, reconnects * 3) ELSE 0 END::DOUBLE AS p_reconnects, CASE WHEN processing < 0.7 * 10 THEN 10.0::DOUBLE ELSE 0 END AS p_processing_fps,
  CASE WHEN input < 5 THEN 8.0::DOUBLE ELSE 0 END AS p_input_fps, CASE WHEN early > 0 AND late < 0.5 * early THEN 15.0::DOUBLE ELSE 0 END AS p_sharpness, CASE WHEN tail < 40 THEN 10.0::DOUBLE ELSE 0 END AS p_brightness,
  CASE WHEN vehicles >= 10 AND plates / vehicles < 0.4 THEN 15 * (1 - plates / vehicles / 0.4) ELSE 0.0::DOUBLE END AS p_plate_read_rate, CASE WHEN ocr < 0.7 THEN (0.7 - ocr) * 40 ELSE 0.0::DOUBLE END AS p_ocr_confidence,
  CASE WHEN dropped > 0 AND processed > 0 AND dropped / processed::DOUBLE > 0.5 THEN 5.0::DOUBLE ELSE 0 END AS p_frame_drops, CASE WHEN b.camera_id = 'error' THEN 30.0::DOUBLE ELSE 0 END AS p_current_status
  FROM b LEFT JOIN h USING (camera_id) LEFT JOIN d USING (camera_id)),
s AS (SELECT *, greatest(0, 100 - (p_availability + p_reconnects + p_processing_fps + p_input_fps + p_sharpness + p_brightness + p_plate_read_rate + p_ocr_confidence + p_frame_drops + p_current_status)) AS raw FROM p)
SELECT camera_id, samples, round(raw, 1) AS score, CASE WHEN raw >= 85 THEN 'GOOD' WHEN raw >= 60 THEN 'FAIR' ELSE 'POOR' END AS grade, round(p_availability, 1) AS p_availability, round(p_reconnects, 1) AS p_reconnects, round(p_processing_fps, 1) AS p_processing_fps,
  round(p_input_fps, 1) AS p_input_fps, round(p_sharpness, 1) AS p_sharpness, round(p_brightness, 1) AS p_brightness, round(p_plate_read_rate, 1) AS p_plate_read_rate, round(p_ocr_confidence, 1) AS p_ocr_confidence, round(p_frame_drops, 1) AS p_frame_drops, round(p_current_status, 1) AS p_current_status FROM s""")
def an_health(spark, sf_dir):
    status = F.when(F.col("camera_id") == "error", "OFFLINE").otherwise("ONLINE")
    cameras = T.cameras(spark).select("camera_id", F.lit(10.0).alias("target_fps"), status.alias("current_status"))
    return health.report(T.samples(spark, sf_dir), cameras, T.NOW, 5 * 86_400)

"""Queries on filters, projections, scalar functions and rules that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import geo, vectors
from kerbline.functions.scores import route_score
from kerbline.operators import alerts, health, search, travel
from kerbline.plans.registry import query
from kerbline.plans.rules import _NEAR_SQL, entries
from kerbline.plans.traffic import _BASELINE, _RATIOS, _WINDOW
from kerbline.sources import audit, changes
from kerbline.sources import tables as T
from kerbline.sources.lineage import shared_path


@query("SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def flt_system_events(spark, sf_dir):
    """The newest fifty of one kind: the limit is the page."""
    return T.read(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query(T.with_("obs", "cameras") + f""", seen AS (SELECT camera_id, max(t) AS t FROM obs WHERE k < 50 GROUP BY camera_id)
SELECT camera_id, CASE WHEN s.t >= {T.NOW} - 86400 THEN 'ONLINE' ELSE 'OFFLINE' END AS status, CAST(count(o.event_id) AS BIGINT) AS sightings FROM cameras LEFT JOIN seen s USING (camera_id) LEFT JOIN obs o USING (camera_id) GROUP BY camera_id, s.t""")
def prj_camera(spark, sf_dir):
    """Cameras with what they last reported: without a report in a day they are shown as offline."""
    counts = T.observations(spark, sf_dir).groupBy("camera_id").agg(F.count("*").alias("sightings"), F.max(F.when(F.col("k") < 50, F.col("t"))).alias("t"))
    status = F.when(F.col("t") >= T.NOW - 86_400, "ONLINE").otherwise("OFFLINE")
    return T.cameras(spark).join(counts, "camera_id", "left").select("camera_id", status.alias("status"), F.coalesce("sightings", F.lit(0)).alias("sightings"))


@query("""SELECT o_custkey AS entry_id, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey HAVING arg_max(o_orderkey % 5 = 0, o_orderkey) = false""")
def dml_watchlist(spark, sf_dir):
    """Entries after all changes in order; the newest change of some deletes them."""
    log = T.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entry_id"), F.col("o_orderkey").alias("n"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 5 == 0).alias("deleted"))
    return changes.current(log, ["entry_id"], ["n"]).select("entry_id", "price")


@query(T.with_("network") + """, fresh AS (SELECT to_id AS from_id, from_id AS to_id FROM edges UNION ALL SELECT from_id, 'new' FROM edges UNION ALL SELECT from_id, to_id FROM edges WHERE to_id < 'N05'), n AS (SELECT from_id, to_id, count(*) AS n FROM fresh GROUP BY ALL)
SELECT f.from_id, f.to_id, n.n > 1 OR e.from_id IS NOT NULL AS refused FROM fresh f JOIN n USING (from_id, to_id) LEFT JOIN edges e ON e.from_id = f.from_id AND e.to_id = f.to_id""")
def dml_edges(spark, sf_dir):
    """New edges of the network: those that exist or are asked for twice are refused."""
    edges = T.network(spark, sf_dir)
    fresh = edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")).unionByName(edges.select("from_id", F.lit("new").alias("to_id"))).unionByName(edges.where("to_id < 'N05'").select("from_id", "to_id"))
    taken, refused = changes.created(edges, fresh, ["from_id", "to_id"])
    return taken.withColumn("refused", F.lit(False)).unionByName(refused.withColumn("refused", F.lit(True)))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.6::DOUBLE WHEN o_orderkey % 4 = 1 THEN 1.0 ELSE round(greatest(0.2, 1 - 0.3::DOUBLE * (o_orderkey % 4)), 6) END AS score FROM orders""")
def math_route_score(spark, sf_dir):
    hops = F.col("o_orderkey") % 4
    return T.read(spark, sf_dir, "orders").select("o_orderkey", F.round(route_score(hops, F.col("o_orderkey") % 3 == 0, hops), 6).alias("score"))


@query("""WITH p AS (SELECT c_custkey, radians(26 + c_custkey % 90 / 100.0::DOUBLE) AS y, radians(26 + c_custkey % 90 / 100.0::DOUBLE + 0.01) AS y2, radians((c_custkey % 7 - 3) / 100.0::DOUBLE) AS dx FROM customer)
SELECT c_custkey, round((degrees(atan2(sin(dx) * cos(y2), cos(y) * sin(y2) - sin(y) * cos(y2) * cos(dx))) + 360) % 360, 4) AS bearing FROM p""")
def geo_bearing(spark, sf_dir):
    y, dx = 26 + F.col("c_custkey") % 90 / 100, (F.col("c_custkey") % 7 - 3) / 100
    return T.read(spark, sf_dir, "customer").select("c_custkey", F.round(geo.bearing_deg(y, F.lit(80.0), y + 0.01, 80 + dx), 4).alias("bearing"))


@query("SELECT vec_id, len(embedding) AS dim, true AS same FROM embeddings")
def vec_codec(spark, sf_dir):
    """Vectors to base64 and back."""
    found = T.read(spark, sf_dir, "embeddings").withColumn("back", vectors.decoded(vectors.encoded(F.col("embedding"))))
    return found.select("vec_id", F.when(F.col("back").isNotNull(), F.size("back")).cast("long").alias("dim"), F.col("back").eqNullSafe(F.col("embedding").cast("array<float>")).alias("same"))


@query(T.with_("obs", "edges", "points") + ", " + _RATIOS + " SELECT s.from_id, s.to_id, s.samples, round(s.median_s / greatest(seconds, 1), 4) AS ratio FROM samples_now s JOIN base USING (from_id, to_id)")
def jn_segment_baseline(spark, sf_dir):
    points = T.trajectory(spark, sf_dir)
    base = travel.baselines(points, T.edges(spark), T.NOW, _BASELINE, _WINDOW)
    found = travel.segment_medians(travel.segment_samples(points, T.NOW - _WINDOW, T.NOW)).join(base.select("from_id", "to_id", "seconds"), ["from_id", "to_id"])
    return found.select("from_id", "to_id", "samples", F.round(F.col("median_s") / F.greatest("seconds", F.lit(1.0)), 4).alias("ratio"))


@query(T.with_("obs", "edges", "points") + ", " + _RATIOS + """ SELECT s.from_id, s.to_id, CASE WHEN s.median_s / greatest(seconds, 1) >= 1.1 THEN 'raise' ELSE 'resolve' END AS action FROM samples_now s JOIN base USING (from_id, to_id)
WHERE s.samples >= 2 AND (s.median_s / greatest(seconds, 1) >= 1.1 OR s.median_s / greatest(seconds, 1) < 1.0)""")
def rl_travel(spark, sf_dir):
    """Raised from one ratio on, recovered below a lower one."""
    points = T.trajectory(spark, sf_dir)
    base = travel.baselines(points, T.edges(spark), T.NOW, _BASELINE, _WINDOW)
    recent = travel.segment_medians(travel.segment_samples(points, T.NOW - _WINDOW, T.NOW)).where("samples >= 2").join(base.select("from_id", "to_id", "seconds"), ["from_id", "to_id"])
    ratio = F.col("median_s") / F.greatest("seconds", F.lit(1.0))
    return recent.select("from_id", "to_id", F.when(ratio >= 1.1, "raise").when(ratio < 1.0, "resolve").alias("action")).where("action is not null")


@query(T.with_("obs") + f""", {_NEAR_SQL} SELECT entry_id, priority AS severity, count(*) AS match_count, max(t) AS last_match_s FROM obs JOIN near USING (plate) JOIN listed l USING (entry_id) GROUP BY entry_id, priority""")
def rl_watchlist(spark, sf_dir):
    """Hits of each entry: how many and when last, with the entry's priority as their severity."""
    hits = search.watchlist_matches(T.observations(spark, sf_dir), search.active_entries(entries(spark), T.NOW), 0.8)
    return hits.groupBy("entry_id", F.col("priority").alias("severity")).agg(F.count("*").alias("match_count"), F.max("t").alias("last_match_s"))


@query("""SELECT 'CAMERA_OFFLINE:' || o_orderkey AS dedup_key, CASE WHEN o_orderstatus = 'F' THEN 'RESOLVED' ELSE 'NEW' END AS status, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS occurrences FROM orders""")
def al_auto_resolve(spark, sf_dir):
    """An alert for each order, raised again for some within the cooldown, and resolved by recoveries."""
    orders = T.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.explode(F.array(F.lit(0.0), F.lit(60.0), F.lit(120.0))).alias("t"))
    action = F.when(F.col("t") == 0, "raise").when((F.col("t") == 60) & (F.col("o_orderkey") % 2 == 0), "raise").when((F.col("t") == 120) & (F.col("o_orderstatus") == "F"), "resolve")
    rows = orders.withColumn("action", action).where("action is not null")
    found = alerts.lifecycle(alerts.raised(rows, "CAMERA_OFFLINE", F.col("o_orderkey").cast("string"), F.col("t"), F.lit("a"), F.col("action")))
    return found.select("dedup_key", "status", "occurrences")


@query(T.with_("obs") + """SELECT event_id, CASE WHEN cy > 109 THEN CASE WHEN share < 0.3 THEN 1 WHEN share < 0.6 THEN 2 ELSE 3 END END AS lane FROM (
  SELECT event_id, k * 10.0 AS cy, (960 + (speed_kmh * 3 - 960) * (1080 - 108) / nullif(k * 10.0 - 108, 0)) / 1920 AS share FROM obs)""")
def geo_lane(spark, sf_dir):
    """Lanes of points all over a frame, three lanes of different widths."""
    return T.observations(spark, sf_dir).select("event_id", geo.lane(F.col("speed_kmh") * 3, F.col("k") * 10.0, (1920.0, 1080.0), (0.5, 0.1), [0.0, 0.3, 0.6, 1.0]).alias("lane"))


@query(T.with_("obs") + """SELECT event_id, round((speed_kmh * 3 - 960) * z / 1500, 6) AS x, round(z, 6) AS z, round((2 * cx + 5) / (0.001 * bottom + 1), 6) AS hx, round((3 * bottom - 1) / (0.001 * bottom + 1), 6) AS hz FROM (
  SELECT event_id, speed_kmh, speed_kmh * 3 AS cx, k * 10.0 AS bottom, 1500 * CASE k % 4 WHEN 0 THEN 1.75 WHEN 1 THEN 2.55 WHEN 2 THEN 0.8 ELSE 1.75 END / greatest(k * 2.0, 1) AS z FROM obs)""")
def geo_ground_xy(spark, sf_dir):
    cx, bottom = F.col("speed_kmh") * 3, F.col("k") * 10.0
    kind = F.element_at(F.array(*[F.lit(x) for x in ("car", "bus", "motorcycle", "tram")]), (F.col("k") % 4 + 1).cast("int"))
    rows = T.observations(spark, sf_dir).select("event_id", geo.ground_m(cx, bottom, F.col("k") * 2.0, kind, 1920.0, 1500.0).alias("p"), geo.ground_by_homography(cx, bottom, [[2.0, 0.0, 5.0], [0.0, 3.0, -1.0], [0.0, 0.001, 1.0]]).alias("h"))
    return rows.select("event_id", F.round("p.x", 6).alias("x"), F.round("p.z", 6).alias("z"), F.round("h.x", 6).alias("hx"), F.round("h.z", 6).alias("hz"))


@query("""SELECT o_orderkey AS t, o_custkey AS user_id, CASE WHEN o_custkey % 3 = 0 THEN 'anonymous' ELSE 'u' || o_custkey END AS username, '{"after":{"Token":"***","note":"' || o_orderpriority || '"},"password":"***"}' AS details, o_orderstatus <> 'F' AS success FROM orders""")
def sink_audit(spark, sf_dir):
    """An act for each order, written to a trail in two runs and read back: secrets are gone at any depth."""
    details = F.struct(F.struct(F.lit("t0").alias("Token"), F.col("o_orderpriority").alias("note")).alias("after"), F.lit("pw").alias("password"))
    acts = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("t"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("u"), "o_custkey")).alias("username"), F.lit(None).cast("string").alias("role"), F.lit("edit").alias("action"), F.lit("order").alias("resource_type"), F.col("o_orderkey").alias("resource_id"), details.alias("details"), F.lit(None).cast("string").alias("ip"), (F.col("o_orderstatus") != "F").alias("success"))
    path = shared_path(spark, "audit")
    audit.record(acts.where("success"), path)
    audit.record(acts.where("not success"), path)
    return audit.trail(spark, path).select(F.col("t").cast("long").alias("t"), "user_id", "username", "details", "success")


_STATES = "CASE WHEN k % 11 < 2 THEN 'OFFLINE' WHEN k % 11 < 4 THEN 'DEGRADED' ELSE 'ONLINE' END"


def _states(spark, sf_dir):
    k = F.col("k") % 11
    status = F.when(k < 2, "OFFLINE").when(k < 4, "DEGRADED").otherwise("ONLINE")
    return T.observations(spark, sf_dir).select("event_id", "t", "camera_id", F.lit(None).cast("string").alias("old_status"), status.alias("status"), F.col("plate").alias("message"), (F.col("k") % 5 == 1).alias("intentional"))


@query(T.with_("obs") + f"""SELECT event_id, CASE WHEN k % 5 = 1 OR s = 'ONLINE' THEN 'INFO' WHEN s = 'DEGRADED' THEN 'WARNING' ELSE 'ERROR' END AS level, '- to ' || s || ': ' || coalesce(plate, '') AS message, k % 5 <> 1 AS alerts
FROM (SELECT *, {_STATES} AS s FROM obs)""")
def st_status_log(spark, sf_dir):
    return health.status_log(_states(spark, sf_dir)).select("event_id", "level", "message", "alerts")


@query(T.with_("obs", "cameras") + f"""SELECT c.camera_id, arg_max(s, {{t: t, e: event_id}}) AS status, arg_max(coalesce(plate, ''), {{t: t, e: event_id}}) AS status_message, max(t) FILTER (WHERE s = 'ONLINE') AS last_seen_s
FROM cameras c LEFT JOIN (SELECT *, {_STATES} AS s FROM obs) o ON o.camera_id = c.camera_id GROUP BY c.camera_id""")
def st_status(spark, sf_dir):
    return health.camera_states(_states(spark, sf_dir), T.cameras(spark))


@query(T.with_("obs").replace("WITH ", "WITH RECURSIVE ", 1) + """, read AS (SELECT camera_id, event_id, t, row_number() OVER w AS i, sum(k % 6) OVER w AS vehicles, sum(k % 3) OVER w AS plates, sum(CASE WHEN k % 3 > 0 THEN k ELSE 0 END) OVER w AS ocr_sum, sum(CASE WHEN k % 3 > 0 THEN 1 ELSE 0 END) OVER w AS ocr_reads
  FROM obs WINDOW w AS (PARTITION BY camera_id ORDER BY t, event_id)),
walk AS (SELECT camera_id, i, t AS at_s, true AS taken FROM read WHERE i = 1
  UNION ALL SELECT r.camera_id, r.i, CASE WHEN r.t - w.at_s >= 21600 THEN r.t ELSE w.at_s END, r.t - w.at_s >= 21600 FROM walk w JOIN read r ON r.camera_id = w.camera_id AND r.i = w.i + 1),
kept AS (SELECT r.* FROM walk JOIN read r USING (camera_id, i) WHERE taken),
grown AS (SELECT camera_id, event_id, t, vehicles - coalesce(lag(vehicles) OVER w, 0) AS v, plates - coalesce(lag(plates) OVER w, 0) AS p, ocr_sum - coalesce(lag(ocr_sum) OVER w, 0) AS c, ocr_reads - coalesce(lag(ocr_reads) OVER w, 0) AS n FROM kept WINDOW w AS (PARTITION BY camera_id ORDER BY i))
SELECT camera_id, event_id, t, CAST(v AS BIGINT) AS vehicles_detected, CAST(p AS BIGINT) AS plates_read, CASE WHEN n > 0 THEN round(c / n, 4) END AS avg_ocr_confidence, CAST(n AS BIGINT) AS ocr_reads FROM grown""")
def st_health(spark, sf_dir):
    """Counters of each camera read at its sightings, sampled every six hours at most."""
    from pyspark.sql.window import Window

    so_far = Window.partitionBy("camera_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    read = F.col("k") % 3 > 0
    counters = T.observations(spark, sf_dir).select("camera_id", "event_id", "t", F.sum(F.col("k") % 6).over(so_far).alias("vehicles"), F.sum(F.col("k") % 3).over(so_far).alias("plates"), F.sum(F.when(read, F.col("k")).otherwise(0)).over(so_far).alias("ocr_sum"), F.sum(F.when(read, 1).otherwise(0)).over(so_far).alias("ocr_reads"))
    return health.sampled(counters, 21_600)

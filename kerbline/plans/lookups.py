"""Queries on joins, filters, projections, paging, set operations, retention and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import geo, scores, times
from kerbline.operators import joins, search
from kerbline.plans.registry import query
from kerbline.sources import tables as T


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def jn_lookup_left(spark, sf_dir):
    nation = T.read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = T.read(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.looked_up(joins.looked_up(T.read(spark, sf_dir, "customer"), nation, ["c_nationkey"]), region, ["n_regionkey"]).select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def jn_semi_scope(spark, sf_dir):
    scope = T.read(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.in_scope(T.read(spark, sf_dir, "orders"), scope, ["o_custkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def jn_anti_orphan(spark, sf_dir):
    return joins.orphans(T.read(spark, sf_dir, "customer"), T.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT n_nationkey, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS supplied FROM nation")
def jn_exists(spark, sf_dir):
    suppliers = T.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(True).alias("supplied")).distinct()
    return T.read(spark, sf_dir, "nation").select("n_nationkey").join(suppliers, "n_nationkey", "left").fillna(False, ["supplied"])


@query(T.with_("obs") + "SELECT event_id, lag(camera_id) OVER w AS previous_camera_id, lag(t) OVER w AS previous_t FROM obs WINDOW w AS (PARTITION BY vehicle_id ORDER BY t, event_id)")
def jn_asof_last(spark, sf_dir):
    return joins.previous(T.observations(spark, sf_dir), ["vehicle_id"], [F.col("t"), F.col("event_id")], ["camera_id", "t"]).select("event_id", "previous_camera_id", "previous_t")


@query(T.with_("obs") + "SELECT a.event_id, b.t AS asof_t, b.event_id AS asof_event_id FROM (SELECT * FROM obs WHERE camera_id = 'purchase') a ASOF LEFT JOIN (SELECT * FROM obs WHERE camera_id = 'view') b ON a.vehicle_id = b.vehicle_id AND a.t >= b.t")
def jn_asof(spark, sf_dir):
    obs = T.observations(spark, sf_dir).select("event_id", "vehicle_id", "t", "camera_id")
    return joins.as_of(obs.where("camera_id = 'purchase'").drop("camera_id"), obs.where("camera_id = 'view'"), ["vehicle_id"], ["event_id"]).select("event_id", "asof_t", "asof_event_id")


@query("""SELECT r_name, f.n AS part_keys, least(f.n, 5) AS kept FROM region, (SELECT count(*) AS n FROM nation) f""")
def jn_cross_small(spark, sf_dir):
    n = T.read(spark, sf_dir, "nation").agg(F.count("*").alias("part_keys"))
    return T.read(spark, sf_dir, "region").select("r_name").join(n, F.lit(True)).withColumn("kept", F.least("part_keys", F.lit(5)))


@query(T.with_("obs") + "SELECT event_id FROM obs WHERE is_demo")
def flt_scope(spark, sf_dir):
    return joins.live_by_default(T.observations(spark, sf_dir), T.cameras(spark), "demo").select("event_id")


@query(T.with_("obs") + f"SELECT event_id, t FROM obs WHERE t >= {T.NOW - 7 * 86400} AND t <= {T.NOW} AND camera_id IN ('view', 'click') AND confidence >= 0.6 AND plate IS NULL")
def flt_search(spark, sf_dir):
    keep = search.conditions(T.NOW - 7 * 86_400, T.NOW, camera_id=["view", "click"], plate=None) & (F.col("confidence") >= 0.6)
    return T.observations(spark, sf_dir).where(keep).select("event_id", "t")


def _described(spark, sf_dir):
    """Sightings with class, colour and level of their match."""
    pick = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), (at % len(names) + 1).cast("int"))
    return T.observations(spark, sf_dir).withColumns({"vehicle_class": pick(["car", "bus", "truck"], F.col("vehicle_id")), "colour": pick(["white", "red"], F.col("k")), "level": pick(["HIGH", "MEDIUM", "LOW", "NEW"], F.col("k"))})


@query(T.with_("obs") + f"""SELECT event_id, t, plate FROM obs WHERE t >= {T.NOW - 7 * 86400} AND t <= {T.NOW} AND camera_id = 'click' AND vehicle_id % 3 = 1 AND k % 2 = 1 AND k % 4 = 1 AND confidence >= 0.6 AND plate IS NOT NULL""")
def flt_search_all(spark, sf_dir):
    """Every filter of the search at once, with the days up to now that it has unless told otherwise."""
    found = search.sightings(_described(spark, sf_dir), T.NOW, least_confidence=0.6, unreadable=False, camera_id="click", vehicle_class="bus", colour="red", level="MEDIUM")
    return found.select("event_id", "t", "plate")


@query(T.with_("obs") + f"SELECT event_id, camera_id FROM obs WHERE t >= {T.NOW - 7 * 86400} AND t < {T.NOW}")
def flt_window_period(spark, sf_dir):
    """A named period, whose end is asked for in the future and so is now."""
    since, until = times.window_of(T.NOW, "7d", until=T.NOW + 86_400)
    return T.observations(spark, sf_dir).where((F.col("t") >= since) & (F.col("t") < until)).select("event_id", "camera_id")


@query(T.with_("obs") + "SELECT event_id, t FROM obs WHERE k % 10 = 0 AND camera_id = 'view' ORDER BY t DESC, event_id DESC LIMIT 20 OFFSET 20")
def flt_dead_letters(spark, sf_dir):
    """The second page of twenty unresolved letters of one camera."""
    letters = T.observations(spark, sf_dir).withColumn("resolved", F.col("k") % 10 != 0)
    return search.newest(letters, 20, 20, camera_id="view", resolved=False).select("event_id", "t")


@query(T.with_("obs", "samples") + "SELECT event_id, t, status, processing_fps FROM samples WHERE camera_id = 'click' ORDER BY t DESC, event_id DESC LIMIT 240")
def flt_health_history(spark, sf_dir):
    return search.newest(T.samples(spark, sf_dir), 240, camera_id="click").select("event_id", "t", "status", "processing_fps")


@query(T.with_("obs") + "SELECT event_id, t FROM obs WHERE camera_id IN ('view', 'error') AND k % 11 < 2 ORDER BY t DESC, event_id DESC LIMIT 100")
def flt_camera_logs(spark, sf_dir):
    log = T.observations(spark, sf_dir).withColumn("level", F.when(F.col("k") % 11 < 2, "ERROR").otherwise("INFO"))
    return search.newest(log, 100, camera_id=["view", "error"], level="ERROR").select("event_id", "t")


@query(T.with_("obs") + "SELECT event_id FROM obs WHERE contains(plate, '001') OR contains('X' || vehicle_id || camera_id, '001')")
def flt_plate_partial(spark, sf_dir):
    obs = T.observations(spark, sf_dir).withColumn("plate_raw", F.concat(F.lit("X"), "vehicle_id", "camera_id"))
    return search.partial_plate(obs, "0-0 1").select("event_id")


@query(T.with_("obs") + ", near AS (SELECT 'UP32AB0008' AS plate, 0.7::DOUBLE AS plate_distance) SELECT event_id, plate_distance FROM obs JOIN near USING (plate)")
def flt_plate_fuzzy(spark, sf_dir):
    return search.fuzzy_plate(T.observations(spark, sf_dir), "UP32AB0OO8", 0.75).select("event_id", "plate_distance")


@query(T.with_("obs") + f"SELECT event_id FROM obs WHERE t >= {T.NOW - 86400} AND t < {T.NOW}")
def flt_window(spark, sf_dir):
    return T.observations(spark, sf_dir).where((F.col("t") >= T.NOW - 86_400) & (F.col("t") < T.NOW)).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT'")
def flt_alerts(spark, sf_dir):
    return T.read(spark, sf_dir, "orders").where("o_orderstatus <> 'F' and o_orderpriority = '1-URGENT'").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%ING%' OR p_type ILIKE '%ING%' OR p_brand ILIKE '%ING%'")
def flt_camera_text(spark, sf_dir):
    return search.text_search(T.read(spark, sf_dir, "part"), "ING", ["p_name", "p_type", "p_brand"]).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-02-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def scan_table(spark, sf_dir):
    line = T.read(spark, sf_dir, "lineitem")
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    return line.where((F.col("l_shipdate") >= day("1998-01-01")) & (F.col("l_shipdate") < day("1998-02-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24)).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE starts_with(o_orderpriority, '1') OR starts_with(o_orderpriority, '2')")
def flt_audit_kind(spark, sf_dir):
    return T.read(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2")).select("o_orderkey")


@query(T.with_("obs") + f"SELECT vehicle_id, count(DISTINCT camera_id) AS cameras FROM obs GROUP BY vehicle_id HAVING count(DISTINCT camera_id) >= 3 AND max(t) >= {T.NOW - 2 * 86400}")
def flt_vehicles(spark, sf_dir):
    return T.observations(spark, sf_dir).groupBy("vehicle_id").agg(F.count_distinct("camera_id").alias("cameras"), F.max("t").alias("t")).where(f"cameras >= 3 and t >= {T.NOW - 2 * 86_400}").drop("t")


@query("SELECT event_id FROM events WHERE event_id > 100 ORDER BY event_id DESC LIMIT 50")
def flt_recent(spark, sf_dir):
    return search.page(T.read(spark, sf_dir, "events").where("event_id > 100").select("event_id"), [F.desc("event_id")], 50)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def srt_order_limit_offset(spark, sf_dir):
    return search.page(T.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 20, 40)


@query("SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 3")
def srt_topk_candidates(spark, sf_dir):
    return joins.top_k(T.read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query(T.with_("obs") + "SELECT vehicle_id, event_id FROM obs QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY confidence DESC, event_id) <= 12")
def srt_keep_best_reads(spark, sf_dir):
    from kerbline.operators.identity import best_reads

    obs = T.observations(spark, sf_dir).select(F.col("vehicle_id").alias("track"), F.col("event_id").alias("read"), "confidence")
    return best_reads(obs).select(F.col("track").alias("vehicle_id"), F.col("read").alias("event_id"))


@query("SELECT l_suppkey, arg_max(l_linenumber, {n: n, l: -l_linenumber}) AS lane FROM (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def srt_mode(spark, sf_dir):
    counts = T.read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    return counts.groupBy("l_suppkey").agg(F.max_by("l_linenumber", F.struct("n", -F.col("l_linenumber"))).alias("lane"))


@query("""SELECT n_nationkey AS key FROM nation UNION SELECT s_nationkey FROM supplier""")
def set_union(spark, sf_dir):
    a, b = T.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key")), T.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"))
    return joins.first_wins(a, b, ["key"]).distinct()


@query("SELECT DISTINCT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf_dir):
    return T.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")).intersect(T.read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, sf_dir):
    return T.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).subtract(T.read(spark, sf_dir, "orders").select("o_custkey"))


@query(T.with_("obs") + "SELECT camera_id, arg_max(speed_kmh, {t: t, e: event_id}) AS speed_kmh, max(t) AS t FROM obs GROUP BY camera_id HAVING max(t) >= 1706500000")
def bus_latest(spark, sf_dir):
    return joins.latest(T.observations(spark, sf_dir), ["camera_id"], "speed_kmh", T.NOW, T.NOW - 1_706_500_000)


@query(T.with_("obs") + "SELECT event_id, CASE WHEN k % 2 = 0 THEN plate END AS plate FROM obs WHERE camera_id IN ('view', 'click') AND k % 2 = 0 UNION ALL SELECT event_id, NULL FROM obs WHERE false")
def ws_filter(spark, sf_dir):
    events = T.observations(spark, sf_dir).where("k % 2 = 0").withColumn("type", F.col("camera_id"))
    return search.visible_events(events, ["view", "click", "error"], ["view", "click", "signup"], raw=True).select("event_id", "plate")


@query(T.with_("obs") + "SELECT event_id, plate FROM obs WHERE camera_id IN ('view', 'click')")
def ws_filter_raw(spark, sf_dir):
    events = T.observations(spark, sf_dir).withColumn("type", F.col("camera_id"))
    return search.visible_events(events, ["view", "click", "error"], ["view", "click", "signup"], raw=True).select("event_id", "plate")


@query(T.with_("obs") + "SELECT event_id, CAST(NULL AS VARCHAR) AS plate FROM obs WHERE camera_id IN ('view', 'click')")
def ws_filter_blanked(spark, sf_dir):
    events = T.observations(spark, sf_dir).withColumn("type", F.col("camera_id"))
    return search.visible_events(events, ["view", "click", "error"], ["view", "click", "signup"], raw=False).select("event_id", "plate")


@query(T.with_("obs") + f"SELECT event_id FROM obs WHERE t >= {T.NOW - 14 * 86400}")
def ret_run(spark, sf_dir):
    obs = T.observations(spark, sf_dir)
    vehicles = obs.groupBy("vehicle_id").agg(F.max("t").alias("last_seen_s"))
    return joins.retention(obs, {}, vehicles, T.NOW, 14)["observations"].select("event_id")


@query(T.with_("obs") + "SELECT event_id FROM obs WHERE NOT is_demo")
def ret_purge_scope(spark, sf_dir):
    return T.observations(spark, sf_dir).where("not is_demo").select("event_id")


@query(T.with_("obs", "cameras") + """SELECT event_id, coalesce(plate, 'unreadable') AS plate_display, speed_kmh IS NOT NULL AS speed_is_estimate, CASE WHEN latitude IS NULL THEN 'OFFLINE' ELSE 'ONLINE' END AS status FROM obs LEFT JOIN cameras USING (camera_id)""")
def prj_views(spark, sf_dir):
    rows = joins.looked_up(T.observations(spark, sf_dir), T.cameras(spark).select("camera_id", "latitude"), ["camera_id"])
    return rows.select("event_id", F.coalesce("plate", F.lit("unreadable")).alias("plate_display"), F.col("speed_kmh").isNotNull().alias("speed_is_estimate"), F.when(F.col("latitude").isNull(), "OFFLINE").otherwise("ONLINE").alias("status"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def props_json(spark, sf_dir):
    return T.observations(spark, sf_dir).select("event_id", "k")


_R = 6_371_008.8


@query(T.with_("network", "network_cameras") + f"""SELECT e.from_id, e.to_id,
  round(2 * {_R}::DOUBLE * asin(sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))), 3) AS distance_m
FROM edges e JOIN cameras a ON a.camera_id = e.from_id JOIN cameras b ON b.camera_id = e.to_id""")
def geo_haversine(spark, sf_dir):
    """As the crow flies along each segment of the network between two cameras."""
    a, b = (T.network_cameras(spark, sf_dir).alias(x) for x in "ab")
    d = geo.haversine_m(*[F.col(c) for c in ("a.latitude", "a.longitude", "b.latitude", "b.longitude")])
    return T.network(spark, sf_dir).join(a, F.col("a.camera_id") == F.col("from_id")).join(b, F.col("b.camera_id") == F.col("to_id")).select("from_id", "to_id", F.round(d, 3).alias("distance_m"))


@query("SELECT event_id, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor((value % 360 + 22.5) / 45) AS INTEGER) % 8 + 1] AS heading, round((value + 180) % 360, 4) AS opposite FROM events")
def geo_compass(spark, sf_dir):
    return T.read(spark, sf_dir, "events").select("event_id", geo.compass(F.col("value")).alias("heading"), F.round(geo.opposite(F.col("value")), 4).alias("opposite"))


@query(T.with_("obs") + """SELECT vehicle_id, CASE WHEN count(*) >= 3 AND max(t) - min(t) >= 0.4 THEN round(sqrt(pow(regr_slope(k, t), 2) + pow(regr_slope(speed_kmh, t), 2)) * 3.6, 8) END AS kmh FROM obs GROUP BY vehicle_id""")
def geo_speed(spark, sf_dir):
    return T.observations(spark, sf_dir).groupBy("vehicle_id").agg(F.round(geo.fitted_speed_kmh(F.col("t"), F.col("k"), F.col("speed_kmh")), 8).alias("kmh"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings),
n AS (SELECT *, sqrt(list_reduce(list_transform(x, lambda c: c * c), lambda a, b: a + b)) AS n FROM v), q AS (SELECT x, n FROM n WHERE vec_id = 0)
SELECT n.vec_id, round(list_reduce(list_transform(list_zip(n.x, q.x), lambda c: c[1] * c[2]), lambda a, b: a + b) / (n.n * q.n + 1e-9), 6) AS cosine FROM n, q""")
def vec_cosine(spark, sf_dir):
    vectors = T.read(spark, sf_dir, "embeddings")
    one = F.broadcast(vectors.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    return vectors.join(one, F.lit(True)).select("vec_id", F.round(scores.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


@query(T.with_("obs") + """SELECT event_id, CASE WHEN a = b THEN 1.0::DOUBLE WHEN (a, b) IN (('white', 'silver'), ('silver', 'white'), ('silver', 'grey'), ('grey', 'silver'), ('red', 'orange'), ('orange', 'red')) THEN 0.4 ELSE 0.0 END AS colour, CASE WHEN c = d THEN 1.0::DOUBLE WHEN c IN ('car', 'truck') AND d IN ('car', 'truck') THEN 0.4 ELSE 0.0 END AS class
FROM (SELECT event_id, ['white', 'silver', 'grey', 'red', 'orange'][k % 5 + 1] AS a, ['white', 'silver', 'grey', 'red', 'orange'][vehicle_id % 5 + 1] AS b, ['car', 'truck', 'motorcycle'][k % 3 + 1] AS c, ['car', 'truck', 'motorcycle'][vehicle_id % 3 + 1] AS d FROM obs)""")
def att_scores(spark, sf_dir):
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i % len(names) + 1).cast("int"))
    colours, classes = ("white", "silver", "grey", "red", "orange"), ("car", "truck", "motorcycle")
    k, v = F.col("k"), F.col("vehicle_id")
    return T.observations(spark, sf_dir).select("event_id", scores.colour_score(pick(colours, k), pick(colours, v)).alias("colour"), scores.class_score(pick(classes, k), pick(classes, v)).alias("class"))


@query(T.with_("obs") + "SELECT event_id, round(CASE WHEN speed_kmh / greatest(k, 1) <= 1 THEN 1 ELSE exp(-pow(ln(speed_kmh / greatest(k, 1)), 2) / (2 * pow(0.8, 2))) END, 6) AS time_score, round(CASE WHEN k % 10 = 0 THEN 0.6 WHEN k % 4 = 1 THEN 1 ELSE greatest(0.2, 1 - 0.3 * (k % 4)) END::DOUBLE, 6) AS route_score FROM obs")
def math_time_score(spark, sf_dir):
    k = F.col("k")
    return T.observations(spark, sf_dir).select("event_id", F.round(scores.time_score(F.col("speed_kmh"), k), 6).alias("time_score"), F.round(scores.route_score(k % 4, k % 10 == 0, k % 4), 6).alias("route_score"))

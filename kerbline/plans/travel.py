"""Queries on trajectories, travel times, the road graph and identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import graph, identity, journeys, travel
from kerbline.plans.registry import query
from kerbline.plans.traffic import _BASELINE, _CONGESTION, _RATIOS, _WINDOW, rollup_sql
from kerbline.sources import tables as T
from kerbline.sources.lineage import cut

_TRIPS = """trips AS (SELECT vehicle_id, journey_index, arg_min(camera_id, seq) AS origin, arg_max(camera_id, seq) AS destination, count(*) AS points, min(t) AS start_s, max(t) AS end_s FROM points GROUP BY ALL),
cells AS (SELECT origin, destination, count(*) AS journeys, round(median(end_s - start_s), 1) AS median_travel_s FROM trips WHERE points >= 2 AND origin <> destination GROUP BY ALL)"""
#: Cells of fewer journeys are suppressed.
SMALL_CELL = 3


@query(T.with_("obs", "points") + ", " + _TRIPS + f" SELECT * FROM cells WHERE journeys >= {SMALL_CELL}")
def agg_od(spark, sf_dir):
    return journeys.od_matrix(T.trajectory(spark, sf_dir), SMALL_CELL)


@query(T.with_("obs", "points") + ", " + _TRIPS + " SELECT CAST(coalesce(sum(journeys), 0) AS BIGINT) AS total_journeys, CAST(coalesce(sum(journeys) FILTER (WHERE journeys < 100), 0) AS BIGINT) AS suppressed_journeys FROM cells")
def agg_od_suppressed(spark, sf_dir):
    return journeys.od_totals(T.trajectory(spark, sf_dir), 100)


@query(T.with_("obs", "points") + ", " + _TRIPS + """ SELECT p.vehicle_id, p.journey_index, any_value(start_s) AS start_s, any_value(end_s) AS end_s, string_agg(camera_id, '>' ORDER BY seq) AS cameras
FROM points p JOIN trips USING (vehicle_id, journey_index) WHERE points >= 2 AND origin = 'view' AND destination = 'purchase' GROUP BY ALL""")
def agg_od_drill(spark, sf_dir):
    return journeys.od_drilldown(T.trajectory(spark, sf_dir), "view", "purchase").withColumn("cameras", F.array_join("cameras", ">"))


@query(T.with_("obs", "points") + "SELECT event_id, seq, journey_index FROM points")
def win_seq(spark, sf_dir):
    return T.trajectory(spark, sf_dir).select("event_id", "seq", "journey_index")


@query(T.with_("obs", "points") + ", " + _TRIPS + " SELECT * FROM trips")
def win_journey(spark, sf_dir):
    return journeys.journeys(T.trajectory(spark, sf_dir))


@query(T.with_("obs", "points") + ", " + _TRIPS.replace("FROM points", "FROM points WHERE camera_id IN ('view', 'click', 'purchase')", 1) + " SELECT * FROM trips")
def win_journey_group(spark, sf_dir):
    kept = T.trajectory(spark, sf_dir).where(F.col("camera_id").isin("view", "click", "purchase"))
    return journeys.journeys(kept)


@query(T.with_("obs", "edges", "points") + """SELECT event_id, from_camera_id, segment_travel_s, round(e.distance_m, 1) AS segment_distance_m, CASE WHEN segment_travel_s > 0 THEN round(round(e.distance_m, 1) / segment_travel_s * 3.6, 1) END AS segment_speed_kmh
FROM points p LEFT JOIN edges e ON e.from_id = p.from_camera_id AND e.to_id = p.camera_id""")
def win_segment(spark, sf_dir):
    return journeys.with_distances(T.trajectory(spark, sf_dir), T.edges(spark)).select("event_id", "from_camera_id", "segment_travel_s", "segment_distance_m", "segment_speed_kmh")


@query(T.with_("obs", "points") + "SELECT from_camera_id AS from_id, camera_id AS to_id, median(segment_travel_s) AS median_s, count(*) AS samples FROM points WHERE segment_travel_s IS NOT NULL AND from_camera_id <> camera_id GROUP BY ALL")
def agg_segment_samples(spark, sf_dir):
    return travel.segment_medians(travel.segment_samples(T.trajectory(spark, sf_dir), 0, 1e12))


@query(T.with_("obs", "edges", "points") + ", " + _RATIOS + " SELECT * FROM base")
def agg_baseline(spark, sf_dir):
    return travel.baselines(T.trajectory(spark, sf_dir), T.edges(spark), T.NOW, _BASELINE, _WINDOW)


@query(T.with_("obs", "edges", "points", "paths") + ", " + _RATIOS + """, hops AS (SELECT from_id, to_id, typical_travel_s, unnest(range(1, len(cameras))) AS i, cameras FROM paths)
SELECT h.from_id, h.to_id, round(CASE WHEN count(*) FILTER (WHERE seconds IS NULL) = 0 AND sum(seconds) > 0 THEN sum(seconds) ELSE any_value(typical_travel_s) END, 4) AS baseline_s
FROM hops h LEFT JOIN base b ON b.from_id = cameras[i] AND b.to_id = cameras[i + 1] GROUP BY h.from_id, h.to_id""")
def agg_path_baseline(spark, sf_dir):
    base = travel.baselines(T.trajectory(spark, sf_dir), T.edges(spark), T.NOW, _BASELINE, _WINDOW)
    return travel.path_seconds(T.paths(spark), base).select("from_id", "to_id", F.round("baseline_s", 4).alias("baseline_s"))


@query(T.with_("obs", "edges", "points") + ", " + _RATIOS + """ SELECT s.from_id, s.to_id, round(s.median_s, 1) AS median_s, round(seconds, 1) AS baseline_s, source AS baseline_source, round(s.median_s / greatest(seconds, 1), 2) AS ratio, s.samples,
  s.median_s / greatest(seconds, 1) >= 1.1 AS anomalous FROM samples_now s JOIN base USING (from_id, to_id) WHERE s.samples >= 2""")
def an_travel_anomaly(spark, sf_dir):
    points = T.trajectory(spark, sf_dir)
    base = travel.baselines(points, T.edges(spark), T.NOW, _BASELINE, _WINDOW)
    return travel.anomalies(points, base, T.NOW, _WINDOW, 1.1, 2)


_START, _END = T.NOW - 3 * 86_400, T.NOW - 86_400


_SITES = """sites AS (SELECT camera_id, role FROM (SELECT 'click' AS camera_id, 'site' AS role UNION SELECT from_id, 'upstream' FROM edges WHERE allowed AND to_id = 'click' UNION SELECT to_id, 'downstream' FROM edges WHERE allowed AND from_id = 'click')
  JOIN cameras USING (camera_id) WHERE is_demo = (SELECT is_demo FROM cameras WHERE camera_id = 'click'))"""


@query(T.with_("obs", "metrics", "edges", "cameras") + f""", {_SITES}, d AS (SELECT camera_id, {rollup_sql(f"start_s >= {_START}")} FROM metrics WHERE start_s >= {2 * _START - _END} AND start_s < {_END} GROUP BY camera_id),
b AS (SELECT camera_id, {rollup_sql(f"start_s < {_START}")} FROM metrics WHERE start_s >= {2 * _START - _END} AND start_s < {_END} GROUP BY camera_id)
SELECT camera_id, role, {", ".join(f"d.{m} AS during_{m}, round(d.{m} - b.{m}, 3) AS delta_{m}" for m in ("rate_per_min", "avg_speed_kmh", "occupancy", "queue"))} FROM d JOIN b USING (camera_id) JOIN sites USING (camera_id)""")
def an_incident(spark, sf_dir):
    sites = travel.incident_sites(T.edges(spark), T.cameras(spark), "click")
    return travel.incident_measures(T.hourly(spark, sf_dir), _START, _END).join(sites, "camera_id")


_SEGMENTS = f"""s AS (SELECT from_camera_id AS from_id, camera_id AS to_id, median(segment_travel_s) FILTER (WHERE t >= {_START}) AS now_s, median(segment_travel_s) FILTER (WHERE t < {_START}) AS prior_s, count(*) FILTER (WHERE t >= {_START}) AS samples
  FROM points WHERE t >= {2 * _START - _END} AND t < {_END} AND segment_travel_s IS NOT NULL AND from_camera_id <> camera_id AND 'click' IN (from_camera_id, camera_id) GROUP BY ALL)"""


@query(T.with_("obs", "edges", "cameras", "points") + f""", {_SITES}, {_SEGMENTS}, lost AS (SELECT count(*) AS segments, round(coalesce(sum(coalesce(greatest(0, now_s - coalesce(prior_s, typical_travel_s)), 0) * samples), 0) / 3600, 3) AS vehicle_hours
  FROM s LEFT JOIN edges e ON e.from_id = s.from_id AND e.to_id = s.to_id WHERE samples > 0)
SELECT 'click' AS camera_id, (SELECT count(DISTINCT vehicle_id) FROM obs WHERE t >= {_START} AND t < {_END} AND camera_id IN (SELECT camera_id FROM sites WHERE role <> 'downstream')) AS vehicles_affected,
  (SELECT count(*) FROM obs WHERE k >= 95 AND t >= {_START} AND t < {_END} AND camera_id IN (SELECT camera_id FROM sites)) AS alerts, segments, vehicle_hours FROM lost""")
def an_incident_impact(spark, sf_dir):
    obs = T.observations(spark, sf_dir)
    return travel.incident_impact(obs, T.trajectory(spark, sf_dir), T.edges(spark), T.cameras(spark), obs.where("k >= 95"), "click", _START, _END).drop("summary")


@query(T.with_("obs", "edges", "points") + f""", s AS (SELECT from_camera_id AS from_id, camera_id AS to_id, median(segment_travel_s) FILTER (WHERE t >= {_START}) AS now_s, median(segment_travel_s) FILTER (WHERE t < {_START}) AS prior_s, count(*) FILTER (WHERE t >= {_START}) AS samples
  FROM points WHERE t >= {2 * _START - _END} AND t < {_END} AND segment_travel_s IS NOT NULL AND from_camera_id <> camera_id AND 'click' IN (from_camera_id, camera_id) GROUP BY ALL)
SELECT s.from_id, s.to_id, round(now_s, 1) AS median_s, round(coalesce(prior_s, typical_travel_s), 1) AS before_s, samples, round(coalesce(greatest(0, now_s - coalesce(prior_s, typical_travel_s)), 0), 1) AS extra_s_per_vehicle,
  coalesce(greatest(0, now_s - coalesce(prior_s, typical_travel_s)), 0) * samples AS extra_s FROM s LEFT JOIN edges e ON e.from_id = s.from_id AND e.to_id = s.to_id WHERE samples > 0""")
def jn_during_before(spark, sf_dir):
    return travel.incident_segments(T.trajectory(spark, sf_dir), T.edges(spark), "click", _START, _END)


@query(T.with_("network", "network_cameras") + "SELECT from_id, to_id, distance_m FROM edges WHERE allowed AND from_id IN (SELECT camera_id FROM cameras) AND to_id IN (SELECT camera_id FROM cameras)")
def gr_build(spark, sf_dir):
    return graph.known(T.network(spark, sf_dir), T.network_cameras(spark, sf_dir)).where("allowed").select("from_id", "to_id", "distance_m")


@query(T.with_("network") + """SELECT camera_id, coalesce((SELECT string_agg(DISTINCT to_id, ',' ORDER BY to_id) FROM edges WHERE from_id = camera_id), '') AS outgoing,
  coalesce((SELECT string_agg(DISTINCT from_id, ',' ORDER BY from_id) FROM edges WHERE to_id = camera_id), '') AS incoming FROM (SELECT from_id AS camera_id FROM edges UNION SELECT to_id FROM edges)""")
def gr_neighbours(spark, sf_dir):
    return graph.neighbours(T.network(spark, sf_dir)).select("camera_id", F.array_join("outgoing", ",").alias("outgoing"), F.array_join("incoming", ",").alias("incoming"))


@query(T.with_("network", "paths") + "SELECT from_id, to_id, cost, array_to_string(cameras, '>') AS cameras, CAST(len(cameras) - 1 AS INTEGER) AS hops, round(min_travel_s, 6) AS min_travel_s, round(typical_travel_s, 6) AS typical_travel_s FROM paths")
def gr_shortest(spark, sf_dir):
    """Paths of up to 24 hops over a network that comes from the tables."""
    return graph.shortest_paths(T.network(spark, sf_dir)).select("from_id", "to_id", "cost", F.array_join("cameras", ">").alias("cameras"), "hops", F.round("min_travel_s", 6).alias("min_travel_s"), F.round("typical_travel_s", 6).alias("typical_travel_s"))


@query(T.with_("network") + """, bare AS (SELECT from_id, to_id, distance_m, CASE WHEN from_id < 'N10' THEN distance_m / 20 END AS least FROM edges),
d AS (SELECT * FROM bare UNION ALL SELECT to_id, from_id, distance_m, least FROM bare e WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.from_id = e.to_id AND x.to_id = e.from_id))
SELECT from_id, to_id, round(coalesce(least, distance_m / 25), 4) AS min_travel_s, round(distance_m / 8.33::DOUBLE, 4) AS typical_travel_s, coalesce(least, distance_m / 25) <= distance_m / 8.33::DOUBLE AS valid FROM d""")
def gr_edge_defaults(spark, sf_dir):
    known = F.when(F.col("from_id") < "N10", F.col("distance_m") / 20)
    bare = T.network(spark, sf_dir).select("from_id", "to_id", "distance_m", known.alias("min_travel_s"), F.lit(None).cast("double").alias("typical_travel_s"))
    return graph.with_defaults(bare, both_ways=True).select("from_id", "to_id", F.round("min_travel_s", 4).alias("min_travel_s"), F.round("typical_travel_s", 4).alias("typical_travel_s"), "valid")


@query(T.with_("network", "network_cameras") + """SELECT e.from_id, e.to_id, a.longitude AS x1, a.latitude AS y1, b.longitude AS x2, b.latitude AS y2, 'LineString' AS kind, distance_m FROM edges e JOIN cameras a ON a.camera_id = e.from_id JOIN cameras b ON b.camera_id = e.to_id""")
def gr_geojson_fields(spark, sf_dir):
    """The features of ``gr_geojson`` read back from their text."""
    found = graph.geojson(T.network(spark, sf_dir), T.network_cameras(spark, sf_dir))
    at = lambda path: F.get_json_object("feature", path)
    places = {f"{c}{i + 1}": at(f"$.geometry.coordinates[{i}][{j}]").cast("double") for i in (0, 1) for j, c in enumerate("xy")}
    return found.select("from_id", "to_id", *[v.alias(k) for k, v in places.items()], at("$.geometry.type").alias("kind"), at("$.properties.distance_m").cast("double").alias("distance_m"))


@query()
def gr_geojson(spark, sf_dir):
    return graph.geojson(T.network(spark, sf_dir), T.network_cameras(spark, sf_dir))


def _route_sql(origin: str, destination: str, cost: str) -> str:
    """CTE of all simple paths between two cameras over ``priced`` (from_id, to_id, and the cost)."""
    return f"""routes AS (
  SELECT to_id AS here, {cost} AS cost, [from_id, to_id] AS cameras, distance_m FROM priced WHERE from_id = '{origin}'
  UNION ALL SELECT e.to_id, r.cost + e.{cost}, list_append(r.cameras, e.to_id), r.distance_m + e.distance_m FROM routes r JOIN priced e ON e.from_id = r.here WHERE r.here <> '{destination}' AND NOT list_contains(r.cameras, e.to_id)),
complete AS (SELECT * FROM routes WHERE here = '{destination}'),
cheapest AS (SELECT * FROM complete ORDER BY cost, cameras LIMIT 1)"""


def _corridor_parts(spark, sf_dir):
    from kerbline.operators import congestion
    from kerbline.plans.traffic import _ratios

    base = travel.baselines(T.trajectory(spark, sf_dir), T.edges(spark), T.NOW, _BASELINE, _WINDOW)
    return base, congestion.congestion(T.hourly(spark, sf_dir), _ratios(spark, sf_dir), T.NOW, _WINDOW, _BASELINE)


_PRICED = """levels AS (SELECT camera_id, round(score, 1) AS score, CASE WHEN score >= 75 THEN 'SEVERE' WHEN score >= 55 THEN 'HEAVY' WHEN score >= 30 THEN 'MODERATE' ELSE 'FREE' END AS level FROM scored),
priced AS (SELECT e.*, seconds, level, seconds * (1 + coalesce(l.score, 0) / 100) AS load_cost FROM edges e JOIN base b ON b.from_id = e.from_id AND b.to_id = e.to_id LEFT JOIN levels l ON l.camera_id = e.to_id WHERE allowed)"""


@query(T.with_("obs", "edges", "points", "metrics").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _RATIOS + ", " + _CONGESTION + ", " + _PRICED + ", " + _route_sql("error", "signup", "load_cost") + """,
steps AS (SELECT cameras, unnest(range(0, len(cameras))) AS position FROM cheapest),
timed AS (SELECT CAST(position AS INTEGER) AS position, cameras[position + 1] AS camera_id, seconds, min_travel_s, level FROM steps LEFT JOIN priced p ON position > 0 AND p.from_id = cameras[position] AND p.to_id = cameras[position + 1])
SELECT position, camera_id, round(sum(coalesce(seconds, 0)) OVER w, 1) AS eta_s, round(sum(coalesce(greatest(min_travel_s, seconds * 0.65), 0)) OVER w, 1) AS eta_with_priority_s,
  CASE WHEN position = 0 THEN 'dispatch' WHEN level IN ('HEAVY', 'SEVERE') THEN 'clear the queue' WHEN level = 'MODERATE' THEN 'prepare a green wave' ELSE 'monitor' END AS advice FROM timed WINDOW w AS (ORDER BY position)""")
def gr_corridor(spark, sf_dir):
    return graph.corridor(T.edges(spark), *_corridor_parts(spark, sf_dir), "error", "signup")


_AVOIDING = """mids AS (SELECT unnest(cameras[2:len(cameras) - 1]) AS mid FROM cheapest),
avoiding AS (SELECT mid, c.* FROM mids, complete c WHERE NOT list_contains(c.cameras, mid) QUALIFY row_number() OVER (PARTITION BY mid ORDER BY cost, cameras) = 1)
SELECT array_to_string(cameras, '>') AS cameras, min(mid) AS avoids, min(cost) AS cost, min(distance_m) AS distance_m FROM avoiding GROUP BY cameras"""


@query(T.with_("network").replace("WITH ", "WITH RECURSIVE ", 1) + ", priced AS (SELECT * FROM edges), " + _route_sql("N00", "N18", "typical_travel_s") + ", " + _AVOIDING)
def gr_alternatives(spark, sf_dir):
    return graph.alternatives(T.network(spark, sf_dir), "typical_travel_s", "N00", "N18").withColumn("cameras", F.array_join("cameras", ">"))


@query(T.with_("network", "network_load").replace("WITH ", "WITH RECURSIVE ", 1) + ", priced AS (SELECT e.*, typical_travel_s * (1 + coalesce(score, 0) / 100) AS load_cost FROM edges e LEFT JOIN loads ON camera_id = to_id), " + _route_sql("N00", "N18", "load_cost") + ", "
    + _AVOIDING.replace("SELECT array_to_string(cameras, '>') AS cameras, min(mid)", ", options AS (SELECT cameras, NULL::VARCHAR AS avoids, cost, distance_m FROM cheapest UNION ALL SELECT cameras, min(mid)", 1).replace("GROUP BY cameras", "GROUP BY cameras)") + """
SELECT array_to_string(cameras, '>') AS cameras, avoids, round(cost, 6) AS cost, distance_m FROM options""")  # fmt: skip
def gr_corridor_options(spark, sf_dir):
    """The ways of a corridor by load cost: the cheapest, and around each of its cameras."""
    network = T.network(spark, sf_dir)
    base = network.select("from_id", "to_id", F.col("typical_travel_s").alias("seconds"))
    found = graph.corridor_options(network, base, T.network_load(spark, sf_dir), "N00", "N18")
    return found.select(F.array_join("cameras", ">").alias("cameras"), "avoids", F.round("cost", 6).alias("cost"), "distance_m")


#: Transitions of the last day before the time that queries take as now count for predictions.
_SINCE = T.NOW - 86_400
_TRANSITIONS = f"transitions AS (SELECT from_camera_id AS from_id, camera_id AS to_id, count(*) AS n FROM points WHERE from_camera_id IS NOT NULL AND from_camera_id <> camera_id AND t >= {_SINCE} GROUP BY ALL)"
_PREDICTED = """arrivals AS (SELECT DISTINCT camera_id, from_camera_id AS came_from FROM points),
exits AS (SELECT e.*, coalesce(n, 0) AS n, count(*) OVER (PARTITION BY e.from_id) AS of_all FROM edges e LEFT JOIN transitions t ON t.from_id = e.from_id AND t.to_id = e.to_id WHERE allowed),
predicted AS (SELECT *, row_number() OVER (PARTITION BY from_id, came_from ORDER BY probability DESC, to_id) = 1 AS best FROM (
  SELECT from_id, came_from, to_id, n, (n + 1) / (sum(n) OVER w + count(*) OVER w)::DOUBLE AS probability, min_travel_s AS window_start_s, greatest(2.5 * typical_travel_s, min_travel_s + 60) AS window_end_s
  FROM exits JOIN arrivals ON camera_id = from_id WHERE of_all = 1 OR came_from IS DISTINCT FROM to_id WINDOW w AS (PARTITION BY from_id, came_from)))"""


@query(T.with_("obs", "points") + ", " + _TRANSITIONS + " SELECT * FROM transitions")
def agg_transitions(spark, sf_dir):
    return journeys.transitions(T.trajectory(spark, sf_dir), _SINCE)


def _predicted(spark, sf_dir):
    points = T.trajectory(spark, sf_dir)
    return points, journeys.next_camera(journeys.transitions(points, _SINCE), T.edges(spark), points)


@query(T.with_("obs", "edges", "points") + ", " + _TRANSITIONS + ", " + _PREDICTED + " SELECT from_id, came_from, to_id, n, round(probability, 6) AS probability, best, window_start_s, window_end_s FROM predicted")
def gr_predict(spark, sf_dir):
    return _predicted(spark, sf_dir)[1].select("from_id", "came_from", "to_id", "n", F.round("probability", 6).alias("probability"), "best", "window_start_s", "window_end_s")


_STATUS = f"""statuses AS (SELECT event_id, camera_id, CASE WHEN next_t IS NULL THEN CASE WHEN {T.NOW} > t + window_end_s + 30 THEN 'EXPIRED' ELSE 'PENDING' END
  WHEN next_j = journey_index AND next_c = to_id AND next_t <= t + window_end_s + 30 THEN 'CONFIRMED' ELSE 'DEVIATED' END AS status
  FROM (SELECT *, lead(t) OVER w AS next_t, lead(camera_id) OVER w AS next_c, lead(journey_index) OVER w AS next_j FROM points WINDOW w AS (PARTITION BY vehicle_id ORDER BY seq)) p
  JOIN predicted ON best AND from_id = camera_id AND came_from IS NOT DISTINCT FROM from_camera_id)"""


@query(T.with_("obs", "edges", "points") + ", " + _TRANSITIONS + ", " + _PREDICTED + ", " + _STATUS + " SELECT event_id, status FROM statuses")
def gr_predict_status(spark, sf_dir):
    return journeys.prediction_status(*_predicted(spark, sf_dir), T.NOW).select("event_id", "status")


@query(T.with_("obs", "edges", "points") + ", " + _TRANSITIONS + ", " + _PREDICTED + ", " + _STATUS + " SELECT camera_id, count(*) FILTER (WHERE status = 'CONFIRMED') AS confirmed, round(count(*) FILTER (WHERE status = 'CONFIRMED') / nullif(count(*) FILTER (WHERE status IN ('CONFIRMED', 'DEVIATED')), 0)::DOUBLE, 3) AS accuracy FROM statuses GROUP BY camera_id")
def agg_prediction_accuracy(spark, sf_dir):
    found = journeys.prediction_status(*_predicted(spark, sf_dir), T.NOW)
    hit, known = F.count(F.when(F.col("status") == "CONFIRMED", 1)), F.count(F.when(F.col("status").isin("CONFIRMED", "DEVIATED"), 1))
    return found.groupBy("camera_id").agg(hit.alias("confirmed"), F.round(F.try_divide(hit, known), 3).alias("accuracy"))


@query(T.with_("obs", "points") + """SELECT vehicle_id, min(t) AS first_seen_s, max(t) AS last_seen_s, arg_min(camera_id, seq) AS first_camera_id, arg_max(camera_id, seq) AS last_camera_id, count(*) AS observation_count,
  count(DISTINCT camera_id) AS camera_count, arg_max(plate, {c: confidence, s: seq}) FILTER (WHERE plate IS NOT NULL) AS plate_text FROM points GROUP BY vehicle_id""")
def id_vehicle_upsert(spark, sf_dir):
    points = T.trajectory(spark, sf_dir).withColumn("confidence", F.when(F.col("plate").isNotNull(), F.col("confidence")))
    return journeys.vehicle_summary(points)


@query(T.with_("obs", "points") + """, legs AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL THEN 0 ELSE least(t - lag(t) OVER w, 3600) END AS leg_s, coalesce(journey_index <> lag(journey_index) OVER w, false) AS is_break FROM points WINDOW w AS (PARTITION BY vehicle_id ORDER BY seq))
SELECT event_id, is_break, round(sum(leg_s) OVER (PARTITION BY vehicle_id ORDER BY seq), 3) AS virtual_s FROM legs""")
def win_timeline(spark, sf_dir):
    return journeys.replay_timeline(T.trajectory(spark, sf_dir), 3600).select("event_id", "is_break", F.round("virtual_s", 3).alias("virtual_s"))


@query(T.with_("obs", "cameras", "points") + """, legs AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL THEN 0 ELSE least(t - lag(t) OVER w, 3600) END AS leg_s FROM points WINDOW w AS (PARTITION BY vehicle_id ORDER BY seq)),
timeline AS (SELECT vehicle_id, seq, sum(leg_s) OVER (PARTITION BY vehicle_id ORDER BY seq) AS v0, latitude AS lat0, longitude AS lon0 FROM legs JOIN cameras USING (camera_id)),
spans AS (SELECT *, lead(v0) OVER w AS v1, lead(lat0) OVER w AS lat1, lead(lon0) OVER w AS lon1 FROM timeline WINDOW w AS (PARTITION BY vehicle_id ORDER BY seq)),
asked AS (SELECT DISTINCT vehicle_id, unnest([1800.0::DOUBLE, 36000.0, 90000.5]) AS v FROM obs)
SELECT vehicle_id, v, seq, round(lat0 + coalesce((v - v0) / nullif(v1 - v0, 0), 0) * coalesce(lat1 - lat0, 0), 6) AS latitude, round(lon0 + coalesce((v - v0) / nullif(v1 - v0, 0), 0) * coalesce(lon1 - lon0, 0), 6) AS longitude
FROM asked JOIN spans USING (vehicle_id) WHERE v >= v0 AND (v < v1 OR v1 IS NULL)""")
def win_position_at(spark, sf_dir):
    points = T.trajectory(spark, sf_dir)
    asked = points.select("vehicle_id").distinct().withColumn("v", F.explode(F.array(F.lit(1800.0), F.lit(36_000.0), F.lit(90_000.5))))
    found = journeys.position_at(journeys.replay_timeline(points, 3600), asked, T.cameras(spark))
    return found.select("vehicle_id", "v", "seq", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query(T.with_("obs", "cameras", "points") + """SELECT vehicle_id, journey_index, string_agg(latitude || ' ' || longitude, ',' ORDER BY seq) AS line FROM points JOIN cameras USING (camera_id) GROUP BY ALL""")
def jn_traj_geometry(spark, sf_dir):
    place = T.cameras(spark).select("camera_id", F.concat_ws(" ", "latitude", "longitude").alias("at"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "at"))), lambda x: x["at"]), ",")
    return T.trajectory(spark, sf_dir).join(place, "camera_id").groupBy("vehicle_id", "journey_index").agg(line.alias("line"))


def _identity_rows(spark, sf_dir):
    """Sightings with colours and classes from their numbers; of four in five the vector of the vehicle's number, from one of two models."""
    colours = F.element_at(F.array(*[F.lit(c) for c in ("white", "silver", "grey", "black", "red")]), (F.col("k") % 5 + 1).cast("int"))
    classes = F.element_at(F.array(*[F.lit(c) for c in ("car", "truck", "motorcycle")]), (F.col("vehicle_id") % 3 + 1).cast("int"))
    vectors = T.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vehicle_id"), "embedding")
    rows = T.observations(spark, sf_dir).join(vectors, "vehicle_id", "left")
    return rows.select(
        "event_id", F.col("is_demo").alias("scope"), "t", "camera_id", "plate", "confidence", classes.alias("vehicle_class"), colours.alias("colour"), F.when(F.col("k") % 5 != 4, F.col("embedding")).alias("embedding"),
        F.when(F.col("k") % 3 == 0, "color_histogram").otherwise("deep").alias("embedding_model"),
    )


@query(T.with_("obs") + """, near AS (SELECT a.event_id, b.event_id AS p_event_id FROM obs a JOIN obs b ON a.is_demo = b.is_demo AND a.event_id <> b.event_id AND b.t >= a.t - 3600 AND (b.t < a.t OR b.t = a.t AND b.event_id < a.event_id)
  QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY b.t DESC, b.event_id DESC) <= 200),
alike AS (SELECT event_id, unnest(list(event_id) OVER (PARTITION BY is_demo, plate ORDER BY t, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) AS p_event_id FROM obs WHERE plate IS NOT NULL)
SELECT * FROM near UNION SELECT * FROM alike""")
def jn_candidates(spark, sf_dir):
    """The pairs that identities are resolved from at first."""
    return identity.candidate_ids(_identity_rows(spark, sf_dir)).select("event_id", "p_event_id")


def _resolved(spark, sf_dir):
    base = travel.baselines(T.trajectory(spark, sf_dir), T.edges(spark), T.NOW, _BASELINE, _WINDOW)
    ways = cut(identity.ways(cut(T.paths(spark)), base))
    score = lambda pairs: identity.scored(pairs, ways, gap_s=T.GAP_S)
    return identity.resolved(cut(_identity_rows(spark, sf_dir)), score, guess=identity.guesses(ways, T.GAP_S))


@query()
def id_score(spark, sf_dir):
    return _resolved(spark, sf_dir)[1].select("event_id", "p_event_id", "p_vehicle", F.round("score", 4).alias("score"), "strong", "new_journey", "rejected")


@query()
def srt_best_runnerup(spark, sf_dir):
    return identity.decisions(_resolved(spark, sf_dir)[1])


@query()
def id_resolve(spark, sf_dir):
    return _resolved(spark, sf_dir)[0]


@query()
def id_conflicts(spark, sf_dir):
    return identity.conflicts(_resolved(spark, sf_dir)[1])


@query()
def str_explain(spark, sf_dir):
    return identity.explained(_resolved(spark, sf_dir)[1]).select("event_id", "p_event_id", "why")

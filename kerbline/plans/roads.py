"""Queries on trajectories along the roads of the network of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.operators import graph, journeys, roads
from kerbline.plans.registry import query
from kerbline.sources import tables as T
from kerbline.sources.lineage import cut

#: Edges from nodes of even number bend, with a vertex told twice; the others have no line of their own.
_LINES = """places AS (
  SELECT printf('N%02d', n_nationkey) AS camera_id, n_nationkey AS number, round(26.8::DOUBLE + 0.1::DOUBLE * sin(radians(n_nationkey * 14.4::DOUBLE)), 6) AS lat, round(80.9::DOUBLE + 0.1::DOUBLE * cos(radians(n_nationkey * 14.4::DOUBLE)), 6) AS lon FROM nation),
ends AS (SELECT e.from_id, e.to_id, a.number % 2 = 0 AS bent, a.lat AS lat0, a.lon AS lon0, b.lat AS lat1, b.lon AS lon1 FROM edges e JOIN places a ON a.camera_id = e.from_id JOIN places b ON b.camera_id = e.to_id),
vertices AS (
  SELECT from_id, to_id, 0 AS j, lat0 AS lat, lon0 AS lon FROM ends UNION ALL SELECT from_id, to_id, 3, lat1, lon1 FROM ends
  UNION ALL SELECT from_id, to_id, unnest([1, 2]), round((lat0 + 2 * lat1) / 3 + 0.01::DOUBLE, 6), round((lon0 + 2 * lon1) / 3 - 0.02::DOUBLE, 6) FROM ends WHERE bent),
hops AS (SELECT from_id, to_id, unnest(range(1, len(cameras))) AS i, cameras FROM paths),
laid AS (SELECT h.from_id, h.to_id, i, j, lat, lon FROM hops h JOIN vertices v ON v.from_id = h.cameras[i] AND v.to_id = h.cameras[i + 1] WHERE i = 1 OR j > 0)"""

_SEEN = """seen AS (SELECT * REPLACE (printf('N%02d', k % 25) AS camera_id) FROM obs),
""" + T.TRAJECTORY.replace("FROM obs", "FROM seen")


def _points(spark, sf_dir):
    """Trajectories of ``events`` over the nodes of the network."""
    seen = T.observations(spark, sf_dir).withColumn("camera_id", F.format_string("N%02d", F.col("k") % 25))
    return journeys.trajectory(seen, T.GAP_S)


def _places(spark, sf_dir):
    angle = F.radians(F.col("n_nationkey") * 14.4)
    return T.read(spark, sf_dir, "nation").select(F.format_string("N%02d", "n_nationkey").alias("camera_id"), F.round(26.8 + 0.1 * F.sin(angle), 6).alias("latitude"), F.round(80.9 + 0.1 * F.cos(angle), 6).alias("longitude"))


def _routes(spark, sf_dir):
    edges, places = cut(T.network(spark, sf_dir)), _places(spark, sf_dir)
    end = lambda e: places.select(F.col("camera_id").alias(f"{e}_id"), F.array("latitude", "longitude").alias(e))
    bend = F.array(F.round((F.col("from")[0] + 2 * F.col("to")[0]) / 3 + 0.01, 6), F.round((F.col("from")[1] + 2 * F.col("to")[1]) / 3 - 0.02, 6))
    bent = edges.join(end("from"), "from_id").join(end("to"), "to_id").withColumn("path", F.when(F.substring("from_id", 2, 2).cast("int") % 2 == 0, F.array("from", bend, bend, "to")))
    return cut(roads.routes(graph.shortest_paths(edges), roads.edge_lines(bent, places), places))


@query(T.with_("obs", "network", "paths") + ", " + _SEEN + ", " + _LINES + """, lines AS (SELECT from_id, to_id, string_agg(lat || ' ' || lon, ',' ORDER BY i, j) AS line FROM laid GROUP BY ALL)
SELECT vehicle_id, journey_index, seq, line, len(cameras) - 2 AS passed FROM points JOIN lines ON from_id = from_camera_id AND to_id = camera_id JOIN paths USING (from_id, to_id)""")
def jn_traj_roads(spark, sf_dir):
    """Each leg of a trajectory with the line of the roads it takes, joined where edges meet, and the number of cameras passed."""
    found = roads.segments(_points(spark, sf_dir), _routes(spark, sf_dir), _places(spark, sf_dir))
    line = F.array_join(F.transform("line", lambda p: F.concat_ws(" ", p[0], p[1])), ",")
    return found.select("vehicle_id", "journey_index", "seq", line.alias("line"), F.size("via").cast("long").alias("passed"))


@query(T.with_("obs", "network", "paths") + ", " + _SEEN + ", " + _LINES + """, steps AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM laid WINDOW w AS (PARTITION BY from_id, to_id ORDER BY i, j)),
apart AS (SELECT *, coalesce(6371008.8 * sqrt(pow(radians(lat - lat0), 2) + pow(radians(lon - lon0) * cos(radians((lat + lat0) / 2)), 2)), 0) AS step FROM steps WHERE lat0 IS NULL OR lat <> lat0 OR lon <> lon0),
way AS (SELECT *, sum(step) OVER w AS m, sum(step) OVER (PARTITION BY from_id, to_id) AS total, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1, lead(step) OVER w AS ahead FROM apart WINDOW w AS (PARTITION BY from_id, to_id ORDER BY i, j)),
legs AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL THEN 0 ELSE least(t - lag(t) OVER w, 3600) END AS leg_s FROM points WINDOW w AS (PARTITION BY vehicle_id ORDER BY seq)),
timeline AS (SELECT *, sum(leg_s) OVER (PARTITION BY vehicle_id ORDER BY seq) AS v0 FROM legs),
spans AS (SELECT *, lead(v0) OVER w AS v1, lead(camera_id) OVER w AS next_camera, coalesce(lead(journey_index) OVER w = journey_index, false) AS road FROM timeline WINDOW w AS (PARTITION BY vehicle_id ORDER BY seq)),
asked AS (SELECT vehicle_id, unnest([-5.0::DOUBLE, max(v0) * 0.37, max(v0) * 0.81, max(v0) + 10]) AS v FROM timeline GROUP BY vehicle_id),
met AS (SELECT a.vehicle_id, v, seq, camera_id, next_camera, road, coalesce((greatest(v, 0) - v0) / (v1 - v0), 0) AS share FROM asked a JOIN spans s ON a.vehicle_id = s.vehicle_id AND greatest(v, 0) >= v0 AND (greatest(v, 0) < v1 OR v1 IS NULL)),
spots AS (SELECT vehicle_id, seq, v, arg_max(w.lat + (w.lat1 - w.lat) * (total * share - m) / ahead, m) AS lat, arg_max(w.lon + (w.lon1 - w.lon) * (total * share - m) / ahead, m) AS lon
  FROM met JOIN way w ON w.from_id = camera_id AND w.to_id = next_camera WHERE share > 0 AND road AND m <= total * share AND lat1 IS NOT NULL GROUP BY ALL)
SELECT vehicle_id, seq, round(v, 3) AS v, CASE WHEN share <= 0 THEN 'stop' WHEN road THEN 'road' ELSE 'gap' END AS kind, round(coalesce(s.lat, p.lat), 6) AS latitude, round(coalesce(s.lon, p.lon), 6) AS longitude
FROM met JOIN places p USING (camera_id) LEFT JOIN spots s USING (vehicle_id, seq, v)""")
def win_position_road(spark, sf_dir):
    """Where each vehicle is before its replay begins, at two shares of it and after it, along bent roads."""
    timeline = journeys.replay_timeline(_points(spark, sf_dir), 3600)
    whole = timeline.groupBy("vehicle_id").agg(F.max("virtual_s").alias("s"))
    asked = whole.select("vehicle_id", F.explode(F.array(F.lit(-5.0), F.col("s") * 0.37, F.col("s") * 0.81, F.col("s") + 10)).alias("v"))
    found = roads.position_at(timeline, asked, _routes(spark, sf_dir), _places(spark, sf_dir))
    return found.select("vehicle_id", "seq", F.round("v", 3).alias("v"), "kind", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query(T.with_("network") + ", " + _LINES.split(",\nvertices")[0] + """ SELECT from_id, to_id, round(6371008.8 * sqrt(pow(radians(lat1 - lat0), 2) + pow(radians(lon1 - lon0) * cos(radians((lat0 + lat1) / 2)), 2)), 3) AS metres FROM ends""")
def geo_planar(spark, sf_dir):
    """Lengths of the network's edges on a plane scaled by the cosine of the latitude."""
    at = lambda e: _places(spark, sf_dir).select(F.col("camera_id").alias(f"{e}_id"), F.col("latitude").alias(f"{e}_lat"), F.col("longitude").alias(f"{e}_lon"))
    ends = T.network(spark, sf_dir).join(at("from"), "from_id").join(at("to"), "to_id")
    return ends.select("from_id", "to_id", F.round(geo.planar_m(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon")), 3).alias("metres"))

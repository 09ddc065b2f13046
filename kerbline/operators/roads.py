"""Trajectories along roads: the lines of paths, their lengths, and places on them at a virtual time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.functions.geo import planar_m
from kerbline.operators.joins import as_of

#: Degrees up to which two vertices are one.
SAME_DEG = 1e-9


def edge_lines(edges: DataFrame, cameras: DataFrame) -> DataFrame:
    """from_id, to_id and line of each edge: its ``path`` of (lat, lon), or where it has none the straight line of its ends.

    An edge without a path whose end has no place has no line and is left out.
    """
    at = lambda end: cameras.select(F.col("camera_id").alias(f"{end}_id"), F.array("latitude", "longitude").alias(f"_{end}"))
    placed = edges.select("from_id", "to_id", "path").join(at("from"), "from_id", "left").join(at("to"), "to_id", "left")
    straight = F.when(F.col("_from").isNotNull() & F.col("_to").isNotNull(), F.array("_from", "_to"))
    return placed.select("from_id", "to_id", F.when(F.size("path") > 0, F.col("path")).otherwise(straight).alias("line")).where("line is not null")


def routes(paths: DataFrame, lines: DataFrame, cameras: DataFrame) -> DataFrame:
    """Of each two ends of ``paths`` (from_id, to_id, cameras): line, way and via.

    ``line`` is the vertices of its edges' lines, in which the first vertex of each but the first edge is dropped. ``way`` is
    that line from the one camera's place to the other's, without repeated vertices, each with the metres up to it. ``via``
    is the cameras passed between. A route's vertices are summed in one window: they are a path's, not the traffic's.
    """
    n = F.size("cameras")
    hops = paths.select("from_id", "to_id", F.slice("cameras", 2, F.greatest(n - 2, F.lit(0))).alias("via"), F.posexplode(F.arrays_zip(F.slice("cameras", 1, n - 1).alias("a"), F.slice("cameras", 2, n - 1).alias("b"))).alias("i", "e"))
    named = lines.select(F.col("from_id").alias("_a"), F.col("to_id").alias("_b"), "line")
    laid = hops.join(named, (F.col("e.a") == F.col("_a")) & (F.col("e.b") == F.col("_b")))
    ways = laid.select("from_id", "to_id", "via", "i", F.posexplode("line").alias("j", "p")).where("i = 0 or j > 0")
    vertices = ways.select("from_id", "to_id", "i", "j", F.col("p")[0].alias("lat"), F.col("p")[1].alias("lon"), F.lit(False).alias("end"))
    place = cameras.select("camera_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    ends = [paths.select("from_id", "to_id", F.lit(i).alias("i"), F.lit(0).alias("j"), F.col(c).alias("camera_id")).join(place, "camera_id").select("from_id", "to_id", "i", "j", "lat", "lon", F.lit(True).alias("end")) for i, c in ((-1, "from_id"), (2**31 - 1, "to_id"))]
    by = Window.partitionBy("from_id", "to_id").orderBy("i", "j")
    before_lat, before_lon = F.lag("lat").over(by), F.lag("lon").over(by)
    apart = F.coalesce((F.abs(F.col("lat") - before_lat) > SAME_DEG) | (F.abs(F.col("lon") - before_lon) > SAME_DEG), F.lit(True))
    step = F.coalesce(planar_m(before_lat, before_lon, F.col("lat"), F.col("lon")), F.lit(0.0))
    measured = vertices.unionByName(ends[0]).unionByName(ends[1]).withColumns({"apart": apart, "step": step})
    measured = measured.withColumn("m", F.sum("step").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    line = F.collect_list(F.when(~F.col("end"), F.struct("i", "j", "lat", "lon")))
    way = F.collect_list(F.when(F.col("apart"), F.struct("i", "j", "m", "lat", "lon")))
    made = measured.groupBy("from_id", "to_id").agg(line.alias("line"), way.alias("way"))
    bare = made.select("from_id", "to_id", F.transform(F.array_sort("line"), lambda v: F.array(v["lat"], v["lon"])).alias("line"), F.transform(F.array_sort("way"), lambda v: F.struct(v["m"].alias("m"), v["lat"].alias("lat"), v["lon"].alias("lon"))).alias("way"))
    return bare.join(paths.select("from_id", "to_id", F.slice("cameras", 2, F.greatest(n - 2, F.lit(0))).alias("via")), ["from_id", "to_id"])


def segments(points: DataFrame, found: DataFrame, cameras: DataFrame) -> DataFrame:
    """The legs of trajectories within a journey with line, way and via of their ``routes``; without a route, the straight line.

    Points without a place are left out, and so are the legs to them. Routes number no more than pairs of cameras, and only a
    leg's id and ends meet them.
    """
    place = cameras.select("camera_id", F.array("latitude", "longitude").alias("_at"))
    legs = points.where("from_camera_id is not null").select("vehicle_id", "journey_index", "seq", F.col("from_camera_id").alias("from_id"), F.col("camera_id").alias("to_id"))
    legs = legs.join(place.select(F.col("camera_id").alias("from_id"), F.col("_at").alias("_from")), "from_id").join(place.select(F.col("camera_id").alias("to_id"), F.col("_at").alias("_to")), "to_id")
    straight = _straight(F.col("_from")[0], F.col("_from")[1], F.col("_to")[0], F.col("_to")[1])
    out = legs.join(found, ["from_id", "to_id"], "left")
    return out.select("vehicle_id", "journey_index", "seq", "from_id", "to_id", F.coalesce("line", F.array("_from", "_to")).alias("line"), F.coalesce("way", straight).alias("way"), F.coalesce("via", F.array().cast("array<string>")).alias("via"))


def _straight(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    ends = [F.struct(m.alias("m"), a.alias("lat"), o.alias("lon")) for m, a, o in ((F.lit(0.0), lat0, lon0), (planar_m(lat0, lon0, lat1, lon1), lat1, lon1))]
    return F.array(*ends)


def along(way: Column, share: Column) -> Column:
    """(lat, lon) at a share (0 to 1) of the length of a ``way``: its step by binary search, linearly within it.

    A way of one vertex or of no length is at its first vertex.
    """
    n, total = F.size(way), F.element_at(way, -1)["m"]
    target = total * share

    def halved(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        wide, low = s["hi"] - s["lo"] > 1, F.element_at(way, middle)["m"] <= target
        return F.struct(F.when(wide & low, middle).otherwise(s["lo"]).alias("lo"), F.when(wide & ~low, middle).otherwise(s["hi"]).alias("hi"))

    rounds = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(n.cast("double"))).cast("int"), F.lit(1)))
    step = F.aggregate(rounds, F.struct(F.lit(1).alias("lo"), n.alias("hi")), halved)
    a, b = F.element_at(way, step["lo"]), F.element_at(way, step["hi"])
    part = F.coalesce(F.try_divide(target - a["m"], b["m"] - a["m"]), F.lit(0.0))
    mid = F.struct((a["lat"] + (b["lat"] - a["lat"]) * part).alias("lat"), (a["lon"] + (b["lon"] - a["lon"]) * part).alias("lon"))
    end = lambda v: F.struct(v["lat"].alias("lat"), v["lon"].alias("lon"))
    return F.when((n == 1) | (total <= 0) | (share <= 0), end(F.element_at(way, 1))).when(share >= 1, end(F.element_at(way, -1))).otherwise(mid)


def position_at(timeline: DataFrame, at: DataFrame, found: DataFrame, cameras: DataFrame) -> DataFrame:
    """Place on the road of each vehicle at virtual times (``at``: vehicle_id, v), with the stop it comes from and the kind.

    ``timeline`` is of ``journeys.replay_timeline``. Times before the start are at the first stop and those after the end at
    the last. Within a journey a leg follows its route (kind ``road``); between journeys a vehicle stays where it was
    (``gap``), and at a stop the kind is ``stop``. Legs without length are passed over. A time meets its one leg by an as-of
    join, so that legs and times of a vehicle are sorted together and never paired.
    """
    place = cameras.select("camera_id", "latitude", "longitude")
    by = Window.partitionBy("vehicle_id").orderBy("seq")
    stops = timeline.join(place, "camera_id").select("vehicle_id", "seq", "journey_index", "camera_id", "latitude", "longitude", F.col("virtual_s").alias("t"))
    legs = stops.withColumns({"v1": F.lead("t").over(by), "to_id": F.lead("camera_id").over(by), "lat1": F.lead("latitude").over(by), "lon1": F.lead("longitude").over(by), "road": F.lead("journey_index").over(by) == F.col("journey_index")})
    legs = legs.where("v1 is null or v1 > t").withColumnRenamed("camera_id", "from_id")
    carried = ["seq", "from_id", "to_id", "latitude", "longitude", "v1", "lat1", "lon1", "road"]
    asked = at.select("vehicle_id", "v", F.greatest(F.col("v"), F.lit(0.0)).alias("t"))
    met = as_of(asked, legs, ["vehicle_id"], carried).where("asof_seq is not null")
    met = met.select("vehicle_id", "v", F.coalesce((F.col("t") - F.col("asof_t")) / (F.col("asof_v1") - F.col("asof_t")), F.lit(0.0)).alias("share"), *[F.col(f"asof_{c}").alias(c) for c in carried])
    moving = (F.col("share") > 0) & F.coalesce("road", F.lit(False))
    laid = met.withColumns({"from_id": F.when(moving, F.col("from_id")), "to_id": F.when(moving, F.col("to_id"))}).join(found.select("from_id", "to_id", "way"), ["from_id", "to_id"], "left")
    way = F.coalesce("way", _straight(F.col("latitude"), F.col("longitude"), F.col("lat1"), F.col("lon1")))
    spot = F.when(moving, along(way, F.col("share"))).otherwise(F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")))
    kind = F.when(F.col("share") <= 0, "stop").when(F.col("road"), "road").otherwise("gap")
    return laid.select("vehicle_id", "v", "seq", kind.alias("kind"), spot.alias("p")).select("vehicle_id", "v", "seq", "kind", F.col("p.lat").alias("latitude"), F.col("p.lon").alias("longitude"))

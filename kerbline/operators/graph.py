"""The directed road graph: defaults, neighbours, shortest paths and loops, corridors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.sources.lineage import cut

#: Metres a second at best and usually.
FASTEST_M_S, USUAL_M_S = 25.0, 8.33


def with_defaults(edges: DataFrame, both_ways: bool = False) -> DataFrame:
    """Edges with min_travel_s and typical_travel_s filled in from the distance; optionally each also the other way round.

    Edges whose least time exceeds the usual one are wrong and marked by ``valid``.
    """
    out = edges.withColumn("min_travel_s", F.coalesce("min_travel_s", F.col("distance_m") / FASTEST_M_S)).withColumn("typical_travel_s", F.coalesce("typical_travel_s", F.col("distance_m") / USUAL_M_S))
    if both_ways:
        back = out.withColumns({"from_id": F.col("to_id"), "to_id": F.col("from_id")})
        out = out.unionByName(back.join(out.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti"))
    return out.withColumn("valid", F.col("min_travel_s") <= F.col("typical_travel_s"))


def known(edges: DataFrame, cameras: DataFrame) -> DataFrame:
    """Edges whose two ends are cameras."""
    ids = cameras.select("camera_id").distinct()
    return edges.join(ids.withColumnRenamed("camera_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("camera_id", "to_id"), "to_id", "left_semi")


def neighbours(edges: DataFrame) -> DataFrame:
    """Of each camera: allowed incoming and outgoing neighbours, sorted."""
    allowed = edges.where("allowed")
    out = allowed.groupBy(F.col("from_id").alias("camera_id")).agg(F.array_sort(F.collect_set("to_id")).alias("outgoing"))
    into = allowed.groupBy(F.col("to_id").alias("camera_id")).agg(F.array_sort(F.collect_set("from_id")).alias("incoming"))
    empty = F.array().cast("array<string>")
    return out.join(into, "camera_id", "full").select("camera_id", F.coalesce("outgoing", empty).alias("outgoing"), F.coalesce("incoming", empty).alias("incoming"))


#: Edges that paths are extended by between two tables that are written.
HOPS_A_ROUND = 3
_MEASURES = ("distance_m", "min_travel_s", "typical_travel_s")


def _searched(first: DataFrame, hop: DataFrame, max_hops: int | None = None, labels: tuple[str, ...] = ()) -> DataFrame:
    """Cheapest paths that begin with the edges ``first`` and go on by ``hop``, one for each two ends and label.

    A label ``avoids`` names a camera that its paths don't pass. A step extends the paths that the last one found or improved
    by an edge, and a round of a few steps is written, until one improves none: a road network's diameter bounds the steps,
    and a round's table holds one path for each pair and label.
    """
    best = first.select(*labels, "from_id", "to_id", F.col("c").alias("cost"), F.array("from_id", "to_id").alias("cameras"), *_MEASURES, F.lit(1).alias("new"))

    def least(paths: DataFrame) -> DataFrame:
        # A path found again equals the kept one, which is not new and so comes first.
        return paths.groupBy(*labels, "from_id", "to_id").agg(F.min(F.struct("cost", "cameras", *_MEASURES, "new")).alias("p")).select(*labels, "from_id", "to_id", "p.*")

    def extended(best: DataFrame) -> DataFrame:
        ends = best.where("new = 1 and from_id <> to_id").select(*labels, "from_id", F.col("to_id").alias("via"), "cost", "cameras", *[F.col(m).alias(f"{m}_0") for m in _MEASURES])
        step = ends.join(hop.withColumnRenamed("from_id", "via"), "via").where((F.col("to_id") == F.col("from_id")) | ~F.array_contains("cameras", F.col("to_id")))
        step = step.where(F.col("to_id") != F.col("avoids")) if "avoids" in labels else step
        paths = step.select(*labels, "from_id", "to_id", (F.col("cost") + F.col("c")).alias("cost"), F.concat("cameras", F.array("to_id")).alias("cameras"), *[(F.col(f"{m}_0") + F.col(m)).alias(m) for m in _MEASURES], F.lit(1).alias("new"))
        return least(best.withColumn("new", F.lit(0)).unionByName(paths))

    hop, best, hops = cut(hop), cut(least(best)), 1
    while (max_hops is None or hops < max_hops) and not best.where("new = 1").isEmpty():
        steps = HOPS_A_ROUND if max_hops is None else min(HOPS_A_ROUND, max_hops - hops)
        for _ in range(steps):
            best = extended(best)
        best, hops = cut(best), hops + steps
    return best.drop("new")


def _hops(edges: DataFrame, cost: str) -> DataFrame:
    return edges.where("allowed").select("from_id", "to_id", F.col(cost).cast("double").alias("c"), *_MEASURES)


def shortest_paths(edges: DataFrame, cost: str = "distance_m", max_hops: int | None = None, origin: str | None = None) -> DataFrame:
    """The cheapest allowed path between any two cameras (and loop back to each), of any number of hops or at most ``max_hops``.

    With ``origin`` only paths from there are searched. Columns: from_id, to_id, cost, cameras, hops, skipped (cameras
    between), and the path's distance, least and usual time. Ties go to the path that comes first.
    """
    hop = _hops(edges, cost)
    best = _searched(hop if origin is None else hop.where(F.col("from_id") == origin), hop, max_hops)
    hops = F.size("cameras") - 1
    return best.withColumn("hops", hops).withColumn("skipped", F.when(hops > 1, F.slice("cameras", 2, hops - 1)).otherwise(F.array().cast("array<string>")))


def loaded(edges: DataFrame, base: DataFrame, scores: DataFrame) -> DataFrame:
    """Allowed edges with their usual seconds and ``load_cost``: these, times 1 + score / 100 of the camera that they lead to."""
    timed = edges.where("allowed").join(base.select("from_id", "to_id", "seconds"), ["from_id", "to_id"], "left").join(scores.select(F.col("camera_id").alias("to_id"), "score", "level"), "to_id", "left")
    return timed.withColumn("seconds", F.coalesce("seconds", "typical_travel_s")).withColumn("load_cost", F.col("seconds") * (1 + F.coalesce(F.col("score"), F.lit(0.0)) / 100))


def corridor(edges: DataFrame, base: DataFrame, scores: DataFrame, origin: str, destination: str, speedup: float = 0.35, max_hops: int | None = None) -> DataFrame:
    """Steps from origin to destination on the path with the least congested time, with arrival times as usual and with priority.

    An edge costs its usual seconds times 1 + score / 100 of the camera it leads to. With priority a segment takes
    ``speedup`` less, never less than its least time.
    """
    timed = loaded(edges, base, scores)
    timed = cut(timed)
    path = shortest_paths(timed, "load_cost", max_hops, origin).where(F.col("to_id") == destination)
    steps = path.select(F.posexplode("cameras").alias("position", "camera_id")).withColumn("previous", F.lag("camera_id").over(Window.orderBy("position")))
    steps = steps.join(timed.select(F.col("from_id").alias("previous"), F.col("to_id").alias("camera_id"), "seconds", "min_travel_s", "score", "level"), ["previous", "camera_id"], "left")
    upto = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the few steps of one path
    fast = F.greatest(F.col("min_travel_s"), F.col("seconds") * (1 - speedup))
    advice = F.when(F.col("position") == 0, "dispatch").when(F.col("level").isin("HEAVY", "SEVERE"), "clear the queue").when(F.col("level") == "MODERATE", "prepare a green wave").otherwise("monitor")
    return steps.select("position", "camera_id", F.round(F.sum(F.coalesce("seconds", F.lit(0.0))).over(upto), 1).alias("eta_s"), F.round(F.sum(F.coalesce(fast, F.lit(0.0))).over(upto), 1).alias("eta_with_priority_s"), advice.alias("advice"))


def alternatives(edges: DataFrame, cost: str, origin: str, destination: str, max_hops: int | None = None) -> DataFrame:
    """Cheapest paths that avoid one camera between the ends of the cheapest path each; the same path is returned once.

    One search for all: paths are labelled with the camera that they avoid, and a round extends those of all labels.
    """
    hop = _hops(edges, cost)
    primary = _searched(hop.where(F.col("from_id") == origin), hop, max_hops).where(F.col("to_id") == destination)
    labels = primary.select("from_id", F.explode(F.slice("cameras", 2, F.greatest(F.size("cameras") - 2, F.lit(0)))).alias("avoids"))
    first = hop.join(F.broadcast(labels), "from_id").where(F.col("to_id") != F.col("avoids"))  # the cameras of one path
    found = _searched(first, hop, max_hops, ("avoids",)).where(F.col("to_id") == destination)
    return found.groupBy("cameras").agg(F.min("avoids").alias("avoids"), F.first("cost").alias("cost"), F.first("distance_m").alias("distance_m"))


def corridor_options(edges: DataFrame, base: DataFrame, scores: DataFrame, origin: str, destination: str, max_hops: int | None = None) -> DataFrame:
    """The ways of a corridor by load cost: the cheapest (avoids is null) and those that avoid one of its cameras each; cameras, avoids, cost, distance_m."""
    timed = cut(loaded(edges, base, scores))
    primary = shortest_paths(timed, "load_cost", max_hops, origin).where(F.col("to_id") == destination)
    return primary.select("cameras", F.lit(None).cast("string").alias("avoids"), "cost", "distance_m").unionByName(alternatives(timed, "load_cost", origin, destination, max_hops))


def geojson(edges: DataFrame, cameras: DataFrame) -> DataFrame:
    """One feature for each edge as JSON text: its line and properties."""
    place = cameras.select("camera_id", F.array("longitude", "latitude").alias("at"))
    out = edges.join(place.withColumnsRenamed({"camera_id": "from_id", "at": "a"}), "from_id").join(place.withColumnsRenamed({"camera_id": "to_id", "at": "b"}), "to_id")
    line = F.struct(F.lit("LineString").alias("type"), F.array("a", "b").alias("coordinates"))
    props = F.struct(F.col("from_id").alias("from"), F.col("to_id").alias("to"), "allowed", "distance_m", "min_travel_s", "typical_travel_s")
    return out.select("from_id", "to_id", F.to_json(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), props.alias("properties"))).alias("feature"))

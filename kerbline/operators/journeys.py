"""Trajectories: order, journeys, segments, origin-destination cells, predictions, vehicle summaries, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.operators.quantiles import medians

#: Seconds without a sighting after which a new journey begins.
JOURNEY_GAP_S = 1800


def trajectory(obs: DataFrame, gap_s: float = JOURNEY_GAP_S, breaks: Column | None = None) -> DataFrame:
    """``obs`` (vehicle_id, camera_id, t, event_id) with seq, journey_index, and the segment from the sighting before.

    A journey ends with a gap of more than ``gap_s``, or where ``breaks`` says so of a row. A segment has its camera, its
    seconds and, where distances are known (``hop_m``), metres and km/h; the first sighting of a journey has none.
    """
    by = Window.partitionBy("vehicle_id").orderBy("t", "event_id")
    gap = F.col("t") - F.lag("t").over(by)
    new = (gap > gap_s) if breaks is None else ((gap > gap_s) | F.coalesce(breaks, F.lit(False)))
    out = obs.withColumn("seq", (F.row_number().over(by) - 1).cast("long")).withColumn("_new", F.when(F.coalesce(new, F.lit(False)), 1).otherwise(0))
    out = out.withColumn("journey_index", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))
    first = (F.col("_new") == 1) | (F.col("seq") == 0)
    out = out.withColumn("from_camera_id", F.when(~first, F.lag("camera_id").over(by))).withColumn("segment_travel_s", F.when(~first, F.round(F.col("t") - F.lag("t").over(by), 2)))
    return out.drop("_new")


def with_distances(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Segments with the edge's metres and the speed over it."""
    hops = edges.select(F.col("from_id").alias("from_camera_id"), F.col("to_id").alias("camera_id"), "distance_m")
    out = points.join(hops, ["from_camera_id", "camera_id"], "left").withColumn("segment_distance_m", F.round("distance_m", 1)).drop("distance_m")
    return out.withColumn("segment_speed_kmh", F.when(F.col("segment_travel_s") > 0, F.round(F.col("segment_distance_m") / F.col("segment_travel_s") * 3.6, 1)))


def journeys(points: DataFrame) -> DataFrame:
    """Origin, destination, sightings and seconds of each journey; points filtered before are journeys clipped."""
    return points.groupBy("vehicle_id", "journey_index").agg(
        F.min_by("camera_id", "seq").alias("origin"), F.max_by("camera_id", "seq").alias("destination"), F.count("*").alias("points"), F.min("t").alias("start_s"), F.max("t").alias("end_s")
    )


def _trips(points: DataFrame) -> DataFrame:
    """Journeys with two sightings at least and two different ends."""
    return journeys(points).where("points >= 2 and origin <> destination")


def od_cells(points: DataFrame) -> DataFrame:
    """Cells of journeys by their ends: count and median seconds."""
    found = medians(_trips(points).withColumn("travel_s", F.col("end_s") - F.col("start_s")), ["origin", "destination"], "travel_s", "median_travel_s", "journeys")
    return found.select("origin", "destination", "journeys", F.round("median_travel_s", 1).alias("median_travel_s"))


def od_matrix(points: DataFrame, min_count: int = 1) -> DataFrame:
    """Cells of at least ``min_count`` journeys; smaller ones are left out, so that none singles out a vehicle."""
    return od_cells(points).where(F.col("journeys") >= min_count)


def od_totals(points: DataFrame, min_count: int = 1) -> DataFrame:
    """One row: journeys of all cells and of those suppressed."""
    cells = _trips(points).groupBy("origin", "destination").agg(F.count("*").alias("journeys"))
    return cells.agg(F.coalesce(F.sum("journeys"), F.lit(0)).alias("total_journeys"), F.coalesce(F.sum(F.when(F.col("journeys") < min_count, F.col("journeys"))), F.lit(0)).alias("suppressed_journeys"))


def od_drilldown(points: DataFrame, origin: str, destination: str) -> DataFrame:
    """Journeys behind a cell with the cameras they passed, in order."""
    passed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "camera_id"))), lambda x: x["camera_id"])
    out = points.groupBy("vehicle_id", "journey_index").agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"), passed.alias("cameras"))
    return out.where((F.size("cameras") >= 2) & (F.element_at("cameras", 1) == origin) & (F.element_at("cameras", -1) == destination))


def transitions(points: DataFrame, since: float | None = None) -> DataFrame:
    """Counts of the next camera after each, itself excepted."""
    kept = points if since is None else points.where(F.col("t") >= since)
    return kept.where("from_camera_id is not null and from_camera_id <> camera_id").groupBy(F.col("from_camera_id").alias("from_id"), F.col("camera_id").alias("to_id")).agg(F.count("*").alias("n"))


def next_camera(counts: DataFrame, edges: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Of each way to arrive at a camera: the probability of each allowed exit and the best, ties to the smaller name.

    ``arrivals`` (camera_id, from_camera_id, which may be null) are points of trajectories. The exit back to where a vehicle
    came from is left out unless it is the only one. One is added to each count.
    """
    exits = edges.where("allowed").select("from_id", "to_id", "min_travel_s", "typical_travel_s").join(counts, ["from_id", "to_id"], "left").fillna(0, ["n"])
    exits = exits.withColumn("_exits", F.count("*").over(Window.partitionBy("from_id")))
    ways = arrivals.select(F.col("camera_id").alias("from_id"), F.col("from_camera_id").alias("came_from")).distinct()
    open_ = ways.join(exits, "from_id").where((F.col("_exits") == 1) | ~F.col("to_id").eqNullSafe(F.col("came_from"))).drop("_exits")
    every = Window.partitionBy("from_id", "came_from")
    out = open_.withColumn("probability", (F.col("n") + 1) / (F.sum("n").over(every) + F.count("*").over(every)))
    best = F.row_number().over(every.orderBy(F.desc("probability"), "to_id")) == 1
    return out.withColumn("best", best).withColumn("window_start_s", F.col("min_travel_s")).withColumn("window_end_s", F.greatest(2.5 * F.col("typical_travel_s"), F.col("min_travel_s") + 60))


def prediction_status(points: DataFrame, predicted: DataFrame, now: float, grace_s: float = 30) -> DataFrame:
    """Of each sighting, whether the prediction made at it was CONFIRMED, DEVIATED, or is PENDING or EXPIRED."""
    by = Window.partitionBy("vehicle_id").orderBy("seq")
    following = points.withColumn("next_camera", F.lead("camera_id").over(by)).withColumn("next_t", F.lead("t").over(by)).withColumn("same", F.lead("journey_index").over(by) == F.col("journey_index"))
    best = predicted.where("best").select(F.col("from_id").alias("_at"), F.col("came_from").alias("_came"), F.col("to_id").alias("predicted"), "window_end_s")
    late = F.col("t") + F.col("window_end_s") + grace_s
    status = F.when(F.col("next_t").isNull(), F.when(F.lit(now) > late, "EXPIRED").otherwise("PENDING")).when(F.col("same") & (F.col("next_camera") == F.col("predicted")) & (F.col("next_t") <= late), "CONFIRMED").otherwise("DEVIATED")
    made = following.join(best, (F.col("camera_id") == F.col("_at")) & F.col("from_camera_id").eqNullSafe(F.col("_came")))
    return made.drop("_at", "_came").withColumn("status", status)


def vehicle_summary(points: DataFrame) -> DataFrame:
    """Of each vehicle: first and last sighting, counts, the plate with the best confidence (later wins ties)."""
    return points.groupBy("vehicle_id").agg(
        F.min("t").alias("first_seen_s"), F.max("t").alias("last_seen_s"), F.min_by("camera_id", "seq").alias("first_camera_id"), F.max_by("camera_id", "seq").alias("last_camera_id"),
        F.count("*").alias("observation_count"), F.count_distinct("camera_id").alias("camera_count"), F.max_by("plate", F.struct("confidence", "seq")).alias("plate_text"),
    )


def replay_timeline(points: DataFrame, cap_s: float) -> DataFrame:
    """Virtual seconds of each sighting when gaps are cut to ``cap_s``, and whether its leg bridges a journey break."""
    by = Window.partitionBy("vehicle_id").orderBy("seq")
    gap = F.col("t") - F.lag("t").over(by)
    leg = F.when(gap.isNull(), 0.0).otherwise(F.least(gap, F.lit(float(cap_s))))  # the least of a null and a number is the number
    out = points.withColumn("leg_s", leg).withColumn("is_break", F.coalesce(F.col("journey_index") != F.lag("journey_index").over(by), F.lit(False)))
    return out.withColumn("virtual_s", F.sum("leg_s").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def position_at(timeline: DataFrame, at: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Interpolated place of each vehicle at virtual times (``at``: vehicle_id, v): the leg that holds v, linearly between its ends."""
    by = Window.partitionBy("vehicle_id").orderBy("seq")
    place = coordinates.select("camera_id", "latitude", "longitude")
    legs = timeline.join(place, "camera_id").select("vehicle_id", "seq", F.col("virtual_s").alias("v0"), F.col("latitude").alias("lat0"), F.col("longitude").alias("lon0"))
    legs = legs.withColumns({x[:-1] + "1": F.lead(x).over(by) for x in ("v0", "lat0", "lon0")})
    found = at.join(legs, "vehicle_id").where("v >= v0 and (v < v1 or v1 is null)")
    part = F.coalesce(F.try_divide(F.col("v") - F.col("v0"), F.col("v1") - F.col("v0")), F.lit(0.0))
    mid = lambda x: F.col(f"{x}0") + part * F.coalesce(F.col(f"{x}1") - F.col(f"{x}0"), F.lit(0.0))
    return found.select("vehicle_id", "v", "seq", mid("lat").alias("latitude"), mid("lon").alias("longitude"))

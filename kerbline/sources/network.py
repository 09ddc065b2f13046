"""Road networks as edges between cameras."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions.geo import bearing_deg, compass, path_length_m


def camera_edges(roads: DataFrame, free_flow_kmh: float = 80.0, typical_kmh: float = 30.0) -> DataFrame:
    """Directed edges from ``roads`` (road_id, name, from_id, to_id, path of (lat, lon), one_way), one for each ordered pair.

    Each road leads both ways; against a one-way road it isn't allowed. Of several roads an allowed one wins, then the
    shortest, then the least road_id. Roads without both ends are left out.
    """
    known = roads.where("from_id is not null and from_id <> '' and to_id is not null and to_id <> ''").withColumn("one_way", F.coalesce("one_way", F.lit(False)))
    there = known.withColumn("allowed", F.lit(True))
    back = known.withColumns({"from_id": F.col("to_id"), "to_id": F.col("from_id"), "path": F.reverse("path"), "allowed": ~F.col("one_way")})
    metres = path_length_m(F.col("path"))
    first, last = F.element_at("path", 1), F.element_at("path", -1)
    heading = compass(bearing_deg(first[0], first[1], last[0], last[1]))
    made = there.unionByName(back).withColumns({"metres": metres, "direction": heading})
    row = F.struct(F.round("metres", 1).alias("distance_m"), F.round(F.col("metres") / (free_flow_kmh / 3.6), 1).alias("min_travel_s"), F.round(F.col("metres") / (typical_kmh / 3.6), 1).alias("typical_travel_s"), "road_id", "name", "direction", "allowed", "path")
    best = F.min_by(row, F.struct((~F.col("allowed")).alias("a"), F.round("metres", 1).alias("b"), F.col("road_id").alias("c")))
    return made.groupBy("from_id", "to_id").agg(best.alias("e")).select("from_id", "to_id", "e.*")

"""A retention run over tables by day."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.plans.registry import query
from kerbline.sources import retention
from kerbline.sources import tables as T
from kerbline.sources.lineage import shared_path
from kerbline.sources.retention import Rule

_RULES = {"observations": Rule(14), "plate_reads": Rule(14, depends=True), "metrics": Rule(7), "dead_letters": Rule(7, only="k % 2 = 0"), "vehicles": Rule(14)}
_FACTS = "event_id long, t double, vehicle_id long, k int"
_SCHEMAS = {"observations": _FACTS, "plate_reads": _FACTS, "metrics": _FACTS, "dead_letters": _FACTS, "vehicles": "vehicle_id long, last_seen_s double"}


@query(T.with_("obs") + f""", kept AS (SELECT * FROM obs WHERE t >= {T.NOW - 14 * 86400}),
reads AS (SELECT CASE WHEN k % 7 <> 0 THEN event_id END AS event_id, t, vehicle_id FROM obs WHERE plate IS NOT NULL),
vehicles AS (SELECT vehicle_id, max(t) - CASE WHEN vehicle_id % 3 = 0 THEN 20 * 86400 ELSE 0 END AS seen FROM obs GROUP BY 1)
SELECT 'observations' AS name, count(*) AS n, CAST(sum(vehicle_id) AS BIGINT) AS id_sum FROM kept
UNION ALL SELECT 'plate_reads', count(*), CAST(sum(vehicle_id) AS BIGINT) FROM reads WHERE t >= {T.NOW - 14 * 86400}
UNION ALL SELECT 'metrics', count(*), CAST(sum(vehicle_id) AS BIGINT) FROM obs WHERE t >= {T.NOW - 7 * 86400}
UNION ALL SELECT 'dead_letters', count(*), CAST(sum(vehicle_id) AS BIGINT) FROM obs WHERE t >= {T.NOW - 7 * 86400} OR k % 2 <> 0
UNION ALL SELECT 'vehicles', count(*), CAST(sum(vehicle_id) AS BIGINT) FROM vehicles WHERE seen >= {T.NOW - 14 * 86400} OR vehicle_id IN (SELECT vehicle_id FROM kept)""")
def ret_run_tables(spark, sf_dir):
    """What all tables hold after a run: sightings of 14 days, their reads, metrics of 7, letters unless resolved, and vehicles."""
    day = F.floor(F.col("t") / retention.DAY_S)
    obs = T.observations(spark, sf_dir)
    facts = obs.select("event_id", "t", "vehicle_id", "k", day.alias("day"))
    reads = obs.where("plate is not null").select(F.when(F.col("k") % 7 != 0, F.col("event_id")).alias("event_id"), "t", "vehicle_id", "k", day.alias("day"))
    seen = F.max("t") - F.when(F.col("vehicle_id") % 3 == 0, 20 * retention.DAY_S).otherwise(0)
    vehicles = obs.groupBy("vehicle_id").agg(seen.alias("last_seen_s")).withColumn("day", F.floor(F.col("last_seen_s") / retention.DAY_S))
    root = shared_path(spark, "retention")
    retention.put(spark, root, {"observations": facts, "plate_reads": reads, "metrics": facts, "dead_letters": facts, "vehicles": vehicles})
    retention.run(spark, root, _RULES, _SCHEMAS, T.NOW)
    held = [retention.read(spark, root, x, s).agg(F.lit(x).alias("name"), F.count("*").alias("n"), F.sum("vehicle_id").alias("id_sum")) for x, s in _SCHEMAS.items()]
    out = held[0]
    for h in held[1:]:
        out = out.unionByName(h)
    return out

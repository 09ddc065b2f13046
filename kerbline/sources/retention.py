"""Tables by day below one folder, and retention runs that remove old days with their dependants and repeat to the same tables.

A version lists which folder holds each table's rows of a day; it is one small file, written last, and counts once it is
there. A run writes anew only the days that hold both rows that go and rows that stay, and leaves out older ones: what it costs
doesn't grow with what is kept. Readers see the version before until the run counts, and a run that failed halfway is repeated
from that version, over its own folders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.streaming.ingest import _exists, _path

DAY_S = 86_400
_LIST = "table string, day long, folder string, n long"


@dataclass(frozen=True)
class Rule:
    """How long a table's rows stay: ``days`` by their own time t, where ``only`` (SQL, if given) holds; or as long as the
    sighting (event_id) that they depend on, whose day is theirs, and without one ``days``."""

    days: float
    only: str | None = None
    depends: bool = False


def version(spark: SparkSession, root: str) -> int:
    """The newest version that counts; 0 if none does."""
    fs, at = _path(spark, f"{root}/_versions")
    if not fs.exists(at):
        return 0
    found = [f.getPath() for f in fs.listStatus(at)]
    return max((int(p.getName().split("=")[1]) for p in found if p.getName().startswith("version=") and _exists(spark, f"{p}/_SUCCESS")), default=0)


def listed(spark: SparkSession, root: str) -> dict[tuple[str, int], tuple[str, int]]:
    """Folder and number of rows of each table's day. As many as there are days and tables: a catalogue, not data."""
    v = version(spark, root)
    return {(r.table, r.day): (r.folder, r.n) for r in spark.read.schema(_LIST).parquet(f"{root}/_versions/version={v}").collect()} if v else {}


def _committed(spark: SparkSession, root: str, v: int, days: dict[tuple[str, int], tuple[str, int]]) -> None:
    rows = [(t, d, folder, n) for (t, d), (folder, n) in sorted(days.items())]
    spark.createDataFrame(rows, _LIST).coalesce(1).write.mode("overwrite").parquet(f"{root}/_versions/version={v}")


def read(spark: SparkSession, root: str, table: str, schema, days: range | None = None) -> DataFrame:
    """The rows of a table, of some days if given."""
    folders = [f for (t, d), (f, _) in listed(spark, root).items() if t == table and (days is None or d in days)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _written(rows: DataFrame, root: str, table: str, v: int) -> dict[tuple[str, int], tuple[str, int]]:
    """Rows with ``day`` to folders of the version, with their numbers."""
    at = f"{root}/{table}/version={v}"
    rows.write.mode("overwrite").partitionBy("day").parquet(at)
    found = rows.sparkSession.read.schema(rows.schema).parquet(at).groupBy("day").count().collect()
    return {(table, r["day"]): (f"{at}/day={r['day']}", r["count"]) for r in found}


def put(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> None:
    """Tables with a column ``day`` (whole days since 1970 of t, of a dependant its sighting's) as a new version in place of what they held."""
    v = version(spark, root) + 1
    days = {k: x for k, x in listed(spark, root).items() if k[0] not in tables}
    for name, rows in tables.items():
        days |= _written(rows, root, name, v)
    _committed(spark, root, v, days)


def run(spark: SparkSession, root: str, rules: dict[str, Rule], schemas: dict[str, str], now: float, sightings: str = "observations", vehicles: str = "vehicles") -> dict[str, int]:
    """A retention run at ``now``: how many rows of each table went.

    Dependants go with their sightings; a vehicle goes if it was last seen (``last_seen_s``, whose day is its) before the
    sightings' time and none of its sightings stays. Tables without a rule stay as they are. Rows without a time stay.
    """
    v, days = version(spark, root) + 1, listed(spark, root)
    cut = {name: now - rule.days * DAY_S for name, rule in rules.items()}
    after, gone = dict(days), dict.fromkeys(rules, 0)
    before = lambda name, d: [k for k in days if k[0] == name and k[1] <= d]

    def replaced(name: str, old: list[tuple[str, int]], kept: DataFrame | None) -> None:
        fresh = {} if kept is None else _written(kept, root, name, v)
        gone[name] = gone.get(name, 0) + sum(days[k][1] for k in old) - sum(n for _, n in fresh.values())
        for k in old:
            del after[k]
        after.update(fresh)

    def rows_of(name: str, keys: list[tuple[str, int]]) -> DataFrame:
        parts = [spark.read.schema(schemas[name]).parquet(days[k][0]).withColumn("day", F.lit(k[1]).cast("long")) for k in keys]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    for name, rule in sorted(rules.items(), key=lambda x: (not x[1].depends, x[0] == vehicles, x[0] == sightings)):
        if name == vehicles:
            continue
        edge = int(cut[sightings if rule.depends else name] // DAY_S)
        old = before(name, edge)
        if not old:
            continue
        # Days before the edge go whole, unless a condition may hold some of their rows.
        mixed = [k for k in old if k[1] == edge] if rule.only is None else old
        kept = None
        if mixed:
            rows, fresh = rows_of(name, mixed), F.coalesce(F.col("t") >= cut[name], F.lit(True))
            if rule.depends:
                stay = read(spark, root, sightings, schemas[sightings], range(edge, edge + 1)).where(F.col("t") >= cut[sightings]).select("event_id").distinct()
                kept = rows.where(F.col("event_id").isNotNull()).join(stay, "event_id", "left_semi").select(*rows.columns).unionByName(rows.where(F.col("event_id").isNull() & fresh))
            else:
                kept = rows.where(fresh if rule.only is None else fresh | ~F.coalesce(F.expr(rule.only), F.lit(False)))
        replaced(name, old, kept)
    if vehicles in rules:
        old = before(vehicles, int(cut[sightings] // DAY_S))
        if old:
            rows = rows_of(vehicles, old)
            left = [f for (t, _), (f, _) in after.items() if t == sightings]
            seen = (spark.read.schema(schemas[sightings]).parquet(*left) if left else spark.createDataFrame([], schemas[sightings])).select("vehicle_id").distinct()
            late = F.coalesce(F.col("last_seen_s") >= cut[sightings], F.lit(True))
            replaced(vehicles, old, rows.where(late).unionByName(rows.where(~late).join(seen, "vehicle_id", "left_semi").select(*rows.columns)))
    _committed(spark, root, v, after)
    return gone

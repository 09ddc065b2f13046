"""Lookups and restrictions between facts and dimensions, set operations, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def looked_up(facts: DataFrame, dimension: DataFrame, on: list[str]) -> DataFrame:
    """Facts with the dimension's columns, null where it has no row. Catalyst broadcasts a dimension that is small."""
    return facts.join(dimension, on, "left")


def in_scope(facts: DataFrame, scope: DataFrame, on: list[str]) -> DataFrame:
    """Facts whose keys are in the scope; an empty scope gives nothing."""
    return facts.join(scope, on, "left_semi")


def orphans(parents: DataFrame, children: DataFrame, on: list[str]) -> DataFrame:
    return parents.join(children, on, "left_anti")


def previous(facts: DataFrame, key: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Each row with columns of the key's row before it: an as-of join of a table with itself, as a window."""
    by = Window.partitionBy(*key).orderBy(*order)
    return facts.withColumns({f"previous_{c}": F.lag(c).over(by) for c in columns})


def as_of(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Each row of ``left`` with the columns of the newest row of ``right`` of its key up to its time ``t``.

    Both are sorted together once, and the last row of ``right`` is carried on: no row meets more than one other.
    """
    names = left.columns
    a = left.select(*names, F.lit(1).alias("_side"), *[F.lit(None).cast(dict(right.dtypes)[c]).alias(f"asof_{c}") for c in columns], F.lit(None).cast("double").alias("_t0"))
    b = right.select(*[F.col(c) if c in [*key, "t"] else F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in names], F.lit(0).alias("_side"), *[F.col(c).alias(f"asof_{c}") for c in columns], F.col("t").cast("double").alias("_t0"))
    carried = F.last(F.when(F.col("_side") == 0, F.struct("_t0", *[f"asof_{c}" for c in columns])), ignorenulls=True).over(Window.partitionBy(*key).orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return a.unionByName(b).withColumn("_c", carried).where("_side = 1").select(*names, F.col("_c._t0").alias("asof_t"), *[F.col(f"_c.asof_{c}").alias(f"asof_{c}") for c in columns])


def first_wins(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both, of the same key those of the first."""
    return first.unionByName(second.join(first.select(*key), key, "left_anti"))


def live_by_default(facts: DataFrame, cameras: DataFrame, scope: str | None = None) -> DataFrame:
    """Facts of a scope (live, demo or all); without one live if there is a live camera, else demo."""
    if scope == "all":
        return facts
    if scope is None:
        scope = "demo" if cameras.where("not is_demo").isEmpty() else "live"
    return facts.where(F.col("is_demo") == F.lit(scope == "demo"))


def retained(facts: DataFrame, now: float, days: float) -> DataFrame:
    """Facts not older than so many days."""
    return facts.where(F.col("t") >= now - days * 86_400)


def retention(observations: DataFrame, dependants: dict[str, DataFrame], vehicles: DataFrame, now: float, days: float) -> dict[str, DataFrame]:
    """What stays after a retention run: sightings in time, their dependants, and vehicles seen since or still with a sighting."""
    kept = retained(observations, now, days)
    out = {"observations": kept} | {name: df.join(kept.select("event_id"), "event_id", "left_semi") for name, df in dependants.items()}
    fresh = vehicles.where(F.col("last_seen_s") >= now - days * 86_400)
    out["vehicles"] = fresh.unionByName(vehicles.where(F.col("last_seen_s") < now - days * 86_400).join(kept.select("vehicle_id").distinct(), "vehicle_id", "left_semi"))
    return out


def latest(facts: DataFrame, key: list[str], column: str, now: float | None = None, fresh_s: float | None = None) -> DataFrame:
    """The newest value of each key, if it isn't older than ``fresh_s``."""
    out = facts.groupBy(*key).agg(F.max_by(column, F.struct("t", "event_id")).alias(column), F.max("t").alias("t"))
    return out if fresh_s is None else out.where(F.col("t") >= now - fresh_s)


def top_k(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)

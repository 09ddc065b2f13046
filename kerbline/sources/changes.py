"""Dimension tables that change: an append-only log of changes, read as the newest of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current(changes: DataFrame, key: list[str], order: list[str], deleted: str = "deleted") -> DataFrame:
    """The newest change of each key; keys whose newest one deletes them are gone. One aggregate, no window."""
    values = [c for c in changes.columns if c not in key]
    newest = changes.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_new"))
    return newest.select(*key, *[F.col(f"_new.{c}").alias(c) for c in values]).where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def created(table: DataFrame, fresh: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that may be added, rows refused because their key exists or is asked for twice)."""
    twice = fresh.groupBy(*key).count().where("count > 1").select(*key)
    taken = table.select(*key).unionByName(twice).distinct()
    return fresh.join(taken, key, "left_anti"), fresh.join(taken, key, "left_semi")


def cascaded(parents_gone: DataFrame, children: DataFrame, on: list[str]) -> DataFrame:
    """Children that stay when parents go."""
    return children.join(parents_gone.select(*on), on, "left_anti")

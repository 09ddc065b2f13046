"""Exact medians that no key's values have to meet for: a histogram first, then the one bucket in which the middle lies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets for each doubling of a value.
FINENESS = 1024.0


def _bucket(value: Column) -> Column:
    """A number that never falls as the value rises: the logarithm of its size, in steps, with its sign; NaN is above all."""
    steps = F.floor(F.log1p(F.abs(value)) * (FINENESS / 0.6931471805599453))
    return F.when(F.isnan(value), (1 << 63) - 1).when(value < 0, -steps - 1).otherwise(steps)


def medians(rows: DataFrame, keys: Sequence[str], value: str, median: str = "median", count: str = "samples") -> DataFrame:
    """Of each key the median of its known values (the mean of the two in the middle of an even number) and how many there are.

    Equal values are counted before rows are sent, by key and value, so that a hot key is spread over its values. Counts by
    bucket are few for each key; they tell in which bucket each middle lies, and only the values of those are put in order.
    Values of one bucket of one key are as close as a thousandth; so many different ones as that hold are sorted in one task.
    Keys without a known value have no row.
    """
    keys = list(keys)
    values = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_m")).withColumn("_b", _bucket(F.col("_v")))
    over = Window.partitionBy(*keys)
    upto = over.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = values.groupBy(*keys, "_b").agg(F.sum("_m").alias("_m")).withColumn("_upto", F.sum("_m").over(upto)).withColumn("_n", F.sum("_m").over(over))
    # The middles are the values of these numbers, from 1; the same one twice where n is odd.
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    before = F.col("_upto") - F.col("_m")
    holds = lambda r: (before < r) & (r <= F.col("_upto"))
    wanted = hist.where(holds(low) | holds(high)).select(*keys, "_b", before.alias("_before"), low.alias("_low"), high.alias("_high"), "_n")
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = [F.col(f"_w.{k}").eqNullSafe(F.col(f"_x.{k}")) for k in keys] + [F.col("_w._b") == F.col("_x._b")]
    placed = values.alias("_x").join(wanted.alias("_w"), same).select(*[F.col(f"_x.{k}").alias(k) for k in keys], "_x._b", "_v", "_m", "_before", "_low", "_high", "_n")
    placed = placed.withColumn("_end", F.col("_before") + F.sum("_m").over(inside)).withColumn("_start", F.col("_end") - F.col("_m"))
    at = lambda r: F.max(F.when((F.col("_start") < F.col(r)) & (F.col(r) <= F.col("_end")), F.col("_v")))
    return placed.groupBy(*keys).agg(((at("_low") + at("_high")) / 2).alias(median), F.max("_n").alias(count))

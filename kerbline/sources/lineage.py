"""Tables in the shared folder: cutting the lineage of iterative plans, and places for results of streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder of ``spark.checkpoint.dir``; where it is unset, in the warehouse, which all executors share too."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there.

    A file has no memory of how its rows were dealt out, which a checkpoint has: over rounds of joins the plans of checkpoints
    grow until planning takes longer than running.
    """
    path = shared_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def separate(df: DataFrame) -> DataFrame:
    """``df``, its columns computed apart from those that are added to it: a plan-only step that deals out nothing anew.

    Long chains of columns become one Java method otherwise, and the JVM doesn't compile methods beyond 8,000 bytes of code but
    interprets them row by row.
    """
    return df.coalesce(1 << 20)


def once(column: Column) -> Column:
    """``column``, which a filter after it doesn't work out again.

    A filter is moved before the columns that it uses, with a copy of each for each use: of a column made of many others that is
    more work than all rows are. It isn't moved before what differs from run to run, as row numbers do.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)

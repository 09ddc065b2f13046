"""A spool of JSON lines for what couldn't be sent, and its replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def put(lines: DataFrame, path: str) -> None:
    """Appends the texts of the column ``value``; Spark commits whole files of finished tasks only."""
    lines.select("value").write.mode("append").text(path)


def replay(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The spooled rows; lines that aren't JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)

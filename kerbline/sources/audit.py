"""The audit trail: rows that are only ever added, without secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.privacy import scrubbed_tree

SCHEMA = "t double, user_id long, username string, role string, action string, resource_type string, resource_id string, details string, ip string, success boolean"


def entries(acts: DataFrame) -> DataFrame:
    """Audit rows of ``acts`` (t, user_id, username, role, action, resource_type, resource_id, details, ip, success).

    ``details`` is a struct or map; its secrets are redacted at any depth, and it is kept as JSON. Unknown users are
    anonymous, and what isn't known to have failed succeeded.
    """
    details = scrubbed_tree(F.col("details"), acts.schema["details"].dataType)
    return acts.select(
        F.col("t").cast("double").alias("t"), F.col("user_id").cast("long").alias("user_id"), F.coalesce("username", F.lit("anonymous")).alias("username"), F.coalesce("role", F.lit("-")).alias("role"), "action", "resource_type",
        F.col("resource_id").cast("string").alias("resource_id"), F.coalesce(F.to_json(details), F.lit("{}")).alias("details"), "ip", F.coalesce("success", F.lit(True)).alias("success"),
    )


def record(acts: DataFrame, path: str) -> None:
    """Adds the rows of ``acts`` to the trail below ``path``; what stands there is never changed."""
    entries(acts).write.mode("append").parquet(path)


def trail(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)

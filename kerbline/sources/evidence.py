"""Evidence files: manifests of hashes and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def manifest(contents: DataFrame) -> DataFrame:
    """path, sha256 and bytes of each file."""
    return contents.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"))


def manifest_hash(manifest_rows: DataFrame) -> DataFrame:
    """One hash over a manifest in the order of its paths (a manifest is one case's few files)."""
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", "path", "sha256")))
    return manifest_rows.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("manifest_sha256"))


def verified(expected: DataFrame, contents: DataFrame) -> DataFrame:
    """Each expected path as ok, changed or missing."""
    now = contents.select("path", F.sha2("content", 256).alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("sha256"), "ok").otherwise("changed")
    return expected.join(now, "path", "left").select("path", state.alias("state"))

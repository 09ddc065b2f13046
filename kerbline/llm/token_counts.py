"""Token counts of documents in flat token files that have no index: a scan for end-of-document identifiers.

A file is a run of little-endian 16-bit token ids in which each document ends with a separator. Files are cut into blocks
of fixed size without regard to documents. A block finds its separators in one vectorised search and reports how many
tokens stand before its first separator, between separators, and after the last. A prefix scan over the blocks of a file
then stitches documents that cross blocks: it carries the tokens since the last separator, and the documents ended so far.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.llm.shared import columns, shared_dir, stored
from kerbline.llm.tokens import encode, vocabulary_paths

#: In the files ids are one larger than the tokenizer's, and the separator is 0, which no token can be.
SEPARATOR = 0
#: Tokens of a block.
BLOCK = 1 << 18


def _is_scan(df: DataFrame) -> bool:
    """Whether rows come straight from files. A shuffle may deal them otherwise each time that it is run, by the columns that it carries."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().strip().split("\n")
    return all(re.match(r"[\s:+-]*(Project|Filter|Relation)\b", x) for x in lines)


def write_flat(docs: DataFrame, path: str, json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """Writes the token ids of ``docs`` (doc_id, text) as flat files below ``path``; returns doc_id, file number and place there.

    Null and empty texts are a separator alone. Spark's text writer, whose line separator is the 16-bit zero, commits the
    files of finished tasks only, so that a lost executor leaves no torn file.
    """
    json_path, rank_path = (json_path, rank_path) if json_path and rank_path else vocabulary_paths()
    docs = columns(docs, "doc_id", "text")
    if not _is_scan(docs):
        docs = stored(docs, "flat-docs")

    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"ids": [(np.array(encode(x, json_path, rank_path), "<u2") + np.uint16(1)).tobytes() for x in batch["text"].tolist()]})

    flat = docs.select("text").mapInPandas(ids, "ids binary")
    # Both scans must deal the same rows to the same tasks, since a file is named by its task: executors that join between
    # them may not change the splits.
    conf, split = docs.sparkSession.conf, "spark.sql.files.minPartitionNum"
    before = conf.get(split, None)
    conf.set(split, before or str(docs.sparkSession.sparkContext.defaultParallelism))
    try:
        flat.select(F.col("ids").cast("string")).write.mode("overwrite").option("lineSep", "\0\0").text(path)
        place = F.monotonically_increasing_id()
        return stored(docs.select("doc_id", F.shiftright(place, 33).cast("int").alias("file"), place.bitwiseAND((1 << 33) - 1).alias("ordinal")), "flat-places")
    finally:
        conf.set(split, before) if before else conf.unset(split)


def scan(spark: SparkSession, path: str, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """file (name), ordinal (from 0) and n_tokens (without the separator) of each document in the flat files below ``path``.

    Tokens after the last separator of a file are a document without its end, and are returned too (``ended`` is false);
    an empty file has no documents, and two separators in a row enclose an empty one. Spark reads a file as one value, of
    2 GB at most, and deals its blocks out; ``write_flat`` makes files of the size of a scan task.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    width = 2 * block
    n = F.ceil(F.length("content") / F.lit(width)).cast("int")
    blocks = files.where("length(content) > 0").select("path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("block")).select("path", "block", F.expr(f"substring(content, block * {width} + 1, {width})").alias("data"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, number, data in zip(batch["path"], batch["block"], batch["data"], strict=True):
                ids = np.frombuffer(data, "<u2")
                at = np.flatnonzero(ids == separator)
                whole = np.diff(at) - 1
                out.append((path, number, len(at), int(at[0]) if len(at) else len(ids), len(ids) - int(at[-1]) - 1 if len(at) else len(ids), whole))
            yield pd.DataFrame(out, columns=["path", "block", "ends", "head", "tail", "whole"])

    found = blocks.mapInPandas(search, "path string, block int, ends long, head long, tail long, whole array<long>")
    found = stored(found, "token-blocks")
    # Blocks since the last one with a separator carry their tokens on; the scan runs over the few numbers of each block.
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    runs = found.withColumn("run", F.coalesce(F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(before), F.lit(0)))
    within = Window.partitionBy("path", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.withColumn("done", F.coalesce(F.sum("ends").over(before), F.lit(0))).withColumn("last_tail", F.coalesce(F.last(F.when(F.col("ends") > 0, F.col("tail")), ignorenulls=True).over(before), F.lit(0)))
    carried = carried.withColumn("carry", F.col("last_tail") + F.coalesce(F.sum(F.when(F.col("ends") == 0, F.col("head"))).over(within), F.lit(0)))
    counts = F.concat(F.array(F.col("carry") + F.col("head")), "whole")
    ended = carried.where("ends > 0").select("path", "done", F.posexplode(counts).alias("k", "n_tokens")).select("path", (F.col("done") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    lasts = found.groupBy("path").agg(F.max("block").alias("block"))
    open_ = carried.join(lasts, ["path", "block"]).select("path", (F.col("done") + F.col("ends")).alias("ordinal"), F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("head")).alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return ended.unionByName(open_).select(F.element_at(F.split("path", "/"), -1).alias("file"), "ordinal", "n_tokens", "ended")


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, file number and ordinal of each row of ``docs``, counted in flat files written for it.

    Null and empty texts have 0 tokens; null ids stay null and repeated rows are counted each; an empty table gives none.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/flat-{uuid.uuid4().hex}"
    places = write_flat(docs, path)
    found = scan(spark, path).withColumn("file", F.regexp_extract("file", r"part-(\d+)", 1).cast("int"))
    return places.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")

"""A training-data pipeline of four stages; each works on what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline.llm import lang_id, minhash, mixing, packing
from kerbline.llm.shared import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; without text or letters, or unlike all of them, they go."""
    return lang_id.accepted(docs, lang_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similar sets of shingles of five words, that with the least id.

    Texts that are null, empty or without words are like no other and stay, and so do all rows with a null id. Of rows that
    repeat an id one stays. Further columns are kept as they are.
    """
    return minhash.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: never, once or twice.

    A null source is one of its own. A document without words isn't taken; rows that repeat an id, or have none, are ties by
    their key and then in the order of their ids.
    """
    return mixing.mixed_rows(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in full sequences; a copy that the mix took twice is packed twice.

    A null or empty text is the end id alone; a null id stays null.
    """
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("sequences", sequences)]

#: The stages run models, hash minima and a tokenizer, which SQL can't express: tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

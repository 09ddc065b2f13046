"""Rows that every operator must bear: nulls, empty and long texts, ties, repeated rows, columns whose names clash."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, block int, key string, cid long, size long"


def documents(spark, rows: list[tuple], partitions: int = 3):
    """(doc_id, text, lang, source) as a table with more columns whose names the operators use themselves."""
    full = [(*r, len(r[1] or ""), 1, "k", 2, 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def rows() -> list[tuple]:
    near = prose(1, 120).split()
    out = [(i, prose(i, 60 + i), "en" if i % 2 else "de", f"s{i % 3}") for i in range(20, 40)]
    out += [(1, " ".join(near), "en", "a"), (2, " ".join(near), "en", "b"), (3, " ".join([*near[:118], "other", "end"]), "en", "a"), (4, " ".join(near).upper(), "en", "a")]
    out += [(5, None, "en", "a"), (6, "", "en", None), (7, " \t\n", None, "b"), (8, "One", "en", "b"), (9, "one", "en", "b"), (10, "two words", "de", "a")]
    out += [(11, prose(5, 30_000), "en", "a"), (8, "One", "en", "b"), (None, " ".join(near), "en", "a"), (None, None, None, None), (12, "nul\0 byte \x1c here äß \U0001f600", "de", "c")]
    return out

"""Approximate nearest neighbours by cosine over randomly rotated one-bit codes, reranked exactly.

Every vector is indexed by its code and correction factor. Queries are compared with all codes, block by block; of a block
only vectors whose upper bound reaches the k-th best lower bound are compared exactly, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.llm.bit_codes import cosines, encoded, estimates, usable
from kerbline.llm.shared import columns, stored

#: Bits of a code, standard deviations of the bounds, indexed vectors of a block and queries of a group.
BITS, SIGMAS, BLOCK, GROUP = 512, 4.0, 4096, 2048


def index(vectors: DataFrame, bits: int = BITS) -> DataFrame:
    """vec_id, dim, vector (bytes of doubles), code and factor of each usable row of ``vectors`` (vec_id, embedding)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(i, x) for i, x in zip(batch["vec_id"].tolist(), map(usable, batch["embedding"]), strict=True) if x is not None]
            for dim in sorted({len(x) for _, x in made}):
                own = [(i, x) for i, x in made if len(x) == dim]
                codes, factors = encoded(np.stack([x for _, x in own]), max(bits, -(-dim // 8) * 8))
                yield pd.DataFrame({"vec_id": [i for i, _ in own], "dim": dim, "vector": [x.tobytes() for _, x in own], "code": [c.tobytes() for c in codes], "factor": factors})

    return columns(vectors, "vec_id", "embedding").where("vec_id is not null and embedding is not null").mapInPandas(task, "vec_id long, dim int, vector binary, code binary, factor double")


def search(indexed: DataFrame, queries: Column, k: int, sigmas: float = SIGMAS, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine): the k nearest rows of ``indexed`` for each row where ``queries`` holds.

    A row is no neighbour of rows with its own id; vectors of another dimension take no part; ties go to the smaller id,
    then to repeated rows as they are. Fewer rows than k give all of them, an empty table none.
    """
    indexed = stored(indexed, "codes")
    sizes = indexed.agg(F.count("*"), F.count(F.when(queries, 1))).first()
    blocks, groups = max(1, -(-sizes[0] // block)), max(1, -(-sizes[1] // group))
    spot = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = indexed.select("dim", spot(blocks).alias("block"), every(groups).alias("group"), "vec_id", "vector", "code", "factor")
    right = indexed.where(queries).select("dim", every(blocks).alias("block"), spot(groups).alias("group"), "vec_id", "vector")

    def near(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(asked):
            x, q = (np.frombuffer(b"".join(t["vector"]), np.float64).reshape(len(t), -1) for t in (rows, asked))
            codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
            ids, own = rows["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
            for a in range(0, len(q), 256):
                guess, width = estimates(q[a : a + 256], codes, rows["factor"].to_numpy(), sigmas)
                for i, line in enumerate(guess):
                    other = ids != own[a + i]
                    low = np.where(other, line - width, -np.inf)
                    least = np.partition(low, -k)[-k] if len(low) > k else -np.inf
                    at = np.flatnonzero(other & (line + width >= least))
                    exact = cosines(np.broadcast_to(q[a + i], (len(at), q.shape[1])), x[at])
                    best = np.lexsort((ids[at], -exact))[:k]
                    out += zip([own[a + i]] * len(best), ids[at][best], exact[best], strict=True)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["dim", "block", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(near, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

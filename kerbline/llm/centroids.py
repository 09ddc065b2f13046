"""Centroid clustering of whole-number vectors: Lloyd's rounds with a partial-distance search.

A vector meets the centroids one after the other. Squared differences are summed over the dimensions of most variance
first, some at a time, and a centroid is abandoned once its sum is strictly above the best full distance so far; those that
are left finish all dimensions. A task holds the few centroids and gives one sum for each of them and its dimensions, so
that a round gathers a fixed number of sums, whatever the vectors. All is in whole numbers, so that no order of adding
changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.shared import columns, dropped, stored

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
#: Dimensions added between two looks at the best distance, and vectors looked at together.
STEP, BLOCK = 8, 8192
#: Components are held to this, so that 64 squared differences fit into a long.
MOST = 1 << 27


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and x (floor(scale * component)) of the rows of ``vectors`` (vec_id, embedding) with ``dimensions`` finite components."""
    kept = columns(vectors, "vec_id", "embedding")
    whole = (F.size("embedding") == dimensions) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    component = lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(c.cast("double") * scale))).cast("int")
    return kept.where(F.col("embedding").isNotNull() & whole).select("vec_id", F.transform("embedding", component).alias("x"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dimensions)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row of ``x``; ties go to the smaller number.

    ``order`` has the dimensions in which sums run. A centroid that isn't abandoned has its full distance in the end.
    """
    x, centroids = np.ascontiguousarray(x[:, order]), centroids[:, order]
    best = ((x - centroids[0]) ** 2).sum(axis=1)
    number = np.zeros(len(x), np.int64)
    for c in range(1, len(centroids)):
        left, part = np.arange(len(x)), np.zeros(len(x), np.int64)
        for d in range(0, x.shape[1], step):
            block = x[:, d : d + step] if len(left) == len(x) else x[left, d : d + step]
            part = part + ((block - centroids[c, d : d + step]) ** 2).sum(axis=1)
            open_ = part <= best[left]
            if not open_.all():
                left, part = left[open_], part[open_]
            if not len(left):
                break
        closer = part < best[left]
        best[left[closer]], number[left[closer]] = part[closer], c
    return number, best


def _first(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes; rows that repeat an id in the order of their components."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = vectors.select(code.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], np.int64)


def _sums(vectors: DataFrame, dimensions: int, centroids: np.ndarray | None, order: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Exact (counts, sums) by cluster and dimension, as Python's whole numbers. Without centroids: sums and sums of squares of all."""
    groups = 2 if centroids is None else len(centroids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(groups, object), np.zeros((groups, dimensions), object)
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column(0).slice(s, BLOCK), dimensions)
                if centroids is None:
                    counts += len(x)
                    sums[0] += x.sum(axis=0)
                    sums[1] += (x * x >> 10).sum(axis=0)  # for the order alone, which changes no result
                    continue
                number, _ = nearest(x, centroids, order)
                counts += np.bincount(number, minlength=groups)
                by = np.argsort(number, kind="stable")
                has, at = np.unique(number[by], return_index=True)
                sums[has] += np.add.reduceat(x[by], at, axis=0)
        has = [g for g in range(groups) if counts[g]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(has, dimensions + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, dimensions, dtype=np.int32), len(has))), pa.array([str(v) for g in has for v in (counts[g], *sums[g])])], ["cluster", "dim", "part"]
        )

    parts = vectors.select("x").mapInArrow(task, "cluster int, dim int, part string")
    total = parts.groupBy("cluster", "dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    counts, sums = np.zeros(groups, object), np.zeros((groups, dimensions), object)
    for r in total.collect():
        if r["dim"] < 0:
            counts[r["cluster"]] = int(r["total"])
        else:
            sums[r["cluster"], r["dim"]] = int(r["total"])
    return counts, sums


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each row of ``vectors`` that counts.

    Rows whose vector is null, of another length or with a null or non-finite component are left out; those with a null id
    stay (its hash is that of 'null'), and repeated rows count each. Fewer vectors than clusters make as many clusters; an
    empty table gives no rows. A cluster that no vector is nearest to keeps its centroid. Components beyond 2**27 either way
    are held to it. Other columns are ignored.
    """
    whole = quantised(vectors, dimensions, scale)
    x = stored(whole, "centroid-vectors")
    centroids = _first(x, clusters, seed)
    schema = f"vec_id {dict(x.dtypes)['vec_id']}, cluster int, distance long"
    if not len(centroids):
        return x.sparkSession.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    counts, sums = _sums(x, dimensions, None, None)
    spread = [1024 * int(sums[1][d]) * int(counts[0]) - int(sums[0][d]) ** 2 for d in range(dimensions)]
    order = np.array(sorted(range(dimensions), key=lambda d: -spread[d]))
    for _ in range(rounds):
        counts, sums = _sums(x, dimensions, centroids, order)
        centroids = np.array([[s // n for s in sums[c]] if (n := counts[c]) else centroids[c] for c in range(len(centroids))], np.int64)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                part = batch.slice(s, BLOCK)
                number, distance = nearest(_matrix(part.column(1), dimensions), centroids, order)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    last = stored(x.select("vec_id", "x").mapInArrow(assigned, schema), "centroid-assigned")
    dropped(x)
    own = {r["cluster"]: r["n"] for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    most = 2**63 - 1
    rows = [(c, min(int(own.get(c, 0)), most), min(int(sum(own.values())), most), _digest(centroid)) for c, centroid in enumerate(centroids)]
    of = x.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

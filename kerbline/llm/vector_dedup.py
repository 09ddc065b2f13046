"""Near-duplicate vectors: rotated one-bit codes find and screen pairs, and exact cosines decide those within the bounds.

Equal vectors are one class; everything after works on classes. Slices of the codes are the keys of as many tables, by
which two vectors as close as a link asks meet at least once but for a chance of ``MISS``. Buckets of a table are screened
by the distance of their codes, which leaves out vectors that met by chance. What is left is compared in blocks of bounded
size: estimates from codes and correction factors rule pairs out, the others are computed exactly. A pair counts in the
first table in which it meets. A block returns sums and a spanning forest, never pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.bit_codes import cosines, encoded, estimates, usable
from kerbline.llm.components import components
from kerbline.llm.shared import columns, stored

LEAST, MISS = 0.95, 1e-6
#: Standard deviations of the bounds; rows of a block; buckets above this size go to the blocks without being screened.
SIGMAS, BLOCK, SCREENED = 6.0, 1024, 256
#: Leading bits of a code that the screening compares.
SCREEN_BITS = 192


def tables(n: int, least: float, miss: float) -> tuple[int, int]:
    """(tables, bits of a key): a key has about as many values as there are vectors, tables as many as ``miss`` asks."""
    bits = max(8, math.ceil(math.log2(max(n, 2))))
    same = 1 - math.acos(least) / math.pi
    return math.ceil(math.log(miss) / math.log1p(-(same**bits))), bits


def _keys(codes: np.ndarray, dim: int, n: int, bits: int) -> np.ndarray:
    """Keys of n tables: dimension, table and bits as one long."""
    planes = np.unpackbits(codes, axis=1)[:, : n * bits].reshape(len(codes), n, bits).astype(np.int64)
    return (planes << np.arange(bits)).sum(axis=2) + (dim * n + np.arange(n, dtype=np.int64) << bits)


def _coded(vectors: DataFrame, bits: int) -> DataFrame:
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(i, x) for i, x in zip(batch["vec_id"].tolist(), map(usable, batch["embedding"]), strict=True) if x is not None]
            for dim in sorted({len(x) for _, x in made}):
                own = [(i, x) for i, x in made if len(x) == dim]
                codes, factors = encoded(np.stack([x for _, x in own]), max(bits, -(-dim // 64) * 64))
                digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for _, x in own]
                yield pd.DataFrame({"vec_id": [i for i, _ in own], "cid": [int.from_bytes(d[:8], "little") >> 1 for d in digests], "digest": digests, "dim": dim, "vector": [x.tobytes() for _, x in own], "code": [c.tobytes() for c in codes], "factor": factors})

    return vectors.where("vec_id is not null and embedding is not null").mapInPandas(task, "vec_id long, cid long, digest binary, dim int, vector binary, code binary, factor double")


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of whole groups from batches that are sorted by ``by``: a group that a batch cuts waits for the next."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = np.logical_and.reduce([batch[c].to_numpy() == batch[c].iat[-1] for c in by])
        cut = len(batch) - int(np.argmin(last[::-1])) if not last.all() else 0
        joins = bool(held) and all(held[-1][c].iat[-1] == batch[c].iat[0] for c in by)
        if cut or held and not joins:
            head = batch.iloc[:cut]
            done = pd.concat([*held, head], ignore_index=True) if held else head.reset_index(drop=True)
            held = []
            if len(done):
                yield done
        held.append(batch.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _most_apart(bits: int, least: float) -> float:
    """Bits of ``bits`` in which the codes of two linked vectors differ at most, by ``SIGMAS`` standard deviations."""
    apart = math.acos(least) / math.pi
    return bits * apart + SIGMAS * math.sqrt(bits * apart * (1 - apart))


def _screened(rows: DataFrame, least: float) -> DataFrame:
    """Rows (key, cid) of small buckets that are as near to another of their bucket as a link allows, by their codes' heads."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _groups(batches, ["key"]):
            key = part["key"].to_numpy()
            head = np.frombuffer(b"".join(part["head"]), np.uint64).reshape(len(part), -1)
            most = _most_apart(head.shape[1] * 64, least)
            near, shift = np.zeros(len(part), bool), 1
            while shift < len(part) and (same := key[:-shift] == key[shift:]).any():
                at = np.flatnonzero(same)
                hit = at[np.bitwise_count(head[at] ^ head[at + shift]).sum(axis=1) <= most]
                near[hit] = near[hit + shift] = True
                shift += 1
            yield part.loc[near, ["key", "cid"]]

    return rows.select("key", "cid", "head").repartition("key").sortWithinPartitions("key").mapInPandas(task, "key long, cid long")


def _compared(rows: DataFrame, n_tables: int, bits: int, least: float) -> DataFrame:
    """cid, links (vectors of other classes linked with it, in this block) and root (of the block's spanning forest)."""

    def pairs(x: pd.DataFrame, y: pd.DataFrame, table: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.frombuffer(b"".join(t["vector"]), np.float64).reshape(len(t), -1) for t in (x, y))
        ca, cb = (np.frombuffer(b"".join(t["code"]), np.uint8).reshape(len(t), -1) for t in (x, y))
        guess, width = estimates(a, cb, y["factor"].to_numpy(), SIGMAS)
        open_ = guess + width >= least
        if same:
            open_ = np.triu(open_, 1)
        i, j = np.nonzero(open_)
        found_i, found_j = [], []
        for s in range(0, len(i), 65_536):
            p, q = i[s : s + 65_536], j[s : s + 65_536]
            # The screen of small buckets, so that a pair passes or not whatever the sizes of the buckets in which it meets.
            near = np.bitwise_count(ca[p][:, -SCREEN_BITS // 8 :] ^ cb[q][:, -SCREEN_BITS // 8 :]).sum(axis=1) <= _most_apart(SCREEN_BITS, least)
            p, q = p[near], q[near]
            hit = cosines(a[p], b[q]) >= least
            p, q = p[hit], q[hit]
            first = np.ones(len(p), bool)
            for t in range(table):  # pairs that an earlier table has
                left = np.flatnonzero(first)
                lo, hi = t * bits, (t + 1) * bits
                byte = slice(lo // 8, -(-hi // 8))
                diff = np.unpackbits(ca[p[left], byte] ^ cb[q[left], byte], axis=1)[:, lo - lo // 8 * 8 :][:, :bits]
                first[left[~diff.any(axis=1)]] = False
            found_i.append(p[first])
            found_j.append(q[first])
        return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, int), np.zeros(0, int))

    def block(part: pd.DataFrame) -> pd.DataFrame:
        table = int(part["key"].iat[0] >> bits) % n_tables
        side = part["left"].to_numpy(bool)
        same = bool(part["i"].iat[0] == part["j"].iat[0])
        x = part if same else part[side]
        y = part if same else part[~side]
        if not len(x) or not len(y):
            return pd.DataFrame(columns=["cid", "links", "root"])
        i, j = pairs(x, y, table, same)
        if not same:
            j = j + len(x)
            part = pd.concat([x, y])
        ids, size = part["cid"].to_numpy(), part["n"].to_numpy()
        links = np.bincount(i, weights=size[j], minlength=len(part)) + np.bincount(j, weights=size[i], minlength=len(part))
        root = ids.copy()
        while True:
            least_ = root.copy()
            np.minimum.at(least_, i, root[j])
            np.minimum.at(least_, j, root[i])
            if (least_ == root).all():
                break
            root = least_
        has = links > 0
        return pd.DataFrame({"cid": ids[has], "links": links[has].astype(np.int64), "root": root[has]})

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _groups(batches, ["key", "i", "j"]):
            for _, part in run.groupby(["key", "i", "j"], sort=False):
                yield block(part)

    keys = ["key", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(task, "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = LEAST, miss: float = MISS) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id and kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a null id, link with nothing:
    n_links is 0 and the component their own id. Vectors of different dimensions don't link. Rows that repeat an id are
    one node, and each other row counts as a link. Other columns, labels among them, are ignored.
    """
    vectors = columns(vectors, "vec_id", "embedding")
    n_tables, bits = tables(vectors.count(), least, miss)
    total_bits = max(-(-n_tables * bits // 64) * 64, SCREEN_BITS)
    coded = stored(_coded(vectors, total_bits), "vector-codes")
    classes = coded.groupBy("cid", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min_by(F.struct("dim", "vector", "code", "factor"), "vec_id").alias("of"))
    classes = stored(classes.select("cid", "rep", "n", "of.*"), "vector-classes")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 1024):
                part = batch.iloc[s : s + 1024]
                for dim, own in part.groupby("dim"):
                    codes = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), -1)
                    keys = _keys(codes, int(dim), n_tables, bits)
                    heads = [c[-SCREEN_BITS // 8 :].tobytes() for c in codes]
                    yield pd.DataFrame({"key": keys.ravel(), "cid": own["cid"].to_numpy().repeat(n_tables), "head": [h for h in heads for _ in range(n_tables)]})

    keys = classes.select("cid", "dim", "code").mapInPandas(keyed, "key long, cid long, head binary")
    counts = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = stored(keys.join(counts, "key"), "vector-met")
    near = _screened(met.where(f"m <= {SCREENED}"), least).unionByName(met.where(f"m > {SCREENED}").select("key", "cid"))
    near = stored(near, "vector-near")
    sizes = near.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    rows = near.join(sizes, "key").withColumn("c", F.pmod(F.xxhash64("cid"), F.col("chunks"))).withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.select("key", "cid", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), (F.col("c") <= F.col("d")).alias("left"))
    rows = rows.join(classes.select("cid", "n", "vector", "code", "factor"), "cid")
    found = stored(_compared(rows, n_tables, bits, least), "vector-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    first = classes.select("cid", "rep")
    within = coded.join(classes.where("n > 1").select("cid", "rep"), "cid").where("vec_id != rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    between = found.select("cid", "root").join(first.withColumnRenamed("rep", "a"), "cid").join(first.select(F.col("cid").alias("root"), F.col("rep").alias("b")), "root")
    joined = components(within.unionByName(between.select("a", "b")))
    mine = coded.select("vec_id", "cid").distinct().join(classes.select("cid", "n"), "cid").join(links, "cid", "left")
    mine = mine.groupBy("vec_id").agg(F.max(F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = vectors.select("vec_id").join(mine, "vec_id", "left").join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))

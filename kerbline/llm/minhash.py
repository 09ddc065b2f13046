"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact check, connected components.

Documents with the same set of shingles are one class; everything after works on classes. Classes that share a band are in
one bucket, and buckets of the same classes are one. In each of two rounds a class is compared with one leader of its
buckets, which joins groups of close copies with one comparison for each member. Members of a bucket that are then still
in another component than its leader are compared with all others of the bucket, in blocks of bounded size. So every pair of different components that shares a band is
looked at, no matter how large the bucket. Signatures only reject, with a margin of six standard deviations; a link is
always confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.components import components
from kerbline.llm.shared import columns, dropped, stored, text_batches
from kerbline.llm.textnum import BASE, mixed, shingle_hashes, word_hashes

#: Bands of so many minima each: two sets of similarity 0.8 share none with probability 5e-6.
BANDS, ROWS = 40, 6
#: Similarity of a link, as a fraction.
LEAST = (80, 100)
SHINGLE = 5
#: Standard deviations below the limit at which a signature rejects a pair.
SIGMAS = 6.0
#: Rows of a block on either side, and members of a leader that one task compares.
BLOCK, CHUNK = 1024, 512
#: Rows of numbers that are sent to all executors at most: 30 MB.
SENT_ROWS = 300_000
#: Rounds in which each class is compared with one leader of its buckets, before buckets are compared as a whole.
LEADER_ROUNDS = 2


def universal(n: int, seed: int = 20_240_601) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of n multiply-add-shift hash functions from 32 to 32 bits, strongly universal: (a x + b) mod 2**64 >> 32."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, np.uint64)


def class_key(shingles: np.ndarray) -> tuple[int, bytes]:
    """A class's id (of 63 bits) and digest from its sorted distinct shingles."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little") >> 1, digest


def _sets(texts: list, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for a, b in text_batches(texts, 128_000):
        h, at = shingle_hashes(*word_hashes(texts[a:b]), k)
        for i in range(b - a):
            yield a + i, np.unique(h[at[i] : at[i + 1]])


def minima(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Minima of all hash functions (columns) over each set (rows); no set may be empty."""
    a, b = universal(bands * rows)
    x = np.concatenate(sets) >> np.uint64(32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(a)), np.uint64)
    turned = np.empty_like(x)
    for i in range(len(a)):
        np.multiply(x, a[i], out=turned)
        turned += b[i]
        out[:, i] = np.minimum.reduceat(turned, starts)
    return out >> np.uint64(32)


def _sketches(sets: list[np.ndarray], bands: int, rows: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Signature (a byte of each minimum) and band keys of each set; no set may be empty."""
    mins = minima(sets, bands, rows) if sets else np.zeros((0, bands * rows), np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64)[None, :].repeat(len(sets), 0)
    for j in range(rows):
        h = mixed(h * np.uint64(BASE) + mins[:, j::rows][:, :bands])
    for low, keys in zip(mins.astype(np.uint8), h.view(np.int64), strict=True):
        yield low.tobytes(), keys


def _runs(texts: list, k: int) -> Iterator[list[np.ndarray]]:
    """The sets of the texts in runs that stay in a core's cache."""
    held, size = [], 0
    for _, x in _sets(texts, k):
        held.append(x)
        size += len(x)
        if size > 40_000:
            yield held
            held, size = [], 0
    yield held


def sketch(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, class id and digest, and band keys of each row."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, cid, digests, band_keys = [], [], [], []
            for held in _runs(batch["text"].tolist(), k):
                found = _sketches([x for x in held if len(x)], bands, rows)
                for x in held:
                    c, digest = class_key(x) if len(x) else (None, None)
                    n.append(len(x))
                    cid.append(c)
                    digests.append(digest)
                    band_keys.append(next(found)[1] if len(x) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_shingles": n, "cid": pd.Series(cid, dtype="Int64"), "digest": digests, "bands": band_keys})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(task, "doc_id long, n_shingles long, cid long, digest binary, bands array<long>")


def _cut(n: int, least: tuple[int, int]) -> float:
    s = least[0] / least[1]
    s += (1 - s) / 256  # bytes of different minima agree by chance
    return s - SIGMAS * np.sqrt(s * (1 - s) / n)


def _full(active: DataFrame, docs: DataFrame, classes: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """cid, signature, band keys and shingles (sorted, as bytes) of the classes in ``active``: the texts of their first documents are read again."""
    wanted = stored(active.select("cid").distinct().join(classes.select("cid", "rep"), "cid"), "minhash-wanted")
    ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
    # A million ids are 8 MB; with more, the texts are sent to the ids.
    ids = F.broadcast(ids) if wanted.count() <= 1_000_000 else ids

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for held in _runs(batch["text"].tolist(), k):
                full = [x for x in held if len(x)]
                out += [(class_key(x)[0], sig, keys, x.tobytes()) for x, (sig, keys) in zip(full, _sketches(full, bands, rows), strict=True)]
            yield pd.DataFrame(out, columns=["cid", "sig", "bands", "shingles"])

    # Rows that repeat an id give one row for each of their texts, and equal texts one.
    found = docs.join(ids, "doc_id", "left_semi").select("text").mapInPandas(sets, "cid long, sig binary, bands array<long>, shingles binary")
    found = found.groupBy("cid").agg(F.first(F.struct("sig", "bands", "shingles")).alias("x")).select("cid", "x.*")
    out = stored(found.join(wanted.select("cid"), "cid", "left_semi"), "minhash-full")
    dropped(wanted)
    return out


def _shared(classes: DataFrame) -> DataFrame:
    """Rows (key, leader, cid) of the bands that several classes share; of bands shared by just the same classes the first.

    Close copies share most of their bands, and so do whole groups: each set of classes is looked at once. Equal sets are
    told by their size, least member and two sums of hashes. For any two classes the first of their shared bands stays,
    since a band with just the same classes that comes before it would be shared by the two as well.
    """
    keys = classes.select("cid", F.posexplode("bands").alias("band", "key"))
    buckets = stored(keys.groupBy("key").count().where("count > 1").select("key"), "minhash-shared")
    # A million keys are 8 MB; with more, bands are sent to the keys.
    small = F.broadcast(buckets) if buckets.count() <= 1_000_000 else buckets
    met = stored(keys.join(small, "key").select("key", "band", "cid"), "minhash-met")
    sums = [F.bit_xor(F.xxhash64("cid", F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    sets = met.groupBy("key").agg(F.count("*").alias("m"), F.min("cid").alias("leader"), F.min("band").alias("band"), *sums)
    one = sets.groupBy("m", "leader", "h1", "h2").agg(F.min_by("key", "band").alias("key")).select("key", "leader")
    out = stored(met.join(one, "key").select("key", "leader", "cid"), "minhash-buckets")
    for used in (buckets, met):
        dropped(used)
    return out


def _bounded(df: DataFrame) -> DataFrame:
    """``df``, stored and of a few numbers a row, marked for a broadcast if it has at most ``SENT_ROWS`` rows; with more, both sides of its joins are shuffled."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def _labelled(active: DataFrame, links: DataFrame | None) -> DataFrame:
    """``active`` with the components of its classes and leaders by the links so far: own and lead."""
    if links is None:
        return active.withColumn("own", F.col("cid")).withColumn("lead", F.col("leader"))
    labels = components(links)
    label = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    rows = active.join(label("cid"), "cid", "left").join(label("leader"), "leader", "left")
    return rows.select("key", "leader", "cid", F.coalesce("cid_in", "cid").alias("own"), F.coalesce("leader_in", "leader").alias("lead"))


def _with_leaders(rows: DataFrame, full: DataFrame, least: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Compares each class with one leader, that of most of its buckets among those in another component: pairs and links.

    The members of a leader a are dealt out in chunks, each with the leader's set in front, and compared one by one as
    they stream by: by signature first, and then on the full sets.
    """
    pairs = rows.where("own != lead").groupBy("cid", F.col("leader").alias("a")).count()
    pairs = stored(pairs.groupBy("cid").agg(F.max_by("a", F.struct("count", (-F.col("a")).alias("a"))).alias("a")), "minhash-pairs")
    heads = pairs.groupBy("a").count().where(f"count > {CHUNK}").select("a", F.ceil(F.col("count") / CHUNK).alias("n"))
    # One row for each 512 pairs at most, and so few.
    dealt = pairs.join(F.broadcast(heads) if heads.count() <= 1_000_000 else heads, "a", "left").withColumn("chunk", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("cid"), F.col("n"))))
    dealt = stored(dealt.select("a", "chunk", "cid").unionByName(dealt.select("a", "chunk", F.col("a").alias("cid")).distinct()), "minhash-dealt")
    met = full.select("cid", "sig", "shingles").join(_bounded(dealt), "cid")
    met = met.withColumn("member", F.col("cid") != F.col("a")).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "member", "cid")
    top, of = least

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, head, sig = None, np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        for batch in batches:
            out = []
            for a, chunk, member, cid, code, data in zip(batch["a"], batch["chunk"], batch["member"], batch["cid"], batch["sig"], batch["shingles"], strict=True):
                own = np.frombuffer(code, np.uint8)
                if not member:
                    at, head, sig = (a, chunk), np.frombuffer(data, np.uint64), own
                    continue
                assert at == (a, chunk)
                if (own == sig).mean() < _cut(len(sig), least):
                    continue
                x = np.frombuffer(data, np.uint64)
                both = len(head) + len(x) - len(np.union1d(head, x))
                if of * both >= top * (len(head) + len(x) - both):
                    out.append((a, cid))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    found = stored(met.select("a", "chunk", "member", "cid", "sig", "shingles").mapInPandas(compare, "a long, b long"), "minhash-links")
    dropped(dealt)
    return pairs.select("a", F.col("cid").alias("b")), found


def _candidates(rows: pd.DataFrame, least: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """Of a block's rows that ask: the positions of those in other components that the signatures don't rule out, nearest first.

    A pair that shares several bands is looked at in the first of them.
    """
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), -1)
    bands = np.stack(rows["bands"].to_numpy())
    own, asks, key = rows["own"].to_numpy(), rows["asks"].to_numpy(bool), rows["key"].iat[0]
    there = np.flatnonzero(~asks)
    cut = _cut(sig.shape[1], least)
    for i in np.flatnonzero(asks):
        at = there[own[there] != own[i]]
        alike = (sig[at] == sig[i]).mean(axis=1)
        at, alike = at[alike >= cut], alike[alike >= cut]
        if len(at):
            same = bands[at] == bands[i]
            first = bands[i][same.argmax(axis=1)] == key
            at, alike = at[first], alike[first]
            yield i, at[np.argsort(-alike, kind="stable")]


_BLOCK = ["key", "at_i", "at_j"]


def _screened(rows: DataFrame, compared: DataFrame, full: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Members of buckets, in blocks, that have a candidate there: a class of another component that the signatures don't rule out.

    Members in another component than their bucket's leader ask all of the bucket. Buckets of two are left out if ``compared``.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("m"), F.count(F.when(F.col("own") != F.col("lead"), 1)).alias("others"), F.first("leader").alias("a"), F.max("cid").alias("b")).where("others > 0")
    sizes = sizes.join(compared.withColumn("m", F.lit(2)), ["m", "a", "b"], "left_anti")
    rows = rows.join(sizes.select("key", "m", "others"), "key").withColumn("other", F.col("own") != F.col("lead")).withColumn("i", F.ceil(F.col("others") / BLOCK)).withColumn("j", F.ceil(F.col("m") / BLOCK))
    rows = rows.join(full.select("cid", "sig", "bands"), "cid")
    spot = lambda n: F.pmod(F.xxhash64("cid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.where("other").withColumn("at_i", spot("i")).withColumn("at_j", every("j")).withColumn("asks", F.lit(True))
    right = rows.withColumn("at_j", spot("j")).withColumn("at_i", every("i")).withColumn("asks", F.lit(False))
    names = [*_BLOCK, "asks", "cid", "own", "sig", "bands"]

    def screen(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = np.zeros(len(pdf), bool)
        for i, at in _candidates(pdf, least):
            kept[i] |= len(at) > 0
            kept[at] = True
        return pdf.loc[kept, [*_BLOCK, "asks", "cid", "own"]]

    return left.select(names).unionByName(right.select(names)).groupBy(*_BLOCK).applyInPandas(screen, "key long, at_i long, at_j long, asks boolean, cid long, own long")


def _across(screened: DataFrame, full: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Links (a, b) between the classes of a block that are in different components, confirmed on their full sets.

    Nearest pairs come first, and none is looked at whose ends have been joined meanwhile: it emits a spanning forest.
    """
    top, of = least

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        sets_ = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        cid, own, out = pdf["cid"].to_numpy(), pdf["own"].to_numpy().copy(), []
        for i, at in _candidates(pdf, least):
            x = sets_[i]
            for s in range(0, len(at), 64):
                some = at[s : s + 64][own[at[s : s + 64]] != own[i]]
                if not len(some):
                    continue
                sizes_ = np.array([len(sets_[y]) for y in some])
                flat = np.concatenate([sets_[y] for y in some])
                hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
                both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes_) - sizes_)
                for y in some[of * both >= top * (len(x) + sizes_ - both)]:
                    if own[y] != own[i]:
                        out.append((cid[i], cid[y]))
                        own[own == own[y]] = own[i]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return full.join(_bounded(screened), "cid").groupBy(*_BLOCK).applyInPandas(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, least: tuple[int, int] = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id and kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set is its distinct shingles of k words, with
    fewer words the whole sequence. Null and empty texts and those without words have no set and link with nothing. The
    component is the least doc_id reachable, and that document is kept; rows that repeat an id are one node and each
    returned. A null doc_id links with nothing: its component is null, and it is kept. Other columns are ignored.
    """
    docs = columns(docs, "doc_id", "text").where("true")
    sketches = stored(sketch(docs, k, bands, rows), "minhash-sketches")
    classes = sketches.where("cid is not null and doc_id is not null").groupBy("cid", "digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("bands").alias("bands"))
    classes = stored(classes.drop("digest"), "minhash-classes")
    active = _shared(classes)
    full = _full(active, docs, classes, k, bands, rows)
    links = compared = None
    for _ in range(LEADER_ROUNDS):
        placed = stored(_labelled(active, links), "minhash-rows")
        pairs, found = _with_leaders(placed, full, least)
        links, compared = (found, pairs) if links is None else (links.unionByName(found), compared.unionByName(pairs))
        dropped(placed)
    placed = stored(_labelled(active, links), "minhash-rows")
    screened = stored(_screened(placed, compared, full, least), "minhash-screened")
    links = stored(links.unionByName(_across(screened, full, least)), "minhash-all-links")
    for used in (active, full, placed, compared, screened):
        dropped(used)
    # Back to documents: a class's members hang on its first, and linked classes are joined by their firsts.
    first = classes.select("cid", "rep")
    within = sketches.join(classes.where("rep != last").select("cid", "rep"), "cid").where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    between = links.join(first.select(F.col("cid").alias("a"), F.col("rep").alias("x")), "a").join(first.select(F.col("cid").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = components(within.unionByName(between))
    out = sketches.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with one row of each near-duplicate component, the one with the least id.

    Of rows that repeat an id the least stays, in the order of their columns; rows with a null id stay.
    """
    found = stored(near_duplicates(docs, **options).where("doc_id is not null"), "minhash-found")
    gone = found.where("not kept").select("doc_id").distinct()
    again = found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    # A million ids are 8 MB; with more, the rows are sent to the ids.
    small = lambda ids: F.broadcast(ids) if ids.count() <= 1_000_000 else ids
    again = small(again)
    kept = docs.join(small(gone), "doc_id", "left_anti").select(docs.columns)
    once = kept.join(again, "doc_id", "left_anti").select(docs.columns)
    least = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
    return once.unionByName(least)

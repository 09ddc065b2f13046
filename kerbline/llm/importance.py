"""Target-distribution importance resampling: hashed word and word-pair features, weighed by a target against the corpus.

Features come from a vectorised automaton over the UTF-8 bytes of an Arrow buffer: a lookup table classifies every byte,
words begin and end where the class changes, and table-driven CRCs advance over the bytes of all words at once, one byte of
each a step. A pair of words goes on from the state of its first word. Counts of buckets are the only thing gathered from
the corpus: a fixed number of sums. Then each row is weighed by itself, and the draw is a sort.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.llm.shared import columns, dropped, stored

BUCKETS, DRAWN_PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7
#: Bytes that numpy looks at in one go; and steps after which the few words that are longer still go on one by one.
CHUNK, STEPS = 1 << 22, 48

#: Classes of bytes: 1 in words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, once A-Z are lower case.
_WORD = np.zeros(256, np.uint8)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _crc_table() -> np.ndarray:
    """What a byte makes of the low byte of a CRC-32 state, by the reflected polynomial."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> 1 ^ np.uint32(0xEDB88320), x >> 1)
    return x.astype(np.uint32)


_CRC = _crc_table()


def _advanced(state: np.ndarray, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states after the bytes raw[start : start + length], all words a byte further at each step, longest words first."""
    order = np.argsort(-length, kind="stable")
    now, at, left = state[order], start[order], length[order]
    most = int(left[0]) if len(left) else 0
    going = len(left) - np.searchsorted(left[::-1], np.arange(min(most, STEPS)), side="right")
    for step, n in enumerate(going.tolist()):
        now[:n] = _CRC[(now[:n] ^ raw[at[:n] + step]) & 0xFF] ^ now[:n] >> np.uint32(8)
    for i in range(int(np.count_nonzero(left > STEPS))):
        done = zlib.crc32(raw[at[i] + STEPS : at[i] + left[i]], int(now[i]) ^ 0xFFFFFFFF)
        now[i] = done ^ 0xFFFFFFFF
    out = np.empty_like(now)
    out[order] = now
    return out


def features(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of words, text of each, buckets of pairs, text of each) of texts raw[offsets[i] : offsets[i + 1]], in order."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = _WORD[raw]
    change = np.diff(word)
    starts, ends = change[:-1] == 1, change[1:] == -1
    # A text's edge cuts words that its neighbours' bytes would join.
    cut = offsets[(offsets > 0) & (offsets < len(raw))]
    starts[cut] |= word[cut + 1] == 1
    ends[cut - 1] |= word[cut] == 1
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    length = end - start
    raw = _LOWER[raw]
    text = np.searchsorted(offsets, start, side="right") - 1
    state = _advanced(np.full(len(start), 0xFFFFFFFF, np.uint32), raw, start, length)
    pair = np.flatnonzero(text[1:] == text[:-1])
    spaced = _CRC[(state[pair] ^ np.uint32(0x20)) & 0xFF] ^ state[pair] >> np.uint32(8)
    both = _advanced(spaced, raw, start[pair + 1], length[pair + 1])
    code = lambda x: ((x ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64)
    return code(state), text, code(both), text[pair]


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, bytes, offsets) of runs of texts of about ``CHUNK`` bytes; a longer text stands alone."""
    column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    at = np.frombuffer(places, wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, side="right")) - 1)
        yield first, last - first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def bucket_counts(texts: DataFrame, column: str, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket. A task sends one sum for each bucket; the driver gets ``buckets`` of them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, raw, offsets in _chunks(batch.column(0)):
                one, _, two, _ = features(raw, offsets, buckets)
                total += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], ["bucket", "n"])

    found = columns(texts, column).mapInArrow(task, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket the floored 1000 ln of its smoothed share in the target over that in the corpus, in doubles."""
    n, of_corpus, of_target = float(len(corpus)), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (of_corpus + n) / ((s + 1.0) * (of_target + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean gain of the features, 0 without any) of each row of ``docs``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, pairs, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, n, raw, offsets in _chunks(batch.column(1)):
                one, of_one, two, of_two = features(raw, offsets, len(gain))
                here = slice(first, first + n)
                words[here], pairs[here] = np.bincount(of_one, minlength=n), np.bincount(of_two, minlength=n)
                # Sums of whole numbers, not of doubles: differences of a running sum.
                for bucket, count in ((one, words[here]), (two, pairs[here])):
                    summed = np.concatenate([[0], np.cumsum(gain[bucket])])
                    until = np.cumsum(count)
                    total[here] += summed[until] - summed[until - count]
            features_ = words + pairs
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features_, total // np.maximum(features_, 1)))], ["doc_id", "n_words", "n_features", "weight"])

    kept = columns(docs, "doc_id", "text")
    return kept.mapInArrow(task, f"doc_id {dict(kept.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, drawn_percent: int, least_words: int) -> DataFrame:
    """``rows`` (doc_id, n_words, score) with ``rank`` of those that the draw takes, else null.

    One sort over all tasks by range; a row's rank is its place in its range plus the rows of the ranges before. A range's
    bounds hold the id and a row's number too, so that equal scores and repeated ids are spread.
    """
    rows = rows.withColumns({"_out": F.col("n_words") < least_words, "_row": F.monotonically_increasing_id()})
    rows = stored(rows, "importance-scored")
    order = [F.col("_out"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("_row")]
    inside = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*order)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            yield batch.append_column("_place", pa.array(np.arange(before, before + batch.num_rows)))
            before += batch.num_rows

    schema = ", ".join(f"`{k}` {v}" for k, v in inside.dtypes)
    sorted_ = stored(inside.mapInArrow(placed, f"{schema}, _place long"), "importance-sorted")
    dropped(rows)
    # One row for each range, and their sum: the number of ranges doesn't grow with a range's rows.
    sizes = sorted_.groupBy("_range").agg(F.count("*").alias("_n"), F.count_if(~F.col("_out")).alias("_able"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    taken = F.floor(F.sum("_able").over(Window.partitionBy()) * drawn_percent / 100)
    sizes = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"), taken.alias("_taken"))
    rank = F.col("_before") + F.col("_place") + 1
    out = sorted_.join(F.broadcast(sizes), "_range").withColumn("rank", F.when(~F.col("_out") & (rank <= F.col("_taken")), rank))
    return out.drop("_out", "_row", "_range", "_place", "_before", "_taken")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, drawn_percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank and n_words of each row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    The score is the weight and a Gumbel number from the id, so that the highest ones are a draw without replacement by
    the exponential of weights; a null id counts as the text 'null'. Null and empty texts have no features and weigh 0.
    Ties go to the smaller id, null ids last; rows that repeat an id are ranked each, in any order where all else is equal.
    Texts aren't cut, though one longer than a chunk takes memory of its own. Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, "text", buckets), bucket_counts(target, "text", buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    rows = weighed(docs, gain).withColumn("score", F.col("weight") + gumbel)
    return ranked(rows, drawn_percent, least_words).select("doc_id", "n_features", "weight", "score", "rank", "n_words")

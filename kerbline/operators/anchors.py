"""Anchors that skip: of times in order each is kept that is far enough from the last one kept.

Which times are kept depends on all before. But from each time the next one kept is known at once, and pointers to it can be
composed: doubled, they skip 2, 4, 8 and more anchors in one step. So a stretch of time says what it makes of any time that
the last anchor before it may have, by itself, and only that is put together in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators.folds import folded

#: A stretch is so many times as long as anchors are apart.
STRETCH = 64


def _doubled(following: np.ndarray, most: int) -> list[np.ndarray]:
    """Pointers over 1, 2, 4 ... steps, until ``most`` steps are within reach; len(following) is behind the end."""
    tables = [np.append(following, len(following))]
    while 1 << len(tables) <= most:
        tables.append(tables[-1][tables[-1]])
    return tables


def _far(t: np.ndarray, begin: np.ndarray, end: np.ndarray, since: np.ndarray, apart_s: float, after: bool) -> np.ndarray:
    """For each time of ``since`` the first row from ``begin`` to before ``end`` that is far enough from it; ``end`` if none is."""
    low, high = begin.copy(), end.copy()
    while len(wide := np.flatnonzero(low < high)):
        middle = (low[wide] + high[wide]) // 2
        gap = t[middle] - since[wide]
        far = gap > apart_s if after else gap >= apart_s
        high[wide[far]], low[wide[~far]] = middle[far], middle[~far] + 1
    return low


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Each batch of rows in order with its times, where its groups begin and end, and whether the first group began before it."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns, new = [batch.column(k) for k in keys], np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        begins = np.append(0, np.flatnonzero(new) + 1)
        yield batch, batch.column("t").to_numpy(zero_copy_only=False), begins, np.append(begins[1:], batch.num_rows), before == [c[0].as_py() for c in columns]
        before = [c[-1].as_py() for c in columns]


def passages_in_window(obs: DataFrame, keys: list[str], window_s: float, apart_s: float) -> DataFrame:
    """``obs`` with the passages of each row's keys in the ``window_s`` before it, itself included: kept times ``apart_s`` apart.

    A window begins with the first time in it. Time is cut into spans of the window's length, and each row also goes to the
    span after its own, where it only serves the windows of others; so a hot key is spread over its spans.
    """
    names, schema = obs.columns, ", ".join(f"`{c}` {t}" for c, t in obs.dtypes)
    span = F.floor(F.col("t") / float(window_s))
    rows = obs.withColumn("_own", span).withColumn("_span", F.explode(F.array(span, span + 1)))

    window, apart = round(window_s * 1e6), round(apart_s * 1e6)

    def counted(run: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        """All groups of a run at once: in whole microseconds, each so far from the next that none looks into it."""
        t = np.rint(run["t"].to_numpy() * 1e6).astype(np.int64)
        t += group * (4 * (window + apart)) - t[np.unique(group, return_index=True)[1]][group]
        at, last = np.searchsorted(t, t - window), np.searchsorted(t, t, side="right") - 1
        passages = np.ones(len(t), np.int32)
        tables = _doubled(np.searchsorted(t, t + apart), window // apart + 1)
        for k in reversed(range(len(tables))):
            to = tables[k][at]
            within = to <= last
            passages += within.astype(np.int32) << k
            at = np.where(within, to, at)
        own = (run["_own"] == run["_span"]).to_numpy()
        return run.loc[own, names].assign(passages=passages[own])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            group = held.groupby([*keys, "_span"], sort=False, dropna=False).ngroup().to_numpy()
            if len(group) and group[-1]:  # the last group may go on in the next batch
                whole = group < group[-1]
                yield counted(held[whole], group[whole])
                held = held[~whole].reset_index(drop=True)
        if held is not None and len(held):
            yield counted(held, np.zeros(len(held), np.int64))

    return rows.repartition(*keys, "_span").sortWithinPartitions(*keys, "_span", "t").mapInPandas(task, f"{schema}, passages int")


def anchored(obs: DataFrame, keys: list[str], apart_s: float, after: bool = False) -> DataFrame:
    """``obs`` with anchor (of each row the last kept time of its keys, up to its own) and kept (whether the row is that one).

    A time is kept that is ``apart_s`` after the last one kept, or with ``after`` more than that. A stretch of time works out
    by itself, for each of its rows that may be its first anchor, where the anchors from there end. These rows, a small part
    of all, are put together in order, which tells each stretch the last anchor before it; then it marks its rows. All groups
    of a batch are worked out at once, and a group that goes on in the next is handed on by its anchors alone. A row without a
    time or one of its keys has no place and is not in the result.
    """
    names, schema = obs.columns, ", ".join(f"`{c}` {t}" for c, t in obs.dtypes)
    width = float(apart_s) * STRETCH
    rows = obs.dropna(subset=[*keys, "t"]).withColumn("stretch", F.floor(F.col("t") / width))
    groups = [*keys, "stretch"]
    key_schema = ", ".join(f"{c} {t}" for c, t in rows.select(*groups).dtypes)

    def steps(t: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        end = np.repeat(ends, ends - begins)
        following = _far(t, np.arange(1, len(t) + 1), end, t, apart_s, after)
        return _doubled(np.where(following < end, following, len(t)), STRETCH + 1)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each group, of its possible first anchors those up to ``first`` that lead to the same ``last``."""
        told = lambda of, first, last: pa.RecordBatch.from_arrays([*of.columns, pa.array(first), pa.array(last)], names=[*groups, "first", "last"])
        key, first, last, latest = None, np.empty(0), np.empty(0), None  # of the group that may go on
        for batch, t, begins, stops, goes_on in _grouped(batches, groups):
            if not goes_on:
                if key is not None:
                    yield told(key.take(pa.array(np.zeros(len(first), np.int64))), first, last)
                first, last = np.empty(0), np.empty(0)
            # The last anchor before is older than the stretch: its first is of those within ``apart_s`` of its begin, or the next row.
            earlier = np.append(-np.inf, t[:-1])
            earlier[begins] = -np.inf
            if goes_on:
                earlier[0] = latest
            own = np.flatnonzero((t > earlier) & (earlier < batch.column("stretch").to_numpy() * width + apart_s))
            going = _far(t, np.zeros(len(last), np.int64), np.full(len(last), stops[0]), last, apart_s, after)
            at = np.append(np.where(going < stops[0], going, -1), own)
            moved = np.flatnonzero(at >= 0)
            for table in reversed(steps(t, begins, stops)):
                to = table[at[moved]]
                at[moved] = np.where(to < len(t), to, at[moved])
            reached = np.append(last, t[own])
            reached[moved] = t[at[moved]]
            of = np.append(np.zeros(len(first), np.int64), np.searchsorted(begins, own, side="right") - 1)
            only = np.append((of[1:] != of[:-1]) | (reached[1:] != reached[:-1]), True)
            of, first, last = of[only], np.append(first, t[own])[only], reached[only]
            whole, table = of < len(begins) - 1, batch.select(groups)
            yield told(table.take(pa.array(begins[of[whole]])), first[whole], last[whole])
            key, first, last, latest = table.slice(begins[-1], 1), first[~whole], last[~whole], t[-1]
        if key is not None:
            yield told(key.take(pa.array(np.zeros(len(first), np.int64))), first, last)

    def begun(key: tuple, state: dict, row: object) -> list:
        out = []
        if row.stretch != state["stretch"]:
            out = done(key, state)
            state |= {"stretch": row.stretch, "begun": False, "before": state["last"]}
        gap = float("inf") if state["before"] is None else row.first - state["before"]
        if not state["begun"] and (gap > apart_s or (gap == apart_s and not after)):
            state |= {"begun": True, "last": row.last}
        return out

    def done(key: tuple, state: dict) -> list:
        return [] if state["stretch"] is None else [(*key, state["stretch"], state["before"])]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group begins with the row that tells the last anchor before it and has no time."""
        since = np.empty(0)
        for batch, t, begins, stops, goes_on in _grouped(batches, groups):
            before, row = batch.column("_before").to_numpy(zero_copy_only=False)[begins], ~np.isnan(t)
            handed, since = since, np.where(np.isnan(before), -np.inf, before)
            if goes_on:
                since[0] = handed[-1]
            kept = np.zeros(len(t) + 1, bool)
            first = _far(t, begins + ~row[begins], stops, since, apart_s, after)
            kept[first[first < stops]] = True
            for table in steps(t, begins, stops):
                kept[table[np.flatnonzero(kept)]] = True
            kept = kept[:-1]
            at, size = np.maximum.accumulate(np.where(kept, np.arange(len(t)), -1)), stops - begins
            anchor = np.where(at >= np.repeat(begins, size), t[at], np.repeat(since, size))
            since[-1] = anchor[-1]
            out = pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(anchor), pa.array(kept)], names=[*names, "anchor", "kept"])
            yield out.filter(pa.array(row))

    parts = rows.select(*groups, "t").repartition(*groups).sortWithinPartitions(*groups, "t").mapInArrow(ends, f"{key_schema}, first double, last double")
    start = lambda _: {"stretch": None, "begun": False, "last": None, "before": None}
    told = folded(parts, keys, ["stretch", "first"], start, begun, done, f"{key_schema}, _before double")
    both = rows.unionByName(told, allowMissingColumns=True)
    ordered = both.repartition(*groups).sortWithinPartitions(*groups, F.col("t").asc_nulls_first(), *[c for c in ("event_id",) if c in names])
    return ordered.mapInArrow(marked, f"{schema}, anchor double, kept boolean")


def passages(obs: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Sightings and passages of each key: a sighting less than ``seconds`` after its passage began belongs to it."""
    found = anchored(obs.select(*keys, "t"), keys, seconds)
    return found.groupBy(*keys).agg(F.count("*").cast("int").alias("sightings"), F.count_if("kept").cast("int").alias("passages"))


def merged_fragments(obs: DataFrame, seconds: float = 25) -> DataFrame:
    """Sightings of one plate at one camera merged with the first within ``seconds`` of it (the anchor does not move).

    A merged row has the first and last time seen, summed votes, the best confidence and the first speed known.
    """
    rows = obs.where("plate is not null").select("camera_id", "plate", "t", "event_id", "confidence", "speed_kmh", F.col("votes").cast("long").alias("votes"))
    order = F.struct("t", "event_id")
    return anchored(rows, ["camera_id", "plate"], seconds, after=True).groupBy("camera_id", "plate", "anchor").agg(
        F.min_by("event_id", order).alias("event_id"), F.max("t").alias("last_t"), F.max("confidence").alias("confidence"),
        F.min_by("speed_kmh", F.when(F.col("speed_kmh").isNotNull() & ~F.isnan("speed_kmh"), order)).alias("speed_kmh"), F.sum("votes").alias("votes"), F.count("*").cast("int").alias("fragments"),
    )

"""Ordered folds: what depends on earlier decisions of the same key, and so is no window function.

Spark sorts the rows of each key together; a task streams them and keeps one key's state, never its rows. A moving average
needs no order of its own: it is put together from parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def folded(df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, finish: Callable, schema: str) -> DataFrame:
    """Rows from folding each key's rows in order: ``step(state, row)`` yields rows as they are decided, ``finish(state)`` the last.

    ``start(row)`` makes a key's state from its first row, which ``step`` gets too. Rows that aren't decided yet live in the
    state. Output rows are tuples of the schema.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != at:
                    if at is not None:
                        out += finish(at, state)
                    at, state = key, start(row)
                out += step(key, state, row)
            yield pd.DataFrame(out, columns=names)
        if at is not None:
            yield pd.DataFrame(finish(at, state), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(task, schema)


def min_separation(times: Column, seconds: float) -> Column:
    """Of a sorted array of times those that are at least ``seconds`` after the last one kept."""
    start = F.array().cast("array<double>")
    return F.aggregate(times, start, lambda kept, t: F.when((F.size(kept) == 0) | (t - F.try_element_at(kept, F.lit(-1)) >= seconds), F.concat(kept, F.array(t))).otherwise(kept))


def passages(obs: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Sightings and passages of each key: a sighting less than ``seconds`` after its passage began belongs to it."""

    def step(key: tuple, state: dict, row: object) -> list:
        state["n"] += 1
        if state["anchor"] is None or row.t - state["anchor"] >= seconds:
            state |= {"anchor": row.t, "passages": state["passages"] + 1}
        return []

    schema = ", ".join([f"{k} {dict(obs.dtypes)[k]}" for k in keys] + ["sightings int", "passages int"])
    return folded(obs.select(*keys, "t"), keys, ["t"], lambda _: {"anchor": None, "n": 0, "passages": 0}, step, lambda key, s: [(*key, s["n"], s["passages"])], schema)


def merged_fragments(obs: DataFrame, seconds: float = 25) -> DataFrame:
    """Sightings of one plate at one camera merged with the first within ``seconds`` of it (the anchor does not move).

    A merged row has the first and last time seen, summed votes, the best confidence and the first speed known.
    """
    schema = "camera_id string, plate string, event_id long, anchor double, last_t double, confidence double, speed_kmh double, votes long, fragments int"

    def row_of(key: tuple, m: dict) -> tuple:
        return (*key, m["event_id"], m["anchor"], m["last_t"], m["confidence"], m["speed_kmh"], m["votes"], m["fragments"])

    def fresh(row: object) -> dict:
        return {"event_id": row.event_id, "anchor": row.t, "last_t": row.t, "confidence": row.confidence, "speed_kmh": row.speed_kmh, "votes": row.votes, "fragments": 1}

    def step(key: tuple, state: dict, row: object) -> list:
        m = state["m"]
        if m is None or row.t - m["anchor"] > seconds:
            state["m"] = fresh(row)
            return [] if m is None else [row_of(key, m)]
        speed = m["speed_kmh"] if not pd.isna(m["speed_kmh"]) else row.speed_kmh
        m |= {"last_t": max(m["last_t"], row.t), "confidence": max(m["confidence"], row.confidence), "speed_kmh": speed, "votes": m["votes"] + row.votes, "fragments": m["fragments"] + 1}
        return []

    rows = obs.where("plate is not null").select("camera_id", "plate", "t", "event_id", "confidence", "speed_kmh", F.col("votes").cast("long").alias("votes"))
    return folded(rows, ["camera_id", "plate"], ["t", "event_id"], lambda _: {"m": None}, step, lambda key, s: [row_of(key, s["m"])], schema)


def rate_limited(hits: DataFrame, key: str, limit: int, window_s: float) -> DataFrame:
    """Each hit of a key with whether it is admitted: fewer than ``limit`` admitted ones lie within ``window_s`` before it."""

    def step(at: tuple, state: dict, row: object) -> list:
        state["live"] = [t for t in state["live"] if row.t - t <= window_s]
        allowed = len(state["live"]) < limit
        if allowed:
            state["live"].append(row.t)
        return [(*at, row.t, row.event_id, allowed)]

    schema = f"{key} {dict(hits.dtypes)[key]}, t double, event_id long, allowed boolean"
    return folded(hits.select(key, "t", "event_id"), [key], ["t", "event_id"], lambda _: {"live": []}, step, lambda *_: [], schema)


def ema(df: DataFrame, key: str, value: str, keep: float, chunk_s: float) -> DataFrame:
    """Last value of each key's exponential moving average (keep * before + (1 - keep) * new; the first value starts it).

    A stretch of n values turns e into keep ** n * e + s, with s from its own values alone. So stretches of ``chunk_s`` are
    summed in parallel, and only their (n, s) are put together in order.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("_chunk", F.floor(F.col("t") / chunk_s))
    inside = Window.partitionBy(key, "_chunk")
    rows = rows.withColumn("_i", F.row_number().over(inside.orderBy("t", "event_id"))).withColumn("_n", F.count("*").over(inside))
    firsts = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, F.struct("t", "event_id")).alias("_first"))
    parts = rows.groupBy(key, "_chunk").agg(F.count("*").alias("_n"), F.sum((1 - keep) * F.pow(F.lit(keep), F.col("_n") - F.col("_i")) * F.col(value)).alias("_s"))
    # Starting from the first value, averaging it in once more changes nothing.
    in_order = F.array_sort(F.collect_list(F.struct("_chunk", "_n", "_s")))
    return parts.groupBy(key).agg(in_order.alias("_parts")).join(firsts, key).select(key, F.aggregate("_parts", F.col("_first").cast("double"), lambda e, p: F.pow(F.lit(keep), p["_n"]) * e + p["_s"]).alias("ema"))


def trailing(df: DataFrame, keys: list[str], window_s: float, aggregates: dict[str, str], at: str = "t") -> DataFrame:
    """``df`` with aggregates (name to SQL) over the rows of its keys in the ``window_s`` before each row, itself included.

    Time is cut into spans of the window's length, and each row also goes to the span after its own, where it only serves
    the windows of others. So a hot key is spread over its spans, for twice the rows, and no task holds all its time.
    """
    width = float(window_s)
    span = F.floor(F.col("_at") / width)
    rows = df.withColumn("_at", F.expr(at).cast("double")).withColumn("_span", F.explode(F.array(span, span + 1)))
    over = f"(PARTITION BY {', '.join(keys)}, _span ORDER BY _at RANGE BETWEEN CAST({width} AS DOUBLE) PRECEDING AND CURRENT ROW)"
    found = rows.withColumns({name: F.expr(f"{sql} OVER {over}") for name, sql in aggregates.items()})
    return found.where(F.col("_span") == F.floor(F.col("_at") / width)).drop("_at", "_span")

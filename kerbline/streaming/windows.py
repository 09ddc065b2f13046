"""Windows and keyed state over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def buckets(events: DataFrame, width: str = "60 seconds", late: str = "2 seconds") -> DataFrame:
    """Sums of each camera's events in tumbling windows that close when the watermark passes their end; empty ones don't exist.

    Columns are sums and counts, not means, so that parts of one bucket can be put together by ``merged``.
    """
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "camera_id")
    sums = grouped.agg(F.count("*").alias("vehicles"), F.count("speed_kmh").alias("speeds"), F.sum("speed_kmh").alias("speed_sum"), F.max("k").alias("max_k"))
    return sums.select("camera_id", F.col("w.start").alias("bucket_start"), F.col("w.end").alias("bucket_end"), "vehicles", "speeds", "speed_sum", "max_k")


def merged(parts: DataFrame) -> DataFrame:
    """One row of each camera and bucket from its parts, with the mean speed by weight."""
    out = parts.groupBy("camera_id", "bucket_start").agg(*[F.sum(c).alias(c) for c in ("vehicles", "speeds", "speed_sum")], F.max("max_k").alias("max_k"))
    return out.withColumn("avg_speed_kmh", F.try_divide("speed_sum", "speeds"))


_STATE = "event_id long, anchor double, last_t double, confidence double, votes long, fragments int"
_OUT = "camera_id string, plate string, " + _STATE


def passages(events: DataFrame, seconds: float = 25, late: str = "2 seconds") -> DataFrame:
    """Sightings of one plate at one camera merged with the first within ``seconds`` of it, as a stream.

    State is one passage for each camera and plate. It is given out when a later sighting begins another one or when the
    watermark passes its end, and then dropped. A late sighting merges with the open passage if it is near enough, else
    it is a passage of its own.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        out = []
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
            for event_id, t, confidence, votes in zip(rows["event_id"], rows["t"], rows["confidence"], rows["votes"], strict=True):
                if now is not None and abs(t - now[1]) <= seconds:
                    now = [now[0], min(now[1], t), max(now[2], t), max(now[3], confidence), now[4] + votes, now[5] + 1]
                    continue
                fresh = [event_id, t, t, confidence, votes, 1]
                if now is not None and t < now[1]:
                    out.append(fresh)
                else:
                    out += [] if now is None else [now]
                    now = fresh
        ends = (now[1] + seconds) * 1000
        if state.hasTimedOut or ends <= state.getCurrentWatermarkMs():
            out.append(now)
            state.remove()
        else:
            state.update(tuple(now))
            state.setTimeoutTimestamp(int(ends) + 1)
        yield pd.DataFrame([(*key, *x) for x in out], columns=[c.split()[0] for c in _OUT.split(", ")])

    rows = events.where("plate is not null").withWatermark("ts", late).select("camera_id", "plate", "ts", F.expr("unix_micros(ts) / 1e6").alias("t"), "event_id", "confidence", F.col("votes").cast("long").alias("votes"))
    return rows.groupBy("camera_id", "plate").applyInPandasWithState(fold, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def marked_late(events: DataFrame, keys: list[str], late_s: float) -> DataFrame:
    """``events`` (t in seconds, no column named late) with ``late``: whether an event is more than ``late_s`` behind the newest one of its keys in earlier batches.

    Spark drops rows behind a watermark; here they are told apart, so that a sink can keep them. State is one time for each key.
    """
    names = events.columns

    def mark(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = newest = state.get[0] if state.exists else float("-inf")
        for rows in batches:
            newest = max(newest, rows["t"].max())
            yield rows[names].assign(late=rows["t"] < before - late_s)
        state.update((float(newest),))

    schema = ", ".join(f"`{c}` {t}" for c, t in events.dtypes) + ", late boolean"
    return events.groupBy(*keys).applyInPandasWithState(mark, schema, "newest double", "append", GroupStateTimeout.NoTimeout)


def latest(events: DataFrame, fresh: str = "30 seconds") -> DataFrame:
    """The newest status of each camera, for update mode; the reader drops those older than ``fresh`` by its clock."""
    newest = events.groupBy("camera_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))
    return newest.withColumn("fresh_until", F.col("ts") + F.expr(f"interval {fresh}"))

"""Sensor health: windows over samples, counters, penalties and grades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.operators.folds import folded, trailing
from kerbline.operators.quantiles import medians
from kerbline.operators.stretches import numbered, previous

#: The level that a status is logged with (others INFO), and the most characters of a message.
LEVELS, MOST_MESSAGE = {"DEGRADED": "WARNING", "OFFLINE": "ERROR", "ERROR": "ERROR"}, 2000


def fps(frames: DataFrame, window_s: int = 5) -> DataFrame:
    """Frames a second over the trailing window: its frames but the first by its span."""
    found = trailing(frames, ["camera_id"], window_s, {"_n": "count(*)", "_first": "min(t)"})
    span = F.col("t") - F.col("_first")
    return found.withColumn("fps", F.when(span > 0, F.round((F.col("_n") - 1) / span, 4)).otherwise(0.0)).drop("_n", "_first")


def counter_deltas(samples: DataFrame, counter: str) -> DataFrame:
    """Growth of a cumulative counter since the sample before; a fall means that it began anew."""
    before, now = F.col(f"before_{counter}"), F.col(counter)
    found = previous(samples, ["camera_id"], [counter])
    return found.withColumn(f"{counter}_delta", F.when(before.isNull() | (now < before), now).otherwise(now - before)).drop(f"before_{counter}")


def split_halves(samples: DataFrame, column: str, least: int = 4) -> DataFrame:
    """Medians of the first and the second half of each camera's known values in time; the middle one of an odd number is in the second."""
    rows = numbered(samples.where(F.col(column).isNotNull()).select("camera_id", "t", "event_id", column), ["camera_id"]).where(F.col("n") >= least)
    halves = medians(rows.withColumn("half", F.when(F.col("i") <= F.floor(F.col("n") / 2), "early").otherwise("late")), ["camera_id", "half"], column)
    return halves.groupBy("camera_id").agg(*[F.max(F.when(F.col("half") == half, F.col("median"))).alias(half) for half in ("early", "late")])


def tail_median(samples: DataFrame, column: str, last: int = 4) -> DataFrame:
    order = Window.partitionBy("camera_id").orderBy(F.desc("t"), F.desc("event_id"))
    return samples.where(F.col(column).isNotNull()).withColumn("i", F.row_number().over(order)).where(F.col("i") <= last).groupBy("camera_id").agg(F.median(column).alias("tail"))


def trend(samples: DataFrame, last: int = 240) -> DataFrame:
    order = Window.partitionBy("camera_id").orderBy(F.desc("t"), F.desc("event_id"))
    return samples.withColumn("i", F.row_number().over(order)).where(F.col("i") <= last).drop("i")


def report(samples: DataFrame, cameras: DataFrame, now: float, window_s: float = 3600) -> DataFrame:
    """Score from 100 down, grade and the penalty of each factor, for each camera with samples in the window or now offline.

    ``cameras``: camera_id, target_fps, current_status (null where unknown). Penalties: availability under 99 %, 3 for each
    reconnect up to 15, processing under 70 % of its target, input under 5 fps, sharpness halved, darkness, few plates
    read, low OCR confidence, frames dropped at last, being offline.
    """
    rows = samples.where((F.col("t") >= now - window_s) & (F.col("t") <= now))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    read = F.when(F.col("avg_ocr_confidence").isNotNull() & (F.col("plates_read") > 0), F.col("plates_read"))
    last = F.struct("t", "event_id")
    base = rows.groupBy("camera_id").agg(
        F.count("*").alias("samples"), F.avg(F.when(F.col("status").isin("ONLINE", "DEGRADED"), 1.0).otherwise(0.0)).alias("up"), (F.max("reconnects") - F.min("reconnects")).alias("reconnects"),
        F.median(positive("processing_fps")).alias("processing"), F.median(positive("input_fps")).alias("input"), F.sum("vehicles_detected").alias("vehicles"), F.sum("plates_read").alias("plates"),
        F.try_divide(F.sum(F.col("avg_ocr_confidence") * read), F.sum(read)).alias("ocr"), F.max_by("frames_dropped", last).alias("dropped"), F.max_by("frames_processed", last).alias("processed"),
    )
    out = cameras.join(base, "camera_id", "left").join(split_halves(rows, "blur_score"), "camera_id", "left").join(tail_median(rows, "brightness"), "camera_id", "left")
    rate = F.try_divide(F.col("plates"), F.col("vehicles"))
    penalty = {
        "availability": F.when(F.col("up") < 0.99, (1 - F.col("up")) * 40),
        "reconnects": F.when(F.col("reconnects") > 0, F.least(F.lit(15), F.col("reconnects") * 3)),
        "processing_fps": F.when((F.col("target_fps") > 0) & (F.col("processing") < 0.7 * F.col("target_fps")), 10),
        "input_fps": F.when(F.col("input") < 5, 8),
        "sharpness": F.when((F.col("early") > 0) & (F.col("late") < 0.5 * F.col("early")), 15),
        "brightness": F.when(F.col("tail") < 40, 10),
        "plate_read_rate": F.when((F.col("vehicles") >= 10) & (rate < 0.4), 15 * (1 - rate / 0.4)),
        "ocr_confidence": F.when(F.col("ocr") < 0.7, (0.7 - F.col("ocr")) * 40),
        "frame_drops": F.when((F.col("dropped") > 0) & (F.col("processed") > 0) & (F.col("dropped") / F.greatest(F.col("processed"), F.lit(1)) > 0.5), 5),
        "current_status": F.when(F.col("current_status").isin("OFFLINE", "ERROR"), 30),
    }
    out = out.withColumns({f"p_{k}": F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in penalty.items()})
    score = F.greatest(F.lit(0.0), 100 - sum((F.col(f"p_{k}") for k in penalty), F.lit(0.0)))
    seen = F.col("samples").isNotNull() | F.col("current_status").isNotNull()
    out = out.withColumn("raw", F.when(seen, score))
    grade = F.when(F.col("raw").isNull(), "NO_DATA").when(F.col("raw") >= 85, "GOOD").when(F.col("raw") >= 60, "FAIR").otherwise("POOR")
    return out.select("camera_id", F.coalesce("samples", F.lit(0)).alias("samples"), F.round("raw", 1).alias("score"), grade.alias("grade"), *[F.round(f"p_{k}", 1).alias(f"p_{k}") for k in penalty])


def status_log(events: DataFrame) -> DataFrame:
    """Log rows of status events (event_id, t, camera_id, old_status, status, message, intentional): level and message.

    Intentional changes are only information, and ``alerts`` says that others go to the alert rules.
    """
    known = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    meant = F.coalesce("intentional", F.lit(False))
    level = F.when(meant, "INFO").otherwise(F.coalesce(F.element_at(known, F.col("status")), F.lit("INFO")))
    text = F.substring(F.concat(F.coalesce("old_status", F.lit("-")), F.lit(" to "), "status", F.lit(": "), F.coalesce("message", F.lit(""))), 1, MOST_MESSAGE)
    return events.select("event_id", "t", "camera_id", level.alias("level"), text.alias("message"), (~meant).alias("alerts"))


def camera_states(events: DataFrame, cameras: DataFrame) -> DataFrame:
    """``cameras`` (camera_id) with status, message and the last time online from their status events; null without any."""
    last = F.struct("t", "event_id")
    newest = events.groupBy("camera_id").agg(F.max_by("status", last).alias("status"), F.substring(F.max_by(F.coalesce("message", F.lit("")), last), 1, MOST_MESSAGE).alias("status_message"), F.max(F.when(F.col("status") == "ONLINE", F.col("t"))).alias("last_seen_s"))
    return cameras.select("camera_id").join(newest, "camera_id", "left")


def sampled(counters: DataFrame, every_s: float = 15) -> DataFrame:
    """Samples of cameras' cumulative counters (vehicles, plates, ocr_sum, ocr_reads) at least ``every_s`` apart, as growth since the last.

    The first reading is a sample; the mean OCR confidence is that of the reads since. A counter that fell began anew.
    """
    names = ("vehicles", "plates", "ocr_sum", "ocr_reads")

    def step(key: tuple, state: dict, row: object) -> list:
        if state["t"] is not None and row.t - state["t"] < every_s:
            return []
        now = [getattr(row, x) for x in names]
        grown = [x - y if x >= y else x for x, y in zip(now, state["was"], strict=True)]
        state |= {"t": row.t, "was": now}
        return [(*key, row.event_id, row.t, int(grown[0]), int(grown[1]), grown[2] / grown[3] if grown[3] else None, int(grown[3]))]

    schema = "camera_id string, event_id long, t double, vehicles_detected long, plates_read long, avg_ocr_confidence double, ocr_reads long"
    rows = counters.select("camera_id", "t", "event_id", *names)
    return folded(rows, ["camera_id"], ["t", "event_id"], lambda _: {"t": None, "was": [0] * len(names)}, step, lambda *_: [], schema).withColumn("avg_ocr_confidence", F.round("avg_ocr_confidence", 4))

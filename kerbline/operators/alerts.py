"""Alert rules as plans, and the life of alerts as a fold over the raises and recoveries of each key."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.operators import anchors
from kerbline.operators.folds import trailing
from kerbline.operators.stretches import previous
from kerbline.sources.lineage import cut

log = logging.getLogger(__name__)
RULES_AT_A_TIME = 5

#: Severity and cooldown of each rule.
RULES = {
    "WATCHLIST_MATCH": ("MEDIUM", 120), "REPEATED_SIGHTING": ("LOW", 1800), "IMPOSSIBLE_TRAVEL": ("HIGH", 600), "WRONG_WAY": ("HIGH", 60), "SEVERE_CONGESTION": ("MEDIUM", 900),
    "CAMERA_OFFLINE": ("HIGH", 300), "CAMERA_DEGRADED": ("LOW", 900), "OCR_DEGRADATION": ("MEDIUM", 3600), "TRAFFIC_SURGE": ("MEDIUM", 900), "TRAVEL_TIME_ANOMALY": ("MEDIUM", 900),
}


#: Severities that an entry of a watchlist can give its alerts by its priority; others are the rule's own.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def raised(df: DataFrame, rule: str, key: Column, t: Column, camera: Column, action: Column | None = None, severity: Column | None = None) -> DataFrame:
    """Rows of a rule in the common form: type, severity, dedup_key, t, camera_id, action (raise or resolve).

    The severity is the rule's, unless ``severity`` has one of ``SEVERITIES`` for a row.
    """
    own = F.lit(RULES[rule][0])
    own = own if severity is None else F.when(severity.isin(*SEVERITIES), severity).otherwise(own)
    return df.select(F.lit(rule).alias("type"), own.alias("severity"), F.lit(float(RULES[rule][1])).alias("cooldown_s"), F.concat(F.lit(rule + ":"), key).alias("dedup_key"), t.cast("double").alias("t"), camera.alias("camera_id"), (F.lit("raise") if action is None else action).alias("action"))


def all_rules(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def isolated(rules: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """Rows of all rules, each run by itself, and what went wrong by rule: one that fails takes no other with it.

    A rule's rows are written to the shared folder as they are worked out, since only then does a failure show. Some rules run
    at a time, so that the small ones don't leave the cluster idle one after another.
    """
    made, failed = [], {}
    with ThreadPoolExecutor(RULES_AT_A_TIME) as pool:
        running = {name: pool.submit(lambda rule=rule: cut(rule())) for name, rule in rules.items()}
    for name, result in running.items():
        try:
            made.append(result.result())
        except Exception as error:  # whatever a rule may do
            log.exception("alert rule %s failed", name)
            failed[name] = f"{type(error).__name__}: {error}"[:2000]
    return (all_rules(*made) if made else None), failed


def wrong_way(obs: DataFrame, cameras: DataFrame, min_frames: int = 4) -> DataFrame:
    """Tracks against the flow of a one-way road, of enough frames or of an unknown number."""
    one_way = cameras.where("one_way").select("camera_id")
    return obs.where((F.col("motion") == "against_flow") & (F.col("frames").isNull() | (F.col("frames") >= min_frames))).join(one_way, "camera_id", "left_semi")


def impossible_travel(obs: DataFrame, paths: DataFrame, max_ratio: float = 0.6, min_confidence: float = 0.75) -> DataFrame:
    """A plate read at two cameras faster than the road between allows, both reads being confident."""
    by = Window.partitionBy("plate").orderBy("t", "event_id")
    pairs = obs.where("plate is not null").withColumn("from_id", F.lag("camera_id").over(by)).withColumn("dt_s", F.col("t") - F.lag("t").over(by)).withColumn("before", F.lag("confidence").over(by))
    pairs = pairs.where((F.col("from_id") != F.col("camera_id")) & (F.least("before", "confidence") >= min_confidence))
    out = pairs.join(paths.select("from_id", F.col("to_id").alias("camera_id"), "min_travel_s"), ["from_id", "camera_id"])
    return out.withColumn("ratio", F.try_divide(F.col("dt_s"), F.col("min_travel_s"))).where(F.col("ratio") <= max_ratio)


def repeated_counts(obs: DataFrame, key: list[str], window_s: int = 1800) -> DataFrame:
    """Sightings of the key in the trailing window, each itself included."""
    return trailing(obs, key, window_s, {"recent": "count(*)"}, "cast(floor(t) as double)")


def repeated_sightings(obs: DataFrame, key: list[str], window_s: float = 1800, least: int = 3, apart_s: float = 60) -> DataFrame:
    """Sightings with which a key has ``least`` passages, ``apart_s`` apart, in the trailing window; passages is their number."""
    return anchors.passages_in_window(obs, key, window_s, apart_s).where(F.col("passages") >= least)


def status_changes(events: DataFrame) -> DataFrame:
    """Raises and recoveries of offline cameras: each status with the one before; only changes count."""
    changed = previous(events, ["camera_id"], ["status"]).withColumnRenamed("before_status", "before").where("before is null or before <> status")
    action = F.when(F.col("status").isin("OFFLINE", "ERROR"), "raise").when(F.col("status") == "ONLINE", "resolve")
    return changed.withColumn("action", action).where("action is not null")


def last_status(events: DataFrame) -> DataFrame:
    """The latest status of each camera."""
    return events.groupBy("camera_id").agg(F.max_by("status", F.struct("t", "event_id")).alias("status"), F.max("t").alias("since_s"))


def degraded(events: DataFrame, now: float, min_duration_s: float = 30) -> DataFrame:
    return last_status(events).where((F.col("status") == "DEGRADED") & (now - F.col("since_s") >= min_duration_s))


def congestion_actions(scores: DataFrame, raise_at: float = 75, resolve_below: float = 55) -> DataFrame:
    """Raise from one score on, recover below a lower one: between them nothing changes."""
    return scores.withColumn("action", F.when(F.col("score") >= raise_at, "raise").when(F.col("score") < resolve_below, "resolve")).where("action is not null")


def ocr_drop(reads: DataFrame, now: float, recent_s: float = 600, window_s: float = 3600, least: int = 8, drop: float = 0.2) -> DataFrame:
    """Cameras' mean confidence in two adjoining windows, in one pass: raise at a drop, recover at less than half of it."""
    rows = reads.where((F.col("t") >= now - window_s) & (F.col("t") < now))
    recent = F.col("t") >= now - recent_s
    out = rows.groupBy("camera_id").agg(
        F.count(F.when(recent, 1)).alias("recent_reads"), F.count(F.when(~recent, 1)).alias("baseline_reads"), F.avg(F.when(recent, F.col("confidence"))).alias("r"), F.avg(F.when(~recent, F.col("confidence"))).alias("b")
    ).where((F.col("recent_reads") >= least) & (F.col("baseline_reads") >= least) & (F.col("b") > 0))
    out = out.withColumn("d", (F.col("b") - F.col("r")) / F.col("b"))
    action = F.when(F.col("d") >= drop, "raise").when(F.col("d") < drop / 2, "resolve")
    return out.select("camera_id", "recent_reads", "baseline_reads", F.round("r", 4).alias("recent_mean"), F.round("b", 4).alias("baseline_mean"), F.round("d", 3).alias("drop"), action.alias("action"))


def surge(metrics: DataFrame, now: float, window_s: float = 300, baseline_s: float = 21_600, least: int = 8, ratio: float = 1.8) -> DataFrame:
    """Cameras whose rate in the window is so many times that of the baseline."""
    rows = metrics.where((F.col("start_s") >= now - baseline_s) & (F.col("start_s") < now))
    recent = F.col("start_s") >= now - window_s
    total = lambda w, c: F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0))
    out = rows.groupBy("camera_id").agg(total(recent, "new_tracks").alias("n"), total(recent, "bucket_seconds").alias("n_s"), total(~recent, "new_tracks").alias("b"), total(~recent, "bucket_seconds").alias("b_s"))
    out = out.where((F.col("n") >= least) & (F.col("b_s") >= 2 * window_s) & (F.col("b") > 0) & (F.col("n_s") > 0))
    now_rate, usual = F.col("n") / F.col("n_s") * 60, F.col("b") / F.col("b_s") * 60
    return out.select("camera_id", F.round(now_rate, 2).alias("current_rate"), F.round(usual, 2).alias("baseline_rate"), F.round(now_rate / usual, 2).alias("ratio"), (now_rate / usual >= ratio).alias("surge"))


ALERT_SCHEMA = "dedup_key string, type string, severity string, camera_id string, n long, status string, created_s double, updated_s double, resolved_s double, occurrences long, reopened long"


def lifecycle(actions: DataFrame) -> DataFrame:
    """Alerts of each dedup_key from its raises and recoveries in time.

    A raise while an alert is open and was updated within the cooldown counts as another occurrence; one within the
    cooldown of an automatic recovery opens that alert again; any other makes a new one. A recovery resolves all open
    alerts of the key. Spark sorts the actions of each key together, and a task folds them as they stream by.

    Only the newest alert of a key can be touched by a raise, since those before it are updated and resolved no later. So
    it alone is held; one that is still open when the next is made will be resolved by the key's next recovery, whose time
    each action brings along.
    """
    names = [x.split()[0] for x in ALERT_SCHEMA.split(", ")]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, None
        for batch in batches:
            done: list[dict] = []
            for r in batch.itertuples():
                if r.dedup_key != key:
                    done += [now] if now else []
                    key, now = r.dedup_key, None
                if r.action == "resolve":
                    if now and now["status"] != "RESOLVED":
                        now |= {"status": "RESOLVED", "resolved_s": r.t}
                    continue
                open_, since = now and now["status"] != "RESOLVED", r.t - r.cooldown_s
                if now and now["updated_s" if open_ else "resolved_s"] >= since:
                    now |= {"status": "NEW", "resolved_s": None, "updated_s": r.t, "occurrences": now["occurrences"] + 1, "reopened": now["reopened"] + (not open_)}
                    continue
                if now:
                    if open_ and not pd.isna(r.recovery_s):
                        now |= {"status": "RESOLVED", "resolved_s": r.recovery_s}
                    done.append(now)
                now = {"dedup_key": key, "type": r.type, "severity": r.severity, "camera_id": r.camera_id, "n": now["n"] + 1 if now else 1, "status": "NEW", "created_s": r.t, "updated_s": r.t, "resolved_s": None, "occurrences": 1, "reopened": 0}
            yield pd.DataFrame(done, columns=names)
        yield pd.DataFrame([now] if now else [], columns=names)

    rows = actions.select("dedup_key", "type", "severity", "cooldown_s", "camera_id", "t", "action")
    # Read backwards, the last recovery so far is the next one.
    later = Window.partitionBy("dedup_key").orderBy(F.desc("t"), F.desc("action")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("recovery_s", F.min(F.when(F.col("action") == "resolve", F.col("t"))).over(later))
    # The window has brought each key's rows into one partition.
    return rows.sortWithinPartitions("dedup_key", "t", "action").mapInPandas(task, ALERT_SCHEMA)


def transitioned(status: Column, action: Column) -> Column:
    """The status after an operator's action; null if the action is not allowed from it."""
    return F.when((action == "acknowledge") & (status == "NEW"), "ACKNOWLEDGED").when((action == "resolve") & (status != "RESOLVED"), "RESOLVED").when((action == "reopen") & (status == "RESOLVED"), "NEW")


def coded(alerts: DataFrame) -> DataFrame:
    """Alerts with codes ALR-yyyymmdd-000001, counted within each day by time and key."""
    day = F.date_format(F.timestamp_seconds(F.floor("created_s")), "yyyyMMdd")
    order = Window.partitionBy("day").orderBy("created_s", "dedup_key", "n")
    return alerts.withColumn("day", day).withColumn("code", F.format_string("ALR-%s-%06d", F.col("day"), F.row_number().over(order))).drop("day")

"""Queries on alert rules and ordered folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import plates
from kerbline.operators import alerts, anchors, folds, search
from kerbline.plans.registry import SQL, query
from kerbline.plans.traffic import _BASELINE, _CONGESTION, _RATIOS, _WINDOW, _ratios
from kerbline.sources import tables as T


@query(T.with_("obs", "cameras") + "SELECT event_id, camera_id FROM obs JOIN cameras USING (camera_id) WHERE k % 7 = 0 AND one_way AND (k < 50 OR k >= 54)")
def rl_wrong_way(spark, sf_dir):
    obs = T.observations(spark, sf_dir).withColumn("motion", F.when(F.col("k") % 7 == 0, "against_flow").otherwise("with_flow")).withColumn("frames", F.when(F.col("k") >= 50, F.col("k") - 50))
    return alerts.wrong_way(obs, T.cameras(spark)).select("event_id", "camera_id")


@query(T.with_("obs", "edges", "paths") + """, d AS (SELECT *, lag(camera_id) OVER w AS from_id, t - lag(t) OVER w AS dt_s, lag(confidence) OVER w AS before FROM obs WHERE plate IS NOT NULL WINDOW w AS (PARTITION BY plate ORDER BY t, event_id))
SELECT event_id, d.from_id, round(dt_s / (min_travel_s * 100), 4) AS ratio FROM d JOIN paths p ON p.from_id = d.from_id AND p.to_id = d.camera_id WHERE d.from_id <> camera_id AND least(before, confidence) >= 0.75 AND dt_s / (min_travel_s * 100) <= 0.6""")
def rl_impossible(spark, sf_dir):
    slow = T.paths(spark).withColumn("min_travel_s", F.col("min_travel_s") * 100)
    return alerts.impossible_travel(T.observations(spark, sf_dir), slow).select("event_id", "from_id", F.round("ratio", 4).alias("ratio"))


@query(T.with_("obs") + """SELECT event_id, count(*) OVER (PARTITION BY camera_id, vehicle_id ORDER BY CAST(floor(t) AS BIGINT) RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW) AS recent FROM obs""")
def win_rolling_count(spark, sf_dir):
    return alerts.repeated_counts(T.observations(spark, sf_dir), ["camera_id", "vehicle_id"], 172_800).select("event_id", "recent")


@query(T.with_("obs") + """, seen AS (SELECT event_id, list(t) OVER (PARTITION BY camera_id, vehicle_id ORDER BY t RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW) AS times FROM obs),
counted AS (SELECT event_id, list_reduce(list_transform(list_sort(times), lambda x: {'last': x, 'n': 1}), lambda a, x: CASE WHEN x.last - a.last >= 21600 THEN {'last': x.last, 'n': a.n + 1} ELSE a END).n AS passages FROM seen)
SELECT * FROM counted WHERE passages >= 3""")
def rl_repeated(spark, sf_dir):
    return alerts.repeated_sightings(T.observations(spark, sf_dir), ["camera_id", "vehicle_id"], 172_800, 3, 21_600).select("event_id", "passages")


_STATUS = "CASE WHEN k % 11 < 2 THEN 'OFFLINE' WHEN k % 11 < 4 THEN 'DEGRADED' ELSE 'ONLINE' END"


def _status(spark, sf_dir):
    k = F.col("k") % 11
    return T.observations(spark, sf_dir).withColumn("status", F.when(k < 2, "OFFLINE").when(k < 4, "DEGRADED").otherwise("ONLINE"))


@query(T.with_("obs") + f"SELECT event_id, action FROM (SELECT *, CASE WHEN status = 'OFFLINE' THEN 'raise' WHEN status = 'ONLINE' THEN 'resolve' END AS action FROM (SELECT *, {_STATUS} AS status, lag({_STATUS}) OVER (PARTITION BY camera_id ORDER BY t, event_id) AS before FROM obs) WHERE before IS NULL OR before <> status) WHERE action IS NOT NULL")
def rl_offline(spark, sf_dir):
    return alerts.status_changes(_status(spark, sf_dir)).select("event_id", "action")


@query(T.with_("obs") + f"SELECT camera_id, arg_max({_STATUS}, {{t: t, e: event_id}}) AS status, max(t) AS since_s FROM obs GROUP BY camera_id")
def win_last_status(spark, sf_dir):
    return alerts.last_status(_status(spark, sf_dir))


@query(T.with_("obs") + f"SELECT * FROM (SELECT camera_id, arg_max({_STATUS}, {{t: t, e: event_id}}) AS status, max(t) AS since_s FROM obs GROUP BY camera_id) WHERE status = 'DEGRADED' AND {T.NOW + 86400} - since_s >= 30")
def rl_degraded(spark, sf_dir):
    return alerts.degraded(_status(spark, sf_dir), T.NOW + 86_400)


@query(T.with_("obs", "edges", "points", "metrics") + ", " + _RATIOS + ", " + _CONGESTION + " SELECT camera_id, round(score, 1) AS score, CASE WHEN round(score, 1) >= 60 THEN 'raise' ELSE 'resolve' END AS action FROM scored WHERE round(score, 1) >= 60 OR round(score, 1) < 55")
def rl_congestion(spark, sf_dir):
    from kerbline.operators import congestion

    found = congestion.congestion(T.hourly(spark, sf_dir), _ratios(spark, sf_dir), T.NOW, _WINDOW, _BASELINE)
    return alerts.congestion_actions(found, 60, 55).select("camera_id", "score", "action")


_OCR = f"""SELECT camera_id, count(*) FILTER (WHERE t >= {T.NOW - 86400}) AS recent_reads, count(*) FILTER (WHERE t < {T.NOW - 86400}) AS baseline_reads, avg(confidence) FILTER (WHERE t >= {T.NOW - 86400}) AS r, avg(confidence) FILTER (WHERE t < {T.NOW - 86400}) AS b
  FROM obs WHERE t >= {T.NOW - 10 * 86400} AND t < {T.NOW} GROUP BY camera_id"""


@query(T.with_("obs") + f", s AS ({_OCR}) SELECT camera_id, recent_reads, baseline_reads, round(r, 4) AS recent_mean, round(b, 4) AS baseline_mean, round((b - r) / b, 3) AS drop, CASE WHEN (b - r) / b >= 0.02 THEN 'raise' WHEN (b - r) / b < 0.01 THEN 'resolve' END AS action FROM s WHERE recent_reads >= 8 AND baseline_reads >= 8 AND b > 0")
def rl_ocr(spark, sf_dir):
    return alerts.ocr_drop(T.observations(spark, sf_dir), T.NOW, 86_400, 10 * 86_400, 8, 0.02)


@query(T.with_("obs") + f", s AS ({_OCR}) SELECT camera_id, recent_reads, baseline_reads, round(r, 6) AS recent_mean, round(b, 6) AS baseline_mean FROM s")
def agg_ocr_stats(spark, sf_dir):
    rows = T.observations(spark, sf_dir).where((F.col("t") >= T.NOW - 10 * 86_400) & (F.col("t") < T.NOW))
    recent, read = F.col("t") >= T.NOW - 86_400, F.col("confidence")
    return rows.groupBy("camera_id").agg(F.count(F.when(recent, 1)).alias("recent_reads"), F.count(F.when(~recent, 1)).alias("baseline_reads"), F.round(F.avg(F.when(recent, read)), 6).alias("recent_mean"), F.round(F.avg(F.when(~recent, read)), 6).alias("baseline_mean"))


@query(T.with_("obs", "metrics") + f""", s AS (SELECT camera_id, sum(new_tracks) FILTER (WHERE start_s >= {T.NOW - 86400}) AS n, sum(bucket_seconds) FILTER (WHERE start_s >= {T.NOW - 86400}) AS n_s, sum(new_tracks) FILTER (WHERE start_s < {T.NOW - 86400}) AS b, sum(bucket_seconds) FILTER (WHERE start_s < {T.NOW - 86400}) AS b_s
  FROM metrics WHERE start_s >= {T.NOW - _BASELINE} AND start_s < {T.NOW} GROUP BY camera_id)
SELECT camera_id, round(n / n_s::DOUBLE * 60, 2) AS current_rate, round(b / b_s::DOUBLE * 60, 2) AS baseline_rate, round((n / n_s::DOUBLE * 60) / (b / b_s::DOUBLE * 60), 2) AS ratio, (n / n_s::DOUBLE * 60) / (b / b_s::DOUBLE * 60) >= 1.02 AS surge FROM s WHERE n >= 8 AND b_s >= 172800 AND b > 0 AND n_s > 0""")
def rl_surge(spark, sf_dir):
    return alerts.surge(T.hourly(spark, sf_dir), T.NOW, 86_400, _BASELINE, 8, 1.02)


ENTRIES = [(1, "UP32AB0017", "exact", "HIGH", True, None), (2, "UP32AB0OO8", "fuzzy", "CRITICAL", True, None), (3, "UP32A80101", "fuzzy", "LOW", True, T.NOW + 1), (4, "UP32AB0042", "exact", "LOW", False, None), (5, "UP32AB0043", "exact", "LOW", True, T.NOW - 1)]
_ENTRIES_SQL = "entries(entry_id, plate, match_mode, priority, active, expires_s) AS (VALUES " + ", ".join(f"({i}, '{p}', '{m}', '{r}', {str(a).lower()}, {'NULL' if x is None else x}::DOUBLE)" for i, p, m, r, a, x in ENTRIES) + ")"


def entries(spark):
    return spark.createDataFrame(ENTRIES, "entry_id int, plate string, match_mode string, priority string, active boolean, expires_s double")


@query(f"""SELECT c_custkey AS entry_id FROM customer WHERE c_mktsegment <> 'BUILDING' AND (c_custkey % 3 = 0 OR {T.NOW}::DOUBLE + c_acctbal::DOUBLE > {T.NOW}::DOUBLE)""")
def flt_watchlist_active(spark, sf_dir):
    """Customers as entries: those of one segment are switched off, and two in three expire by their balance."""
    listed = T.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry_id"), (F.col("c_mktsegment") != "BUILDING").alias("active"), F.when(F.col("c_custkey") % 3 != 0, T.NOW + F.col("c_acctbal").cast("double")).alias("expires_s"))
    return search.active_entries(listed, T.NOW).select("entry_id")


#: Plates are as long as the listed ones, and an insertion costs 1: within 0.8 only swaps of confusable characters are left.
_NEAR_SQL = f"""{_ENTRIES_SQL}, listed AS (SELECT * FROM entries WHERE active AND (expires_s IS NULL OR expires_s > {T.NOW})), plates AS (SELECT DISTINCT plate FROM obs WHERE plate IS NOT NULL),
near AS (SELECT entry_id, plate, round(d, 2) AS distance FROM (SELECT l.entry_id, l.match_mode, p.plate,
    list_sum(list_transform(range(1, 11), lambda i: CASE WHEN l.plate[i] = p.plate[i] THEN 0 WHEN list_contains({sorted(plates.CONFUSABLE)}, l.plate[i] || p.plate[i]) OR list_contains({sorted(plates.CONFUSABLE)}, p.plate[i] || l.plate[i]) THEN 0.35 ELSE 1 END))::DOUBLE AS d
  FROM listed l, plates p) WHERE d = 0 OR match_mode = 'fuzzy' AND d <= 0.8)"""


@query(T.with_("obs") + f""", {_NEAR_SQL}
SELECT event_id, entry_id, distance FROM obs JOIN near USING (plate)""")
def jn_watchlist(spark, sf_dir):
    return search.watchlist_matches(T.observations(spark, sf_dir), search.active_entries(entries(spark), T.NOW), 0.8).select("event_id", "entry_id", "distance")


@query(T.with_("obs") + f""", {_NEAR_SQL}
SELECT event_id, entry_id FROM obs JOIN near USING (plate) WHERE t >= {T.NOW - 20 * 86400} QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY t DESC, event_id DESC) <= 10""")
def jn_retrospective(spark, sf_dir):
    return search.retrospective(T.observations(spark, sf_dir), search.active_entries(entries(spark), T.NOW), T.NOW - 20 * 86_400, 0.8, 10).select("event_id", "entry_id")


def _rules(spark, sf_dir):
    """All rules by name, with the limits that their own queries have here."""
    from kerbline.operators import congestion, travel

    obs, status = T.observations(spark, sf_dir), _status(spark, sf_dir)
    camera, t, now = F.col("camera_id"), F.col("t"), F.lit(T.NOW)
    whole = lambda name, df, key, at=t, where=camera, action=None, severity=None: alerts.raised(df, name, key, at, where, action, severity)

    def segments():
        points = T.trajectory(spark, sf_dir)
        base = travel.baselines(points, T.edges(spark), T.NOW, _BASELINE, _WINDOW)
        recent = travel.segment_medians(travel.segment_samples(points, T.NOW - _WINDOW, T.NOW)).where("samples >= 2").join(base.select("from_id", "to_id", "seconds"), ["from_id", "to_id"])
        ratio = F.col("median_s") / F.greatest("seconds", F.lit(1.0))
        return recent.withColumn("action", F.when(ratio >= 1.1, "raise").when(ratio < 1.0, "resolve")).where("action is not null")

    def impossible():
        slow = T.paths(spark).withColumn("min_travel_s", F.col("min_travel_s") * 100)
        return alerts.impossible_travel(obs, slow)

    moving = obs.withColumn("motion", F.when(F.col("k") % 7 == 0, "against_flow").otherwise("with_flow")).withColumn("frames", F.when(F.col("k") >= 50, F.col("k") - 50))
    return {
        "CAMERA_OFFLINE": lambda: whole("CAMERA_OFFLINE", alerts.status_changes(status), camera, action=F.col("action")),
        "CAMERA_DEGRADED": lambda: whole("CAMERA_DEGRADED", alerts.degraded(status, T.NOW + 86_400), camera, F.col("since_s")),
        "WATCHLIST_MATCH": lambda: whole("WATCHLIST_MATCH", search.watchlist_matches(obs, search.active_entries(entries(spark), T.NOW), 0.8), F.concat_ws(":", "entry_id", "camera_id"), severity=F.col("priority")),
        "WRONG_WAY": lambda: whole("WRONG_WAY", alerts.wrong_way(moving, T.cameras(spark)), F.concat_ws(":", "camera_id", "vehicle_id")),
        "IMPOSSIBLE_TRAVEL": lambda: whole("IMPOSSIBLE_TRAVEL", impossible(), F.col("plate")),
        "REPEATED_SIGHTING": lambda: whole("REPEATED_SIGHTING", alerts.repeated_sightings(obs, ["camera_id", "vehicle_id"], 172_800, 3, 21_600), F.concat_ws(":", "camera_id", "vehicle_id")),
        "SEVERE_CONGESTION": lambda: whole("SEVERE_CONGESTION", alerts.congestion_actions(congestion.congestion(T.hourly(spark, sf_dir), _ratios(spark, sf_dir), T.NOW, _WINDOW, _BASELINE), 60, 55), camera, now, action=F.col("action")),
        "OCR_DEGRADATION": lambda: whole("OCR_DEGRADATION", alerts.ocr_drop(obs, T.NOW, 86_400, 10 * 86_400, 8, 0.02).where("action is not null"), camera, now, action=F.col("action")),
        "TRAFFIC_SURGE": lambda: whole("TRAFFIC_SURGE", alerts.surge(T.hourly(spark, sf_dir), T.NOW, 86_400, _BASELINE, 8, 1.02).where("surge"), camera, now),
        "TRAVEL_TIME_ANOMALY": lambda: whole("TRAVEL_TIME_ANOMALY", segments(), F.concat_ws(">", "from_id", "to_id"), now, F.col("to_id"), F.col("action")),
    }


def _actions(spark, sf_dir):
    """What the rules that work raise and resolve; those that fail are logged and left out."""
    return alerts.isolated(_rules(spark, sf_dir))[0]


@query()
def rl_engine(spark, sf_dir):
    return _actions(spark, sf_dir)


def _engine_sql() -> str:
    """Raises and recoveries of each rule, counted over the rules' own SQL."""
    from kerbline.plans import further  # noqa: F401  registers rl_travel

    of = {
        "CAMERA_OFFLINE": ("rl_offline", "action"), "CAMERA_DEGRADED": ("rl_degraded", "'raise'"), "WATCHLIST_MATCH": ("jn_watchlist", "'raise'"), "WRONG_WAY": ("rl_wrong_way", "'raise'"), "IMPOSSIBLE_TRAVEL": ("rl_impossible", "'raise'"),
        "REPEATED_SIGHTING": ("rl_repeated", "'raise'"), "SEVERE_CONGESTION": ("rl_congestion", "action"), "OCR_DEGRADATION": ("rl_ocr", "action"), "TRAFFIC_SURGE": ("rl_surge", "CASE WHEN surge THEN 'raise' END"), "TRAVEL_TIME_ANOMALY": ("rl_travel", "action"),
    }
    rules = " UNION ALL ".join(f"SELECT '{rule}' AS type, {action} AS action FROM ({SQL[name]})" for rule, (name, action) in of.items())
    return f"SELECT type, action, count(*) AS n FROM ({rules}) WHERE action IS NOT NULL GROUP BY type, action"


@query()
def al_raise(spark, sf_dir):
    """The life of the alerts of all ten rules."""
    return alerts.coded(alerts.lifecycle(_actions(spark, sf_dir)))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND s = 'NEW' THEN 'ACKNOWLEDGED' WHEN o_orderkey % 3 = 1 AND s <> 'RESOLVED' THEN 'RESOLVED' WHEN o_orderkey % 3 = 2 AND s = 'RESOLVED' THEN 'NEW' END AS status
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'NEW' WHEN 'P' THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END AS s FROM orders)""")
def al_transition(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "NEW").when(F.col("o_orderstatus") == "P", "ACKNOWLEDGED").otherwise("RESOLVED")
    action = F.element_at(F.array(F.lit("acknowledge"), F.lit("resolve"), F.lit("reopen")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return T.read(spark, sf_dir, "orders").select("o_orderkey", alerts.transitioned(status, action).alias("status"))


_PASSES = """WITH RECURSIVE ordered AS (SELECT camera_id, user_id AS vehicle_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS i FROM (SELECT *, event_type AS camera_id FROM events)),
walk AS (SELECT camera_id, vehicle_id, i, t AS anchor, 1 AS n FROM ordered WHERE i = 1
  UNION ALL SELECT o.camera_id, o.vehicle_id, o.i, CASE WHEN o.t - w.anchor {test} THEN o.t ELSE w.anchor END, w.n + CASE WHEN o.t - w.anchor {test} THEN 1 ELSE 0 END
  FROM walk w JOIN ordered o ON o.camera_id = w.camera_id AND o.vehicle_id = w.vehicle_id AND o.i = w.i + 1)
SELECT camera_id, vehicle_id, CAST(max(i) AS INTEGER) AS sightings, CAST(max(n) AS INTEGER) AS passages FROM walk GROUP BY ALL"""


@query(_PASSES.format(test=">= 86400"))
def win_min_separation(spark, sf_dir):
    return anchors.passages(T.observations(spark, sf_dir), ["camera_id", "vehicle_id"], 86_400)


@query(_PASSES.format(test="> 86400"))
def win_fragment(spark, sf_dir):
    """Fragments of a passage: what the merge makes of a vehicle's sightings at a camera within a day of the first."""
    obs = T.observations(spark, sf_dir).withColumn("plate", F.col("vehicle_id").cast("string")).withColumn("votes", F.col("k"))
    merged = anchors.merged_fragments(obs, 86_400)
    return merged.groupBy("camera_id", F.col("plate").cast("long").alias("vehicle_id")).agg(F.sum("fragments").cast("int").alias("sightings"), F.count("*").cast("int").alias("passages"))


@query("""WITH RECURSIVE ordered AS (SELECT event_type AS camera_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
walk AS (SELECT camera_id, i, value AS e FROM ordered WHERE i = 1 UNION ALL SELECT o.camera_id, o.i, 0.8::DOUBLE * w.e + 0.2::DOUBLE * o.value FROM walk w JOIN ordered o ON o.camera_id = w.camera_id AND o.i = w.i + 1)
SELECT camera_id, round(arg_max(e, i), 6) AS ema FROM walk GROUP BY camera_id""")
def win_ema(spark, sf_dir):
    return folds.ema(T.observations(spark, sf_dir), "camera_id", "speed_kmh", 0.8, 86_400).select("camera_id", F.round("ema", 6).alias("ema"))


@query("""WITH RECURSIVE ordered AS (SELECT user_id AS vehicle_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
walk AS (SELECT vehicle_id, i, event_id, t, true AS allowed, [t] AS live FROM ordered WHERE i = 1
  UNION ALL SELECT vehicle_id, i, event_id, t, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, t) ELSE kept END
  FROM (SELECT o.*, list_filter(w.live, lambda x: o.t - x <= 86400) AS kept FROM walk w JOIN ordered o ON o.vehicle_id = w.vehicle_id AND o.i = w.i + 1))
SELECT vehicle_id, t, event_id, allowed FROM walk""")
def rate_limit(spark, sf_dir):
    return folds.rate_limited(T.observations(spark, sf_dir), "vehicle_id", 3, 86_400)


@query(deferred=_engine_sql)
def rl_engine_counts(spark, sf_dir):
    return _actions(spark, sf_dir).groupBy("type", "action").agg(F.count("*").alias("n"))


def _severity_sql() -> str:
    """Severities of raises: the priority of a watchlist's entry, else that of the rule."""
    hits = f"SELECT 'WATCHLIST_MATCH' AS type, priority AS severity, 'raise' AS action, count(*) AS n FROM ({SQL['jn_watchlist']}) JOIN (WITH {_ENTRIES_SQL} SELECT entry_id, priority FROM entries) USING (entry_id) GROUP BY ALL"
    fixed = ", ".join(f"('{k}', '{v[0]}')" for k, v in alerts.RULES.items())
    return f"SELECT type, severity, action, n FROM ({_engine_sql()}) JOIN (VALUES {fixed}) v(type, severity) USING (type) WHERE type <> 'WATCHLIST_MATCH' UNION ALL {hits}"


@query(deferred=_severity_sql)
def rl_engine_severity(spark, sf_dir):
    return _actions(spark, sf_dir).groupBy("type", "severity", "action").agg(F.count("*").alias("n"))


#: Weighted edit distances of the pairs of ``asked`` (a, b), a row of the table of costs at a step. A run of insertions ends
#: at j from the best m before it: j + min(c[m] - m).
DISTANCES_SQL = f"""costs AS (
  SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda j: j::DOUBLE) AS r FROM asked
  UNION ALL SELECT a, b, i + 1, list_transform(range(1, len(c) + 1), lambda j: list_min(list_transform(range(1, j + 1), lambda m: c[m] - m)) + j) FROM (
    SELECT a, b, i, list_prepend((i + 1)::DOUBLE, list_transform(range(1, length(b) + 1), lambda j: least(r[j + 1] + 1, r[j] + CASE WHEN a[i + 1] = b[j] THEN 0
      WHEN list_contains({sorted(plates.CONFUSABLE)}, a[i + 1] || b[j]) OR list_contains({sorted(plates.CONFUSABLE)}, b[j] || a[i + 1]) THEN {plates.CONFUSED_COST} ELSE 1 END))) AS c FROM costs WHERE i < length(a))),
distances AS (SELECT a, b, r[len(r)] AS d FROM costs WHERE i = length(a))"""


@query(T.with_("obs").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_ENTRIES_SQL}, listed AS (SELECT * FROM entries WHERE active AND (expires_s IS NULL OR expires_s > {T.NOW})),
asked AS (SELECT DISTINCT o.plate AS a, l.plate AS b FROM obs o, listed l WHERE o.plate IS NOT NULL), {DISTANCES_SQL}
SELECT event_id, entry_id, round(d, 2) AS distance FROM obs o JOIN distances ON a = o.plate JOIN listed l ON l.plate = b WHERE d = 0 OR match_mode = 'fuzzy' AND d <= 1.5""")
def jn_watchlist_edits(spark, sf_dir):
    """Hits within an edit and a confusion."""
    return search.watchlist_matches(T.observations(spark, sf_dir), search.active_entries(entries(spark), T.NOW), 1.5).select("event_id", "entry_id", "distance")


@query(T.with_("obs").replace("WITH ", "WITH RECURSIVE ", 1) + f""", asked AS (SELECT DISTINCT plate AS a, 'UP32AB0OO8' AS b FROM obs WHERE plate IS NOT NULL), {DISTANCES_SQL}
SELECT event_id, round(d, 2) AS plate_distance FROM obs JOIN distances ON a = plate WHERE d <= 1.5""")
def flt_plate_fuzzy_edits(spark, sf_dir):
    return search.fuzzy_plate(T.observations(spark, sf_dir), "UP32AB0OO8", 1.5).select("event_id", "plate_distance")

"""Identity, alerts and other ordered decisions against plain Python over all rows of a small table."""

import heapq
import math
import random
from collections import defaultdict
from functools import cache
from itertools import islice, takewhile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.functions import plates
from kerbline.operators import alerts, anchors, folds, graph, health, identity, quantiles, search, stretches, travel
from kerbline.plans import registry, rules, text
from kerbline.plans import travel as plans
from kerbline.sources import tables as T

EDGE = "from_id string, to_id string, distance_m double, min_travel_s double, typical_travel_s double, allowed boolean"


@cache
def edit(a, b):
    """Weighted edit distance: confusable characters cost 0.35, all else 1."""
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row = row, [float(i)]
        for j, y in enumerate(b, 1):
            swap = 0 if x == y else 0.35 if x + y in plates.CONFUSABLE or y + x in plates.CONFUSABLE else 1
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + swap))
    return row[-1]


def shortest(edges, start, goal):
    """Least cost of one step at least from start to goal."""
    heap, seen = [(d, b) for a, b, d in edges if a == start], set()
    heapq.heapify(heap)
    while heap:
        cost, at = heapq.heappop(heap)
        if at == goal:
            return cost
        if at not in seen:
            seen.add(at)
            for a, b, d in edges:
                if a == at:
                    heapq.heappush(heap, (cost + d, b))
    return None


@pytest.mark.parametrize("kind", ["line", "ring", "random"])
def test_paths_against_dijkstra(spark, kind):
    rng = random.Random(4)
    n = 60 if kind == "random" else 30
    edges = [(f"n{i:02}", f"n{(i + 1) % n:02}", float(rng.randint(1, 9))) for i in range(n - (kind == "line"))]
    if kind == "random":
        edges = list({(a, b): (a, b, float(rng.randint(1, 99))) for a, b in ((f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(150)) if a != b}.values())
    df = spark.createDataFrame([(*e, e[2], e[2], True) for e in edges], EDGE)
    found = {(r.from_id, r.to_id): r.cost for r in graph.shortest_paths(df).collect()}
    names = sorted({x for e in edges for x in e[:2]})
    want = {(a, b): c for a in names for b in names if (c := shortest(edges, a, b)) is not None}
    assert found == want and (kind == "random" or len(want) == (n * (n - 1) // 2 if kind == "line" else n * n))
    one = {r.to_id: r.cost for r in graph.shortest_paths(df, origin="n00").collect()}
    assert one == {b: c for (a, b), c in want.items() if a == "n00"}


def test_no_two_sightings_are_candidates_of_each_other(spark):
    rows = [(1, True, 2.0, None), (2, True, 1.0, None), (3, True, 2.0, None)]
    obs = spark.createDataFrame(rows, "event_id long, scope boolean, t double, plate string")
    assert sorted((r.event_id, r.p_event_id) for r in identity.candidates(obs).collect()) == [(1, 2), (3, 1), (3, 2)]


def stream(rows, judge, window_s=3600, limit=200, same_plate=5):
    """One sighting after the other against a list of vehicles: (vehicle of each, its candidates, its decision)."""
    vehicles, vehicle, candidates, decided = defaultdict(dict), {}, {}, {}
    for r in sorted(rows, key=lambda r: (r.t, r.event_id)):
        newest = lambda: reversed(vehicles[r.scope].values())  # noqa: B023, E731
        seen = {v["id"]: v for v in islice(takewhile(lambda v: v["last"].t >= r.t - window_s, newest()), limit)}  # noqa: B023
        seen |= {v["id"]: v for v in islice((v for v in newest() if r.plate and v["plate"] == r.plate), same_plate)}
        found = []
        for v in seen.values():
            score, why, strong = judge(r, v)
            candidates[r.event_id, v["last"].event_id] = (score, why, v["id"])
            if why is None and score >= 0.62:
                found.append((-score, -v["last"].t, v["last"].event_id, strong, v))
        found.sort(key=lambda x: x[:3])
        v = {"id": r.event_id, "plate": None, "confidence": 0.0}
        if found:
            linked = found[0][3] or len(found) == 1 or found[1][0] - found[0][0] >= 0.05
            decided[r.event_id] = (found[0][2], -found[0][0], -found[1][0] if len(found) > 1 else None, linked)
            v = found[0][4] if linked else v
        v["last"] = r
        if r.plate and v["confidence"] <= r.confidence:
            v |= {"plate": r.plate, "confidence": r.confidence}
        vehicle[r.event_id] = v["id"]
        vehicles[r.scope].pop(v["id"], None)
        vehicles[r.scope][v["id"]] = v
    return vehicle, candidates, decided


def unlike(a, b, reliability):
    d = edit(a, b)
    if a != b and reliability >= 1 and d >= 1:
        return "plates_differ"
    return "plates_unlike" if a != b and reliability >= 0.5 and 1 - d / max(len(a), len(b)) < 0.5 else None


def judged(r, v, paths, base):
    """Score of a sighting and a vehicle, what rejects them, and whether the plates are as good as one; by the rules one after another."""
    p = v["last"]
    dt, parts, identifying = max(r.t - p.t, 0), [], 0
    strong = False
    if r.plate and p.plate:
        d = edit(r.plate, p.plate)
        similarity = 1 - d / max(len(r.plate), len(p.plate))
        reliability = min(1, min(r.confidence, p.confidence) / 0.6)
        parts.append((0.35 * reliability, round(similarity, 3)))
        strong = similarity >= 0.9 and reliability >= 1
        identifying = similarity if reliability >= 0.5 else 0
        if why := unlike(r.plate, p.plate, reliability):
            return None, why, strong
    if r.plate and v["plate"] and v["plate"] != p.plate and (why := unlike(r.plate, v["plate"], min(r.confidence, v["confidence"]) / 0.6)):
        return None, why, strong
    path = paths.get((p.camera_id, r.camera_id))
    if path is None and not strong:
        return None, "no_way", strong
    fresh = path is None or dt > T.GAP_S or path.hops > 2
    if path is not None and dt < path.min_travel_s * 0.85:
        return None, "too_fast", strong
    if not fresh:
        hops = [base.get(x) for x in zip(path.cameras, path.cameras[1:], strict=False)]
        expected = sum(hops) if None not in hops and sum(hops) > 0 else path.typical_travel_s
        ratio = dt / max(expected, 1)
        parts.append((0.15, round(1 if ratio <= 1 else math.exp(-(math.log(ratio) ** 2) / (2 * 0.64)), 3)))
        parts.append((0.15, 0.6 if r.camera_id == p.camera_id else 1 if path.hops == 1 else max(0.2, 1 - 0.3 * (path.hops - 1))))
    if fresh and not strong:
        return None, "new_journey_without_plate", strong
    if r.embedding is not None and p.embedding is not None and r.embedding_model == p.embedding_model:
        x, y = np.array(r.embedding), np.array(p.embedding)
        cosine = x @ y / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-9)
        looks = round(min(1, max(0, (cosine - 0.75) / 0.22)), 3)
        parts.append((0.25 * (0.6 if r.embedding_model == "color_histogram" else 1), looks))
        identifying = max(identifying, looks)
    alike = [{"white", "silver"}, {"silver", "grey"}, {"grey", "black"}, {"red", "orange"}, {"orange", "brown"}, {"orange", "yellow"}]
    family = {"car", "truck", "bus"}
    kind = 1 if r.vehicle_class == p.vehicle_class else 0.4 if {r.vehicle_class, p.vehicle_class} <= family else 0
    colour = 1 if r.colour == p.colour else 0.4 if {r.colour, p.colour} in alike else 0
    parts.append((0.1, round((kind + colour) / 2, 3)))
    score = round(sum(w * x for w, x in parts) / sum(w for w, _ in parts), 9)
    return score, None if identifying >= 0.75 else "nothing_identifies", strong


def judge_of(spark, sf_dir):
    paths = {(r.from_id, r.to_id): r for r in T.paths(spark).collect()}
    base = {(r.from_id, r.to_id): r.seconds for r in travel.baselines(T.trajectory(spark, sf_dir), T.edges(spark), T.NOW, plans._BASELINE, plans._WINDOW).collect()}
    return lambda r, v: judged(r, v, paths, base)


def test_identity_against_one_sighting_after_another(spark, medium):
    rows = plans._identity_rows(spark, medium).collect()
    vehicle, candidates, decided = stream(rows, judge_of(spark, medium))
    vehicles, scored = plans._resolved(spark, medium)
    scored = scored.cache()
    assert {r.event_id: r.vehicle for r in vehicles.collect()} == vehicle
    found = {(r.event_id, r.p_event_id): r for r in scored.select("event_id", "p_event_id", "p_vehicle", "score", "rejected").collect()}
    assert set(found) == set(candidates)
    for k, (score, why, of) in candidates.items():
        assert (found[k].rejected, found[k].p_vehicle) == (why, of), (k, found[k], score)
        assert score is None or found[k].score == pytest.approx(score, abs=1e-6)
    assert {why for _, why, _ in candidates.values()} >= {None, "plates_differ", "no_way", "nothing_identifies", "too_fast"}
    assert {r.event_id: (r.p_event_id, r.score, r.runner_up, r.linked) for r in identity.decisions(scored).collect()} == {k: (p, pytest.approx(s, abs=6e-5), n if n is None else pytest.approx(n, abs=6e-5), linked) for k, (p, s, n, linked) in decided.items()}
    assert any(n is not None for _, _, n, _ in decided.values()) and any(not linked for *_, linked in decided.values())
    by = {r.event_id: r for r in rows}
    fast = {(i, p) for (i, p), (_, why, _) in candidates.items() if why == "too_fast" and by[i].plate and by[i].plate == by[p].plate and by[i].camera_id != by[p].camera_id}
    assert {(r.event_id, r.p_event_id) for r in identity.conflicts(scored).collect()} == fast


def no_ways(spark):
    ring = spark.createDataFrame([("a", "b", 10.0, 10.0, 30.0, True), ("b", "a", 10.0, 10.0, 30.0, True)], EDGE)
    paths, base = graph.shortest_paths(ring), spark.createDataFrame([], "from_id string, to_id string, seconds double")
    return paths, lambda pairs: identity.scored(pairs, paths, base, T.GAP_S)


SIGHTING = "event_id long, scope boolean, t double, camera_id string, plate string, confidence double, vehicle_class string, colour string, embedding array<float>, embedding_model string"


def test_a_vehicle_is_no_rival_of_itself(spark):
    rows = [(i, True, 100.0 * i, "a", "UP32AB1111", 0.55, "car", "red", None, None) for i in range(1, 6)]
    vehicles, scored = identity.resolved(spark.createDataFrame(rows, SIGHTING), no_ways(spark)[1])
    assert {r.event_id: r.vehicle for r in vehicles.collect()} == dict.fromkeys(range(1, 6), 1)
    assert sorted((r.event_id, r.p_event_id) for r in scored.collect()) == [(i, i - 1) for i in range(2, 6)]


def test_crowded_windows_and_many_vehicles_of_one_plate(spark):
    """More vehicles in the window and by the plate than count, sightings without a plate, misread ones, and equal times."""
    rng, looks = random.Random(8), [[1.0, 0.0], [0.0, 1.0], [0.97, 0.2431]]
    rows = [(i, bool(i % 5), float(rng.randrange(0, 40_000, 20)), rng.choice("ab"), rng.choice([None, "UP32AB1111", "UP32AB111I", "UP32A81111", "DL01CC2222", "DL01CC2229"]), rng.choice([0.4, 0.55, 0.9]), rng.choice(["car", "bus"]), rng.choice(["red", "blue"]), rng.choice([None, *looks]), "deep") for i in range(400)]
    obs = spark.createDataFrame(rows, SIGHTING)
    paths, score = no_ways(spark)
    ways = {(r.from_id, r.to_id): r for r in paths.collect()}
    for limit in (3,):
        vehicle, candidates, _ = stream(obs.collect(), lambda r, v: judged(r, v, ways, {}), limit=limit, same_plate=2)
        vehicles, scored = identity.resolved(obs, score, limit=limit, same_plate=2)
        assert {r.event_id: r.vehicle for r in vehicles.collect()} == vehicle
        assert {(r.event_id, r.p_event_id) for r in scored.collect()} == set(candidates)


def test_connected_parts(spark):
    from kerbline.operators.parts import connected

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(140)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    want = defaultdict(set)
    for x in {x for a, b in edges if a != b for x in (a, b)}:
        want[root(x)].add(x)
    found = defaultdict(set)
    for r in connected(spark.createDataFrame(edges, "a long, b long")).collect():
        found[r.part].add(r.node)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values())) and all(k in v for k, v in found.items())


def test_vectors_of_other_models_and_a_vehicles_best_plate(spark):
    schema = "event_id long, scope boolean, t double, camera_id string, plate string, confidence double, vehicle_class string, colour string, embedding array<float>, embedding_model string"
    x, y = [1.0, 0.0], [0.97, 0.2431]
    rows = [(1, True, 0.0, "a", "UP32AB1111", 0.9, "car", "red", x, "deep"), (2, True, 100.0, "a", None, 0.9, "car", "red", y, "deep"), (3, True, 200.0, "a", "UP32AB9999", 0.9, "car", "red", x, "deep"), (4, True, 210.0, "a", None, 0.9, "car", "red", x, "color_histogram"), (5, True, 240.0, "a", None, 0.9, "car", "red", x, "color_histogram")]
    obs = spark.createDataFrame(rows, schema)
    ring = spark.createDataFrame([("a", "b", 10.0, 10.0, 30.0, True), ("b", "a", 10.0, 10.0, 30.0, True)], EDGE)
    base = spark.createDataFrame([], "from_id string, to_id string, seconds double")
    pairs = identity.scored(identity.candidates(obs), graph.shortest_paths(ring), base)
    found = {(r.event_id, r.p_event_id): r for r in pairs.collect()}
    assert found[2, 1].s_appearance == pytest.approx(1.0, abs=0.001) and found[4, 2].s_appearance is None and found[3, 1].rejected == "plates_differ"
    assert found[5, 4].s_appearance == 1.0 and found[5, 4].rejected is None
    parts = [(0.25 * 0.6, 1.0), (0.15, found[5, 4].s_time), (0.15, 0.6), (0.1, 1.0)]
    assert found[5, 4].score is None or found[5, 4].s_route is None or found[5, 4].score == pytest.approx(sum(w * v for w, v in parts) / sum(w for w, _ in parts))
    # The second sighting, which has no plate, is linked with the first; so the third can't be: its plate is another.
    score = lambda x: identity.scored(x, graph.shortest_paths(ring), base)
    vehicles, counted = identity.resolved(obs, score, accept=0.5)
    vehicle = {r.event_id: r.vehicle for r in vehicles.collect()}
    assert vehicle[2] == 1 and vehicle[3] == 3
    assert {(r.event_id, r.p_event_id): r.rejected for r in counted.collect()}[3, 2] == "plates_differ"
    why = {(r.event_id, r.p_event_id): r.why for r in identity.explained(pairs).collect()}
    assert "rejected: plates_differ" in why[3, 1] and "looks alike" in why[2, 1]


def life(actions):
    """Alerts by key, every one of which is kept and searched."""
    out = defaultdict(list)
    for r in sorted(actions, key=lambda r: (r.dedup_key, r.t, r.action)):
        own = out[r.dedup_key]
        if r.action == "resolve":
            for a in own:
                if a["status"] == "NEW":
                    a |= {"status": "RESOLVED", "resolved": r.t}
            continue
        live = [a for a in own if a["status"] == "NEW" and a["updated"] >= r.t - r.cooldown_s] or [a for a in own if a["status"] == "RESOLVED" and a["resolved"] >= r.t - r.cooldown_s]
        if live:
            live[-1]["reopened"] += live[-1]["status"] == "RESOLVED"
            live[-1] |= {"status": "NEW", "resolved": None, "updated": r.t, "n": live[-1]["n"] + 1}
        else:
            own.append({"status": "NEW", "created": r.t, "updated": r.t, "resolved": None, "n": 1, "reopened": 0})
    return sorted((k, a["created"], a["updated"], a["status"], a["resolved"] or -1, a["n"], a["reopened"]) for k, own in out.items() for a in own)


def lives(df):
    return sorted((r.dedup_key, r.created_s, r.updated_s, r.status, -1 if r.resolved_s is None or math.isnan(r.resolved_s) else r.resolved_s, r.occurrences, r.reopened) for r in df.collect())


def test_alerts_against_a_search_of_all(spark, small):
    actions = rules._actions(spark, small)
    assert lives(alerts.lifecycle(actions)) == life(actions.collect())
    rng = random.Random(2)
    made = [(f"k{rng.randrange(3)}", "T", "LOW", float(rng.choice([5, 20])), "a", float(rng.randrange(400)), rng.choice(["raise", "raise", "resolve"])) for _ in range(300)]
    df = spark.createDataFrame(made, "dedup_key string, type string, severity string, cooldown_s double, camera_id string, t double, action string")
    assert lives(alerts.lifecycle(df)) == life(df.collect())
    raised = rules.al_raise(spark, small).collect()
    assert len({r.code for r in raised}) == len(raised) > 0
    severity = {}
    for r in sorted(actions.where("action = 'raise'").collect(), key=lambda r: r.t):
        severity.setdefault(r.dedup_key, r.severity)
    assert sorted((r.type, r.severity, r.dedup_key, r.occurrences) for r in raised) == sorted((k.partition(":")[0], severity[k], k, n) for k, _, _, _, _, n, _ in life(actions.collect()))
    priorities = {e[0]: e[3] for e in rules.ENTRIES}
    hits = [r for r in raised if r.type == "WATCHLIST_MATCH"]
    assert hits and all(r.severity == priorities[int(r.dedup_key.split(":")[1])] for r in hits) and "CRITICAL" in {r.severity for r in hits}
    assert {r.type for r in raised} == {r.type for r in actions.where("action = 'raise'").collect()} and len({r.type for r in raised}) > 5


def test_a_rule_that_fails_takes_no_other_with_it(spark):
    good = spark.createDataFrame([("a", 1.0)], "camera_id string, t double")
    broken = lambda: good.where(F.raise_error(F.lit("no such thing")).isNull())
    raised = lambda df, rule: alerts.raised(df, rule, F.col("camera_id"), F.col("t"), F.col("camera_id"))
    found, failed = alerts.isolated({"one": lambda: raised(good, "WRONG_WAY"), "two": lambda: raised(broken(), "WRONG_WAY"), "three": lambda: 1 / 0, "four": lambda: raised(good, "CAMERA_OFFLINE")})
    assert sorted(r.type for r in found.collect()) == ["CAMERA_OFFLINE", "WRONG_WAY"] and set(failed) == {"two", "three"}


def test_repeated_passages_against_search(spark, small):
    rows = T.observations(spark, small).select("event_id", "camera_id", "vehicle_id", "t").collect()
    want = {}
    for r in rows:
        times, kept = sorted(x.t for x in rows if (x.camera_id, x.vehicle_id) == (r.camera_id, r.vehicle_id) and r.t - 172_800 <= x.t <= r.t), []
        for t in times:
            if not kept or t - kept[-1] >= 3_600:
                kept.append(t)
        if len(kept) >= 2:
            want[r.event_id] = len(kept)
    found = alerts.repeated_sightings(T.observations(spark, small), ["camera_id", "vehicle_id"], 172_800, 2, 3_600)
    assert {r.event_id: r.passages for r in found.collect()} == want and want


def test_plates_fused_by_vote(spark, small):
    rng = random.Random(6)
    rows = [(track, i, "".join(rng.choice([c, c, c, "8", "B"]) for c in "UP32AB1234")[: rng.choice([10, 10, 10, 9, 5])], rng.random(), [rng.random() for _ in range(10)] if rng.random() < 0.5 else None, rng.random() < 0.5) for track in range(40) for i in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "track long, read long, normalized string, confidence double, char_confidences array<double>, is_valid boolean")
    found, seen = {r.track: r for r in identity.fused_plates(df).collect()}, set()
    for track in range(40):
        reads = [r for r in rows if r[0] == track and len(r[2]) >= 6]
        if not reads:
            continue
        seen.add(track)
        weight = {r[1]: max(r[3], 1e-3) * (1.5 if r[5] else 1) for r in reads}
        lengths = defaultdict(float)
        for r in reads:
            lengths[len(r[2])] += weight[r[1]]
        n = max(lengths, key=lambda k: (lengths[k], -min(r[1] for r in reads if len(r[2]) == k)))
        plate, places = "", []
        for i in range(n):
            votes, conf, first = defaultdict(float), defaultdict(list), {}
            for r in reads:
                if len(r[2]) == n:
                    c = r[4][i] if r[4] else r[3]
                    votes[r[2][i]] += weight[r[1]] * max(c, 1e-3)
                    conf[r[2][i]].append(c)
                    first.setdefault(r[2][i], r[1])
            top = max(votes, key=lambda k: (votes[k], -first[k]))
            plate += top
            places.append(votes[top] / sum(votes.values()) * sum(conf[top]) / len(conf[top]))
        agree = sum(r[2] == plate for r in reads)
        want = sum(places) / n * lengths[n] / sum(lengths.values()) * (min(1, 0.75 + 0.125 * (agree - 1)) if agree else 0.6)
        assert (found[track].plate, found[track].votes, found[track].total_reads) == (plate, agree, len(reads))
        assert found[track].confidence == pytest.approx(want, abs=6e-5)
    assert seen == set(found)
    assert text.str_fuse(spark, small).count() > 0


def test_masked_documents_hold_no_plate(spark, small):
    plates_ = {r.plate for r in T.observations(spark, small).where("plate is not null").collect()}
    found = registry.queries()["sec_mask_doc"](spark, small).where("doc like '%PSN-%'").collect()
    assert found and not any(p in r.doc for r in found for p in plates_)


def test_admitted_hits_against_a_list(spark, small):
    rows = sorted(T.observations(spark, small).select("vehicle_id", "t", "event_id").collect(), key=lambda r: (r.t, r.event_id))
    live, want = defaultdict(list), {}
    for r in rows:
        live[r.vehicle_id] = [t for t in live[r.vehicle_id] if r.t - t <= 86_400]
        want[r.event_id] = len(live[r.vehicle_id]) < 3
        if want[r.event_id]:
            live[r.vehicle_id].append(r.t)
    assert {r.event_id: r.allowed for r in folds.rate_limited(T.observations(spark, small), "vehicle_id", 3, 86_400).collect()} == want


def test_watchlist_candidates_are_those_of_a_full_search(spark, small):
    obs, listed = T.observations(spark, small), search.active_entries(rules.entries(spark), T.NOW).collect()
    want = {(r.event_id, e.entry_id) for r in obs.where("plate is not null").collect() for e in listed if r.plate == e.plate or e.match_mode == "fuzzy" and edit(e.plate, r.plate) <= 0.8}
    found = search.watchlist_matches(obs, search.active_entries(rules.entries(spark), T.NOW), 0.8)
    assert {(r.event_id, r.entry_id) for r in found.collect()} == want
    near = spark.createDataFrame([(a, b) for a in ("UP32AB0001", "", "X") for b in ("UP3ZA80OO1", "UP32A", "", "Y")], "a string, b string")
    assert all(r.d == pytest.approx(edit(r.a, r.b)) for r in near.select("a", "b", plates.weighted_distance("a", "b").alias("d")).where(F.col("d").isNotNull()).collect())


def test_plates_found_by_deletions_are_those_of_a_full_search(spark):
    rng = random.Random(9)

    def changed(x):
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(x) + 1)
            x = rng.choice([x[:i] + rng.choice("0O1I8BZ29") + x[i:], x[:i] + x[i + 1 :], x[:i] + rng.choice("0ODQ1I7T8BG6") + x[i + 1 :]]) or "A"
        return x

    seen = ["".join(rng.choice("UPDL01O8B6GZ2") for _ in range(rng.choice([1, 2, 6, 9, 10]))) for _ in range(60)]
    plates_ = sorted({changed(rng.choice(seen)) for _ in range(400)})
    obs = spark.createDataFrame([(i, x) for i, x in enumerate([*plates_, None, ""])], "event_id long, plate string")
    for most in (0.0, 0.7, 1.0, 1.5, 2.1):
        found = search.near_plates(obs, spark.createDataFrame([(x,) for x in seen], "wanted string"), most)
        assert {(r.plate, r.wanted) for r in found.collect()} == {(p, w) for p in [*plates_, ""] for w in seen if edit(p, w) <= most + 1e-9}
    keys = obs.where("plate <> ''").select("plate", F.explode(search.deletions(F.col("plate"), 1)).alias("k")).groupBy("k").count()
    assert keys.agg(F.max("count")).first()[0] < len(plates_) / 4


@pytest.mark.parametrize("hot", [False, True])
def test_anchors_put_together_are_those_of_the_fold(spark, hot):
    rng = random.Random(11)
    times = [float(rng.randrange(0, 9000 if hot else 60_000)) / 2 for _ in range(3000)] + [-50.0, -49.5, -2.0, 0.0, 640.0, 640.0]
    rows = [("a", "P" if hot or rng.random() < 0.7 else f"Q{rng.randrange(60)}", t, i, rng.random(), rng.choice([None, 30.0, 50.0]), rng.randrange(5)) for i, t in enumerate(times)] + [("b", None, 1.0, 9000, 0.5, None, 1)]
    obs = spark.createDataFrame(rows, "camera_id string, plate string, t double, event_id long, confidence double, speed_kmh double, votes long").repartition(5)
    for apart in (10.0, 0.5, 700.0):
        plain = lambda df: sorted((tuple(-1 if x is None or x != x else x for x in r) for r in df.collect()), key=repr)
        names = ["camera_id", "plate", "event_id", "anchor", "last_t", "confidence", "speed_kmh", "votes", "fragments"]
        assert plain(anchors.merged_fragments(obs, apart).select(names)) == plain(folds.merged_fragments(obs, apart).select(names))
        keyed = obs.where("plate is not null")
        assert plain(anchors.passages(keyed, ["camera_id", "plate"], apart)) == plain(folds.passages(keyed, ["camera_id", "plate"], apart))


def test_a_hot_key_is_dealt_to_many_tasks(spark):
    """Of one key's rows no task gets more than a few stretches, and the fold gets few rows."""
    obs = spark.range(40_000).select(F.lit("a").alias("camera_id"), (F.col("id") * 5.0).alias("t"))
    stretches = obs.groupBy(F.floor(F.col("t") / (10.0 * anchors.STRETCH))).count()
    assert stretches.count() > 300 and stretches.agg(F.max("count")).first()[0] <= 2 * anchors.STRETCH
    assert anchors.passages(obs, ["camera_id"], 10.0).collect() == [("a", 40_000, 20_000)]


@pytest.mark.parametrize("after", [False, True])
def test_anchors_of_groups_that_go_on_in_other_batches(spark, after):
    """However few rows a batch has, a group's anchors are those of one row after another; other columns stay as they are."""
    rng = random.Random(21)
    times = [float(rng.randrange(-200, 4000 if rng.random() < 0.7 else 40_000)) / 2 for _ in range(500)] + [640.0] * 40
    rows = [(rng.choice("aab"), rng.choice([7, 7, 2**60 + 1, *range(30)]), t, i, rng.choice([None, 2**53 + 1])) for i, t in enumerate(times)]
    odd = [(None, 7, 5.0, 9000, None), ("a", None, 5.0, 9001, None), ("a", 7, None, 9002, 1)]
    obs = spark.createDataFrame(rows + odd, "camera_id string, vehicle_id long, t double, event_id long, votes long").repartition(5)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for apart in (10.0, 0.5):
            want, last = {}, {}
            for r in sorted(rows, key=lambda r: (r[2], r[3])):
                gap = r[2] - last.get(r[:2], -math.inf)
                kept = gap > apart or (gap == apart and not after)
                last[r[:2]] = r[2] if kept else last[r[:2]]
                want[r[3]] = (*r, last[r[:2]], kept)
            for rows_of_a_batch in (1, 16):
                spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_of_a_batch)
                found = anchors.anchored(obs, ["camera_id", "vehicle_id"], apart, after).collect()
                assert len(found) == len(rows) and {r.event_id: tuple(r) for r in found} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


@pytest.mark.parametrize("name", ["win_min_separation", "win_fragment"])
def test_groups_of_a_batch_are_worked_out_at_once(spark, small, tmp_path, monkeypatch, name):
    """Python hands back a few batches, and not one for each vehicle at a camera, which took some milliseconds each."""
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("user_id", F.explode(F.array(*[F.col("user_id") + 15 * i for i in range(8)])))
    events.write.parquet(f"{tmp_path}/events.parquet")
    made, frame = spark.sparkContext.accumulator(0), type(events)

    def counted(task):
        def told(batches):
            for x in task(batches):
                made.add(1)
                yield x

        return told

    for of in ("mapInPandas", "mapInArrow"):
        monkeypatch.setattr(frame, of, lambda self, task, *a, f=getattr(frame, of), **b: f(self, counted(task), *a, **b))
    assert len(registry.queries()[name](spark, str(tmp_path)).collect()) == 600
    assert 0 < made.value < 300


def test_medians_of_a_hot_key_and_of_odd_values(spark):
    rng = np.random.default_rng(5)
    values = {"hot": rng.lognormal(3, 2, 20_001), "even": rng.normal(0, 50, 5_000), "one": np.array([7.5]), "two": np.array([-1.0, 4.0]), "same": np.full(999, 3.25), "close": 1e6 + rng.integers(0, 50, 3_000) / 64, "signs": np.array([-3.0, -3.0, -0.0, 0.0, 2.0, 2.0]), "large": np.array([1e300, -1e300, 5e-324])}
    rows = [(k, float(v)) for k, own in values.items() for v in own] + [("hot", None), ("none", None), (None, 1.0), (None, 3.0)]
    found = {r.k: (r.median, r.samples) for r in quantiles.medians(spark.createDataFrame(rows, "k string, v double").repartition(6), ["k"], "v").collect()}
    assert found == {k: (float(np.median(v)), len(v)) for k, v in values.items()} | {None: (2.0, 2)}


def test_stretches_hand_on_their_edges(spark):
    """One camera with nearly all rows: what windows over all its rows give, by stretches of which each is small."""
    rng = random.Random(12)
    rows = [("hot" if rng.random() < 0.95 else rng.choice("ab"), float(rng.choice([rng.randrange(0, 400_000), rng.randrange(0, 400)])), i, rng.choice([None, 0, 1, 5, 9]), rng.choice(["ONLINE", "OFFLINE", "DEGRADED"])) for i in range(4000)] + [(None, 5.0, 9000, 3, "ONLINE"), (None, 99_999.0, 9001, 2, "OFFLINE")]
    df = spark.createDataFrame(rows, "camera_id string, t double, event_id long, v long, status string").repartition(7)
    order, want, numbers = defaultdict(list), {}, {}
    for r in sorted(rows, key=lambda r: r[1:3]):
        own = order[r[0]]
        want[r[2]] = (own[-1][3], own[-1][4]) if own else (None, None)
        own.append(r)
        numbers[r[2]] = len(own)
    for stretch in (10.0, 3600.0):
        found = stretches.previous(df, ["camera_id"], ["v", "status"], stretch)
        assert {r.event_id: (r.before_v, r.before_status) for r in found.collect()} == want and found.columns[:5] == df.columns
        assert {r.event_id: (r.i, r.n) for r in stretches.numbered(df, ["camera_id"], stretch_s=stretch).collect()} == {k: (numbers[k], len(order[next(r[0] for r in rows if r[2] == k)])) for k in numbers}
    known = {k: [r[3] for r in own if r[3] is not None] for k, own in order.items()}
    halves = {r.camera_id: (r.early, r.late) for r in health.split_halves(df, "v").collect()}
    assert halves == {k: (float(np.median(v[: len(v) // 2])), float(np.median(v[len(v) // 2 :]))) for k, v in known.items() if len(v) >= 4}

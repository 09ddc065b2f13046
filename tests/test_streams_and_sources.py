"""Streams in several batches, dead letters and their replay, spools, road networks, plates."""

import hashlib
import json
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from kerbline.functions import plates
from kerbline.operators import folds, graph, identity
from kerbline.plans import registry
from kerbline.sources import network, spool
from kerbline.streaming import ingest, run, windows

SCHEMA = "event_id long, t double, camera_id string, plate string, confidence double, votes long, speed_kmh double, k int"


def stream(spark, path, batches):
    """A stream that gets each list of rows as a batch of its own."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return ingest.files(spark, path, SCHEMA, 1).withColumn("ts", F.timestamp_seconds("t"))


def row(i, t, plate="UP32AB0001", camera="a"):
    return (i, float(t) + 60_000, camera, plate, 0.5 + i / 1000, 1, 10.0 * i, i)


def test_passages_over_batches_equal_the_fold(spark, tmp_path):
    # Out of order within a batch, which is sorted; what the second batch holds comes after what the first does.
    rows = sorted((row(i, 7 * i + (i % 4) * 11, f"UP32AB000{i % 2}") for i in range(60)), key=lambda r: r[1])
    rows = [*rows[24::-1], *rows[:24:-1]]
    late = [row(100, 10_000, "UP32AB0009"), row(101, 20_000, "UP32AB0009")]  # they move the watermark on
    found = run.finished(windows.passages(stream(spark, str(tmp_path / "in"), [rows[:25], rows[25:], late]), 25, "60 seconds"), "t-passages")
    want = folds.merged_fragments(spark.createDataFrame(rows, SCHEMA), 25)
    key = lambda df: sorted((r.plate, round(r.anchor, 3), r.fragments, r.votes) for r in df.collect() if r.plate != "UP32AB0009")
    assert sum(x[2] for x in key(found)) == 60 and {x[0] for x in key(found)} == {"UP32AB0000", "UP32AB0001"}
    assert [(p, round(a, 3), f, v) for p, a, f, v in key(found)] == key(want)


def test_late_sightings_merge_with_the_open_passage_or_stand_alone(spark, tmp_path):
    first, late = [row(1, 1000), row(2, 1010)], [row(3, 990), row(4, 950), row(100, 10_000, "UP32AB0009"), row(101, 20_000, "UP32AB0009")]
    found = run.finished(windows.passages(stream(spark, str(tmp_path / "in"), [first, late]), 25, "60 seconds"), "t-late")
    assert sorted((r.anchor - 60_000, r.fragments) for r in found.collect() if r.plate == "UP32AB0001") == [(950.0, 1), (990.0, 3)]


def test_repeated_events_across_batches(spark, tmp_path):
    rows = [row(i, i) for i in range(10)]
    found = run.finished(ingest.unique(stream(spark, str(tmp_path / "in"), [rows, rows, rows[:3] + [row(11, 11)]]), "1 hour"), "t-unique")
    assert sorted(r.event_id for r in found.collect()) == [*range(10), 11]


def test_buckets_close_behind_the_watermark(spark, tmp_path):
    source = stream(spark, str(tmp_path / "in"), [[row(1, 5), row(2, 50), row(3, 70)], [row(4, 59), row(5, 200)], [row(8, 230)], [row(6, 10), row(7, 400)]])
    found = {r.bucket_start.timestamp(): r.vehicles for r in run.finished(windows.buckets(source, "60 seconds", "30 seconds"), "t-buckets").collect()}
    assert found == {60_000.0: 3, 60_060.0: 1, 60_180.0: 2}  # the sixth is too late


def test_dead_letters_and_their_replay(spark, tmp_path):
    good = {"type": "observation", "event_id": "1", "observed_at": "2024-01-01T00:00:00Z", "speed_kmh": 3.5}
    lines = [json.dumps(good), "{torn", json.dumps({"type": "parcel"}), json.dumps(good | {"type": "camera_status", "observed_at": "1704067200"})]
    path = str(tmp_path / "lines")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.parquet(path)
    out = run.batches(ingest.decoded(ingest.files(spark, path, "value string")), "t-dispatch", ingest.tables_sink)
    events = spark.read.parquet(f"{out}/events")
    assert sorted((r.type, r.ts.isoformat()) for r in events.collect()) == [("camera_status", "2024-01-01T00:00:00"), ("observation", "2024-01-01T00:00:00")]
    dead = spark.read.parquet(f"{out}/dead_letters")
    assert sorted(r.error for r in dead.collect()) == ["not an event", "unknown type parcel"]
    again = ingest.replayed(dead, F.regexp_replace("payload", "parcel", "observation"))
    assert sorted(r.error or "" for r in again.collect()) == ["", "not an event"]
    ingest.tables_sink(out)(ingest.decoded(spark.read.parquet(path)), 0)  # a batch that is repeated is written once
    events = spark.read.parquet(f"{out}/events")
    assert events.count() == 2
    assert ingest.new_events(events, events.limit(0)).count() == 1


def test_every_event_is_on_time_or_late(spark, tmp_path):
    batches = [[row(1, 100), row(2, 500)], [row(3, 430), row(4, 50), row(5, 600, camera="b"), row(6, 900)], [row(7, 500), row(8, 800), row(9, 10, camera="b")], []]
    told = windows.marked_late(stream(spark, str(tmp_path / "in"), [x for x in batches if x]).drop("ts"), ["camera_id"], 100)
    run.continued(told, str(tmp_path / "out"), run.on_time_and_late(str(tmp_path / "out")))
    found = {(r.event_id, r.late) for r in run.told_apart(spark, str(tmp_path / "out")).collect()}
    assert found == {(1, False), (2, False), (3, False), (4, True), (5, False), (6, False), (7, True), (8, False), (9, True)}


def test_letters_are_replayed_once(spark, tmp_path):
    lines = ["{torn", json.dumps({"type": "parcel", "event_id": "7"}), json.dumps({"type": "box", "event_id": "8"}), json.dumps({"type": "observation", "event_id": "9"})]
    path = str(tmp_path / "out")
    ingest.tables_sink(path)(ingest.decoded(spark.createDataFrame([(x,) for x in lines], "value string")), 4)
    mended = F.regexp_replace("payload", "parcel", "observation")
    states = lambda: sorted(r.state for r in ingest.letters(spark, path, 4).collect())
    assert states() == ["OPEN"] * 3
    with ThreadPoolExecutor(4) as pool:  # of replays at once one does it
        done = list(pool.map(lambda _: ingest.replay(spark, path, 4, mended), range(4)))
    replayed = lambda: sorted(r.event_id for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/replayed").collect())
    assert any(done) and states() == ["OPEN", "OPEN", "RESOLVED"] and replayed() == ["7"]
    assert ingest.replay(spark, path, 4, mended) and replayed() == ["7"]  # what is resolved isn't replayed again
    assert ingest.discard(spark, path, 4, F.col("payload") == "{torn") and states() == ["DISCARDED", "OPEN", "RESOLVED"]
    assert not ingest.resumed(spark, path, 4, mended)
    ingest._claimed(spark, path, 4)  # one that began, and died
    assert not ingest.replay(spark, path, 4, mended) and ingest.resumed(spark, path, 4, F.regexp_replace("payload", "box", "observation"))
    assert states() == ["DISCARDED", "RESOLVED", "RESOLVED"] and replayed() == ["7", "8"]


def test_shards_are_digests_modulo(spark):
    names = [f"camera-{i}" for i in range(30)]
    for r in spark.createDataFrame([(x,) for x in names], "c string").select("c", ingest.shard(F.col("c"), 7).alias("s")).collect():
        assert r.s == int(hashlib.sha1(r.c.encode()).hexdigest(), 16) % 7


def test_latest_and_spool(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ON", 1), ("a", "OFF", 5), ("b", "ON", 2)], "camera_id string, status string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.camera_id: r.status for r in windows.latest(rows).collect()} == {"a": "OFF", "b": "ON"}
    spool.put(spark.createDataFrame([('{"a": 1}',), ("{torn",)], "value string"), str(tmp_path / "spool"))
    spool.put(spark.createDataFrame([('{"a": 2}',)], "value string"), str(tmp_path / "spool"))
    assert sorted(r.a for r in spool.replay(spark, str(tmp_path / "spool"), "a long").collect()) == [1, 2]


def test_roads_become_edges(spark):
    def metres(p, q):
        a = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(a))

    roads = [("r1", "Long", "a", "b", [[26.0, 80.0], [26.1, 80.1], [26.1, 80.2]], True), ("r2", "Short", "b", "a", [[26.1, 80.2], [26.0, 80.0]], None), ("r3", "Stub", None, "b", [[26.0, 80.0], [26.1, 80.0]], False)]
    found = {(r.from_id, r.to_id): r for r in network.camera_edges(spark.createDataFrame(roads, "road_id string, name string, from_id string, to_id string, path array<array<double>>, one_way boolean")).collect()}
    assert set(found) == {("a", "b"), ("b", "a")}
    length = metres([26.1, 80.2], [26.0, 80.0])
    assert found["b", "a"].road_id == found["a", "b"].road_id == "r2" and found["b", "a"].allowed
    assert found["b", "a"].distance_m == round(length, 1) and found["b", "a"].typical_travel_s == round(length / (30 / 3.6), 1)
    assert found["a", "b"].path == [[26.0, 80.0], [26.1, 80.2]] and found["a", "b"].direction in ("NE", "E")


def test_trailing_windows_against_search(spark):
    rows = [row(i, (i * 37) % 500, camera="ab"[i % 2]) for i in range(80)]
    found = folds.trailing(spark.createDataFrame(rows, SCHEMA), ["camera_id"], 60, {"n": "count(*)"}).collect()
    assert len(found) == 80
    for r in found:
        assert r.n == sum(x[2] == r.camera_id and r.t - 60 <= x[1] <= r.t for x in rows)


def test_plates_by_template(spark):
    reads = {"up 32 ab 1234": ("UP32AB1234", True, 0), "UP3ZAB1O34": ("UP32AB1034", True, 2), "22BH1234AA": ("22BH1234AA", True, 0), "IND DL1CAB1234": ("DL1CAB1234", True, 0), "": ("", False, None), "XYZ": ("XYZ", False, None), "0L1CAB1234": ("DL1CAB1234", True, 2)}
    df = spark.createDataFrame([(x,) for x in reads], "raw string").select("raw", plates.normalised(F.col("raw")).alias("p"))
    for r in df.collect():
        text, valid, changed = reads[r.raw]
        assert (r.p.normalized, r.p.is_valid) == (text, valid), r
        assert changed is None or len(r.p.corrections) == changed, r


def test_paths_take_the_cheapest_way(spark):
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("c", "a", 1.0), ("c", "d", 1.0)]
    df = spark.createDataFrame([(*e, e[2], e[2], True) for e in edges], "from_id string, to_id string, distance_m double, min_travel_s double, typical_travel_s double, allowed boolean")
    found = {(r.from_id, r.to_id): (r.cost, r.cameras) for r in graph.shortest_paths(df).collect()}
    assert found["a", "c"] == (2.0, ["a", "b", "c"]) and found["a", "a"] == (3.0, ["a", "b", "c", "a"]) and ("d", "a") not in found


def test_paths_and_corridors_have_no_limit_of_hops(spark):
    # A ring of nine, and a dearer direct way for its first eight hops.
    edges = [(f"n{i}", f"n{(i + 1) % 9}", 1.0) for i in range(9)] + [("n0", "n8", 20.0)]
    df = spark.createDataFrame([(*e, e[2], e[2], True) for e in edges], "from_id string, to_id string, distance_m double, min_travel_s double, typical_travel_s double, allowed boolean")
    found = {(r.from_id, r.to_id): (r.cost, r.hops) for r in graph.shortest_paths(df).collect()}
    assert found == {(f"n{i}", f"n{j}"): (d, d) for i in range(9) for j in range(9) for d in [(j - i) % 9 or 9]}
    base = spark.createDataFrame([], "from_id string, to_id string, seconds double")
    scores = spark.createDataFrame([], "camera_id string, score double, level string")
    assert [r.camera_id for r in graph.corridor(df, base, scores, "n0", "n7").orderBy("position").collect()] == [f"n{i}" for i in range(8)]
    assert {r.hops for r in graph.shortest_paths(df, max_hops=2).collect()} == {1, 2}


def test_candidates_count_vehicles_not_sightings(spark):
    # Two vehicles seen 150 times each use up no place of a third seen before them, nor of two sightings without a plate.
    seen = [(1, 10.0, "C"), (2, 11.0, None), (3, 12.0, None)] + [(10 + i, 20.0 + i, "AB"[i % 2]) for i in range(300)] + [(999, 400.0, "D")]
    rows = [(i, False, t, "a", plate and plate * 6, 0.9, "car", "red", None) for i, t, plate in seen]
    obs = spark.createDataFrame(rows, "event_id long, scope boolean, t double, camera_id string, plate string, confidence double, vehicle_class string, colour string, embedding array<float>")
    ring = spark.createDataFrame([("a", "b", 1.0, 0.1, 0.3, True), ("b", "a", 1.0, 0.1, 0.3, True)], "from_id string, to_id string, distance_m double, min_travel_s double, typical_travel_s double, allowed boolean")
    paths, base = graph.shortest_paths(ring), spark.createDataFrame([], "from_id string, to_id string, seconds double")
    for limit, want in ((200, [1, 2, 3, 308, 309]), (4, [2, 3, 308, 309])):
        vehicles, scored = identity.resolved(obs, lambda pairs: identity.scored(pairs, paths, base), limit=limit)
        assert sorted(r.p_event_id for r in scored.where("event_id = 999").collect()) == want
        assert vehicles.select("vehicle").distinct().count() == 6


def test_pairs_to_begin_with_are_the_newest_and_those_of_a_plate(spark):
    rows = [(i, False, float(10 * i), "AB"[i % 2]) for i in range(40)]
    obs = spark.createDataFrame(rows, "event_id long, scope boolean, t double, plate string")
    found = identity.candidate_ids(obs, window_s=100, limit=3).where("event_id = 39").collect()
    assert {(r.p_event_id, r.near) for r in found} == {(38, True), (37, True), (36, True), (35, False), (33, False), (31, False), (29, False)}


def test_pseudonym_and_event_filters_find_rows(spark, small):
    every = registry.queries()
    assert every["flt_pseudonym_prefix"](spark, small).count() > 0
    raw, blanked = (every[x](spark, small).collect() for x in ("ws_filter_raw", "ws_filter_blanked"))
    assert len(raw) == len(blanked) > every["ws_filter"](spark, small).count()
    assert any(r.plate for r in raw) and not any(r.plate for r in blanked)

"""Lines of routes and places on them against plain Python."""

import math
import random

from pyspark.sql import functions as F

from kerbline.operators import journeys, roads

PLACES = {"a": (26.0, 80.0), "b": (26.0, 80.2), "c": (26.3, 80.2), "d": (26.5, 80.9)}
#: The way from a to b bends, tells a vertex twice, and ends a little before b; c to d has no road.
LINES = {("a", "b"): [(26.0, 80.0), (26.1, 80.1), (26.1, 80.1), (26.0, 80.19)], ("b", "c"): []}


def metres(p, q):
    k = math.cos(math.radians((p[0] + q[0]) / 2))
    return 6_371_008.8 * math.hypot(math.radians(q[0] - p[0]), math.radians(q[1] - p[1]) * k)


def walked(line, share):
    line = [p for i, p in enumerate(line) if i == 0 or p != line[i - 1]]
    left = share * sum(map(metres, line, line[1:]))
    for p, q in zip(line, line[1:], strict=False):
        if left <= metres(p, q):
            return tuple(x + (y - x) * left / metres(p, q) for x, y in zip(p, q, strict=True))
        left -= metres(p, q)
    return line[-1]


def made(spark):
    cameras = spark.createDataFrame([(c, *p) for c, p in PLACES.items()], "camera_id string, latitude double, longitude double")
    edges = spark.createDataFrame([(*e, [list(p) for p in line]) for e, line in LINES.items()] + [("c", "zz", None)], "from_id string, to_id string, path array<array<double>>")
    paths = spark.createDataFrame([("a", "b", ["a", "b"]), ("b", "c", ["b", "c"]), ("a", "c", ["a", "b", "c"])], "from_id string, to_id string, cameras array<string>")
    return cameras, roads.routes(paths, roads.edge_lines(edges, cameras), cameras)


def test_lines_are_joined_and_cleaned(spark):
    cameras, found = made(spark)
    rows = {(r.from_id, r.to_id): r for r in found.collect()}
    assert set(rows) == {("a", "b"), ("b", "c"), ("a", "c")}
    assert [tuple(p) for p in rows["a", "c"].line] == [*LINES["a", "b"], PLACES["c"]] and rows["a", "c"].via == ["b"]
    assert [tuple(p) for p in rows["b", "c"].line] == [PLACES["b"], PLACES["c"]] and rows["b", "c"].via == []
    assert [(v.lat, v.lon) for v in rows["a", "b"].way] == [LINES["a", "b"][0], LINES["a", "b"][1], LINES["a", "b"][3], PLACES["b"]]
    assert all(a.m < b.m for r in rows.values() for a, b in zip(r.way, r.way[1:], strict=False)) and rows["a", "c"].way[0].m == 0
    legs = spark.createDataFrame([(1, 0, 1, "a", "c"), (1, 0, 2, "c", "d"), (1, 0, 3, "d", "nowhere"), (1, 1, 4, None, "a")], "vehicle_id int, journey_index int, seq int, from_camera_id string, camera_id string")
    got = {r.seq: r for r in roads.segments(legs, found, cameras).collect()}
    assert set(got) == {1, 2} and [tuple(p) for p in got[2].line] == [PLACES["c"], PLACES["d"]] and got[2].via == []


def test_places_along_random_ways(spark):
    rng = random.Random(5)
    lines = [[(26 + rng.random(), 80 + rng.random()) for _ in range(rng.choice([1, 2, 3, 9, 64, 65]))] for _ in range(40)]
    rows = []
    for i, line in enumerate(lines):
        sums = [0.0]
        for p, q in zip(line, line[1:], strict=False):
            sums.append(sums[-1] + metres(p, q))
        rows += [(i, s, [(m, *p) for m, p in zip(sums, line, strict=True)]) for s in (0.0, 1.0, 0.5, rng.random())]
    df = spark.createDataFrame(rows, "i int, share double, way array<struct<m: double, lat: double, lon: double>>")
    for r in df.select("i", "share", roads.along(F.col("way"), F.col("share")).alias("p")).collect():
        assert all(map(math.isclose, r.p, walked(lines[r.i], r.share))), r


def test_positions_follow_the_road_within_a_journey(spark):
    cameras, found = made(spark)
    seen = [(0, 0, "a", 0.0), (1, 0, "c", 100.0), (2, 0, "c", 100.0), (3, 0, "d", 150.0), (4, 1, "a", 400.0)]
    points = spark.createDataFrame([(7, seq, j, c, t) for seq, j, c, t in seen] + [(8, 0, 0, "b", 5.0)], "vehicle_id int, seq int, journey_index int, camera_id string, t double")
    asked = [-3.0, 0.0, 30.0, 99.0, 100.0, 125.0, 150.0, 170.0, 210.0, 999.0]
    at = spark.createDataFrame([(7, v) for v in asked] + [(8, 50.0), (9, 1.0)], "vehicle_id int, v double")
    got = {(r.vehicle_id, r.v): r for r in roads.position_at(journeys.replay_timeline(points, 60), at, found, cameras).collect()}
    # Gaps are cut to 60 seconds: a at 0, c at 60 (twice), d at 110, a at 170.
    road = [*LINES["a", "b"], PLACES["c"]]  # the second edge's first vertex is dropped
    want = {-3.0: ("stop", PLACES["a"]), 0.0: ("stop", PLACES["a"]), 30.0: ("road", walked(road, 0.5)), 99.0: ("road", walked([PLACES["c"], PLACES["d"]], 0.78)), 100.0: ("road", walked([PLACES["c"], PLACES["d"]], 0.8)),
            125.0: ("gap", PLACES["d"]), 150.0: ("gap", PLACES["d"]), 170.0: ("stop", PLACES["a"]), 210.0: ("stop", PLACES["a"]), 999.0: ("stop", PLACES["a"])}
    assert set(got) == {(7, v) for v in asked} | {(8, 50.0)} and got[8, 50.0].kind == "stop"
    for v, (kind, place) in want.items():
        r = got[7, v]
        assert r.kind == kind and math.isclose(r.latitude, place[0]) and math.isclose(r.longitude, place[1]), r

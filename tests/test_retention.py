"""Retention over tables by day against plain Python, and a run that fails halfway."""

import random

import pytest
from pyspark.sql import functions as F

from kerbline.sources import retention
from kerbline.sources.retention import DAY_S, Rule

SCHEMAS = {"observations": "event_id long, t double, vehicle_id long", "reads": "event_id long, t double, id long", "letters": "id long, t double, resolved boolean", "vehicles": "vehicle_id long, last_seen_s double"}
RULES = {"observations": Rule(3.5), "reads": Rule(3.5, depends=True), "letters": Rule(2, only="resolved"), "vehicles": Rule(3.5)}
NOW = 10.0 * DAY_S


def tables():
    rng = random.Random(3)
    obs = [(i, rng.random() * NOW, i % 9 if i % 4 else 100 + i) for i in range(80)]
    at = {i: t for i, t, _ in obs}
    reads = [(i if i % 5 else None, at[i], i) for i in range(80)]
    letters = [(i, rng.random() * NOW, (True, False, None)[i % 3]) for i in range(60)]
    # A vehicle's last sighting may have been told wrongly; then it stays by the sightings it has.
    vehicles = [(v, rng.random() * NOW) for v in {v for _, _, v in obs} | {500, 501}]
    return {"observations": obs, "reads": reads, "letters": letters, "vehicles": vehicles}


def put(spark, root, rows):
    out = {}
    for name, x in rows.items():
        df = spark.createDataFrame(x, SCHEMAS[name])
        out[name] = df.withColumn("day", F.floor(F.col("last_seen_s" if name == "vehicles" else "t") / DAY_S))
    retention.put(spark, root, out)


def held(spark, root):
    return {name: sorted(map(tuple, retention.read(spark, root, name, s).collect()), key=repr) for name, s in SCHEMAS.items()}


def wanted(rows):
    cut = NOW - 3.5 * DAY_S
    obs = [r for r in rows["observations"] if r[1] >= cut]
    ids, left = {r[0] for r in obs}, {r[2] for r in obs}
    out = {"observations": obs, "reads": [r for r in rows["reads"] if (r[0] in ids if r[0] is not None else r[1] >= cut)], "letters": [r for r in rows["letters"] if r[1] >= NOW - 2 * DAY_S or not r[2]], "vehicles": [r for r in rows["vehicles"] if r[1] >= cut or r[0] in left]}
    return {k: sorted(x, key=repr) for k, x in out.items()}


def test_a_run_equals_plain_python_and_repeats(spark, tmp_path):
    root, rows = str(tmp_path), tables()
    put(spark, root, rows)
    before, folders = held(spark, root), retention.listed(spark, root)
    want = wanted(rows)
    gone = retention.run(spark, root, RULES, SCHEMAS, NOW)
    assert held(spark, root) == want and gone == {k: len(rows[k]) - len(want[k]) for k in rows} and all(gone.values())
    after = retention.listed(spark, root)
    assert all(folders[k] == x for k, x in after.items() if k[1] > 8)  # days that stay whole aren't written again
    assert sum(retention.run(spark, root, RULES, SCHEMAS, NOW).values()) == 0 and held(spark, root) == want
    assert before == {k: sorted(x, key=repr) for k, x in rows.items()}


@pytest.mark.parametrize("fails_at", [1, 2, 3, 4])
def test_a_run_that_fails_halfway_changes_nothing_and_is_repeated(spark, tmp_path, monkeypatch, fails_at):
    root, rows = str(tmp_path), tables()
    put(spark, root, rows)
    before, whole, calls = held(spark, root), retention._written, []

    def fails(*args):
        calls.append(args)
        out = whole(*args)
        if len(calls) == fails_at:
            raise OSError("lost")
        return out

    monkeypatch.setattr(retention, "_written", fails)
    with pytest.raises(OSError):
        retention.run(spark, root, RULES, SCHEMAS, NOW)
    assert held(spark, root) == before
    monkeypatch.setattr(retention, "_written", whole)
    retention.run(spark, root, RULES, SCHEMAS, NOW)
    assert held(spark, root) == wanted(rows)


def test_empty_tables(spark, tmp_path):
    root = str(tmp_path)
    assert retention.version(spark, root) == 0 and retention.run(spark, root, RULES, SCHEMAS, NOW) == dict.fromkeys(RULES, 0)
    assert held(spark, root) == {k: [] for k in SCHEMAS}

"""Manifests of cases, their tree and its verification, and a full store."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from kerbline.operators import stretches
from kerbline.sources import cases

SCHEMA = "case_id long, t double, role string, path string, content binary"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def rows(n):
    return [(c, float(c), role, f"{c}/{role}", f"{c}-{role}".encode()) for c in range(n) for role in cases.ROLES[: c % 5 + 1]]


def plain_tree(made, digits):
    nodes = {}
    for case, h in sorted((str(r.case_id), r.manifest_sha256) for r in made):
        nodes.setdefault(sha(case)[:digits], []).append(f"{case} {h}")
    out, level = {}, {p: sha("\n".join(x)) for p, x in nodes.items()}
    for n in range(digits - 1, -2, -1):
        out |= level
        up = {}
        for p in sorted(level):
            up.setdefault(p[: max(n, 0)], []).append(f"{p} {level[p]}")
        level = {p: sha("\n".join(x)) for p, x in up.items()}
    return out


def test_manifests_tree_and_what_changed(spark, tmp_path):
    files = spark.createDataFrame([*rows(60), (3, 3.0, "poster", "3/poster", b"x"), (4, 4.0, "plate", "4/z", b"later"), (99, 9.0, "plate", "99/p", None)], SCHEMA)
    cases.written(files, str(tmp_path / "e"), 2)
    stored, made, tree = cases.read(spark, str(tmp_path / "e"))
    listed = {r.case_id: r for r in made.collect()}
    assert set(listed) == set(range(60)) and stored.count() == files.count()
    for c, r in listed.items():
        assert r.manifest_sha256 == sha(r.manifest)
        assert json.loads(r.manifest) == {"case_id": c, "files": [{"role": x, "path": f"{c}/{x}", "sha256": sha(f"{c}-{x}"), "bytes": len(f"{c}-{x}")} for x in cases.ROLES[: c % 5 + 1]]}
    found = {r.prefix: (r.sha256, r.cases) for r in tree.collect()}
    assert {p: h for p, (h, _) in found.items()} == plain_tree(listed.values(), 2) and found[""][1] == 60
    other = made.withColumn("manifest_sha256", F.when(F.col("case_id") == 7, F.sha2(F.lit("x"), 256)).otherwise(F.col("manifest_sha256")))
    assert sorted(r.prefix for r in cases.changed_nodes(tree, cases.tree(other, 2)).collect()) == ["", sha("7")[:1], sha("7")[:2]]
    assert cases.tree(made.limit(0)).count() == 0 and cases.changed_nodes(tree, cases.tree(made, 2)).count() == 0


def test_faults_are_told_apart(spark):
    files = spark.createDataFrame(rows(10), SCHEMA)
    recorded = cases.manifests(files)
    stored = recorded.where("case_id <> 2").withColumn("manifest", F.when(F.col("case_id") == 3, F.lit("{}")).otherwise(F.col("manifest")))
    now = files.where("path <> '4/plate'").withColumn("content", F.when(F.col("path") == "6/plate", F.lit(b"other")).otherwise(F.col("content")))
    now = now.unionByName(spark.createDataFrame([(0, 0.0, "after", "0/after", b"new"), (77, 0.0, "plate", "77/plate", b"new")], SCHEMA))
    found = {(r.case_id, r.role): (r.state, r.manifest_state) for r in cases.verified(recorded, stored, now).collect()}
    assert len(found) == len(rows(10)) + 2
    odd = {k: v for k, v in found.items() if v != ("ok", "ok")}
    assert odd == {(4, "plate"): ("missing", "ok"), (6, "plate"): ("changed", "ok"), (0, "after"): ("unlisted", "ok"), (77, "plate"): ("unlisted", "unlisted")} | {(2, x): ("ok", "missing") for x in cases.ROLES[:3]} | {(3, x): ("ok", "changed") for x in cases.ROLES[:4]}
    valid = {r.case_id for r in cases.verdicts(cases.verified(recorded, stored, now)).collect() if r.valid}
    assert valid == {1, 5, 7, 8, 9}
    forged = recorded.withColumn("manifest", F.when(F.col("case_id") == 1, F.regexp_replace("manifest", "1/plate", "1/other")).otherwise(F.col("manifest")))
    assert {r.case_id for r in cases.verified(forged, forged, files).where("manifest_state <> 'ok'").collect()} == {1}


def test_a_full_store_takes_no_more_cases(spark):
    files = spark.createDataFrame([(c, 5000.0 * (9 - c), "plate", f"{c}", bytes(10)) for c in range(10)] + [(4, 0.0, "after", "4b", None)], SCHEMA)
    kept = lambda most, used=0: sorted(r.case_id for r in cases.within_limit(files, most, used).collect())
    # In order of time cases 9, 8, ... are begun while less than the limit is used.
    assert kept(25) == [7, 8, 9] and kept(30) == [7, 8, 9] and kept(30, 25) == [9] and kept(0) == [] and kept(1000) == list(range(10))


def test_running_sums_by_stretches(spark):
    rng = random.Random(2)
    rows = [(i, float(rng.randrange(30_000)), "ab"[i % 2], rng.choice([None, 1, 5, 9])) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, t double, k string, x long")
    for keys in ([], ["k"]):
        for r in stretches.running(df, keys, "x", "s").collect():
            assert r.s == sum(x or 0 for i, t, k, x in rows if (t, i) <= (r.t, r.event_id) and (not keys or k == r.k))

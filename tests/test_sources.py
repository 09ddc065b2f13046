"""Settings, change logs, vectors as texts, evidence."""

from kerbline.sources import changes, settings


def test_settings_merge_and_are_checked():
    base = {"rules": {"ratio": 1.8, "least": 8, "on": True}, "name": "a"}
    assert settings.merged(base, {"rules": {"least": 9}}) == {"rules": {"ratio": 1.8, "least": 9, "on": True}, "name": "a"}
    bad = {"rules": {"ratio": 1.5, "least": -1, "on": 1, "odd": 2}, "name": 3}
    assert settings.faults(bad, base, frozenset({"rules.ratio"})) == ["rules.ratio: above one", "rules.least: below zero", "rules.on: bool is needed", "rules.odd: unknown", "name: str is needed"]
    assert settings.faults({"rules": 3}, base) == ["rules: a section is needed"] and not settings.faults({"rules": {"least": 1}}, base)
    assert settings.out_of_order({"a": 1, "b": 1, "c": 2}, ["a", "b", "c"]) == ["a must be below b"]
    rights = {"admin": {"plates:raw"}, "viewer": set()}
    assert [settings.sees_plates(r, rights, m) for r, m in (("admin", set()), ("admin", {"admin"}), ("viewer", set()))] == [True, False, False]


def test_changes_are_read_as_the_newest(spark):
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", None), (2, 1, "c", False), (2, 5, "c", True), (3, 1, None, False)], "id int, n int, v string, deleted boolean")
    assert sorted((r.id, r.v) for r in changes.current(log, ["id"], ["n"]).collect()) == [(1, "b"), (3, None)]
    gone = spark.createDataFrame([(1,)], "id int")
    assert sorted(r.id for r in changes.cascaded(gone, log.select("id"), ["id"]).collect()) == [2, 2, 3]

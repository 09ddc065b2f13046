"""Identities are found without repeated folds, and scores are worked out once."""

from kerbline.operators import graph, identity
from kerbline.plans import travel as plans
from kerbline.sources import tables as T

SIGHTING = "event_id long, scope boolean, t double, camera_id string, plate string, confidence double, vehicle_class string, colour string, embedding array<float>, embedding_model string"
EDGE = "from_id string, to_id string, distance_m double, min_travel_s double, typical_travel_s double, allowed boolean"


def test_folds_are_not_repeated_for_what_is_guessed(spark, monkeypatch):
    """Each day a vehicle is read rightly and then with one confusable character; so next day its last sighting has another plate."""
    rows = [(2 * d + m, True, 86_400.0 * d + 100 * m, "ab"[m], ("UP32AB1118", "UP32AB1113")[m], (0.9, 0.7)[m], "car", ("red", "white")[d % 2], [1.0, 0.1 * (d % 3)], "deep") for d in range(12) for m in (0, 1)]
    obs = spark.createDataFrame(rows, SIGHTING)
    ring = spark.createDataFrame([("a", "b", 10.0, 10.0, 30.0, True), ("b", "a", 10.0, 10.0, 30.0, True)], EDGE)
    ways = identity.cut(identity.ways(graph.shortest_paths(ring), spark.createDataFrame([], "from_id string, to_id string, seconds double")))
    told, rounds = identity._told, []
    monkeypatch.setattr(identity, "_told", lambda *a: rounds.append(1) or told(*a))
    found = []
    for guess in (None, identity.guesses(ways, T.GAP_S), lambda e, p: (0.99, True)):
        rounds.clear()
        vehicles, scored = identity.resolved(obs, lambda pairs: identity.scored(pairs, ways, gap_s=T.GAP_S), guess=guess)
        found.append(({tuple(r) for r in vehicles.collect()}, {(r.event_id, r.p_event_id, r.score) for r in scored.collect()}, len(rounds)))
    assert found[0][:2] == found[1][:2] == found[2][:2]  # a wrong guess changes nothing either
    assert found[1][2] == 1 < min(found[0][2], found[2][2])


def test_a_filter_on_scores_copies_none(spark, small):
    obs = plans._identity_rows(spark, small)
    ways = spark.createDataFrame([], "p_camera_id string, camera_id string, hops int, n_skipped int, min_travel_s double, expected_s double")
    pairs = identity.scored(identity.candidates(obs), ways)
    size = lambda df: len(df.select("event_id", "p_event_id", "score", "rejected")._jdf.queryExecution().optimizedPlan().toString())
    assert size(pairs.where("rejected is null and score >= 0.62")) < 1.5 * size(pairs)

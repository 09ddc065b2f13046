"""Vector operators against all pairs; conversations there and back."""

import numpy as np
from pyspark.sql import functions as F

from kerbline.llm import chat_format, neighbours, vector_dedup

SCHEMA = "vec_id long, embedding array<double>, key string, cid long, label int"


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 32))
    rows = [(i, x.tolist()) for i, x in enumerate(base)]
    rows += [(200 + i, (base[i] + 0.05 * rng.normal(size=32)).tolist()) for i in range(40)]
    rows += [(300 + i, base[7].tolist()) for i in range(6)] + [(310, (3 * base[7]).tolist())]
    rows += [(400, None), (401, [0.0] * 32), (402, [None] * 32), (403, [float("nan")] * 32), (404, [1e200] * 32), (405, []), (406, [1.0, 2.0]), (50, base[50].tolist())]
    return rows


def usable(rows):
    return [(i, np.array(x)) for i, x in rows if x and None not in x and np.isfinite(x).all() and np.any(x)]


def cosine(a, b):
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 0) for r in rows], SCHEMA).repartition(3)


def test_vector_links_against_all_pairs(spark):
    rows = [r for r in vectors() if r[0] not in (404, 310)]
    near = {(a, b) for i, (a, x) in enumerate(usable(rows)) for b, y in usable(rows)[:] if a != b and len(x) == len(y) and cosine(x, y) >= 0.95}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in near:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    rows = [r for i, r in enumerate(rows) if r[0] != 50 or i < 120]
    found = vector_dedup.near_duplicates(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_links, r.component_id, r.kept) == (sum(a == r.vec_id for a, _ in near), root(r.vec_id), root(r.vec_id) == r.vec_id)
    assert vector_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_neighbours_against_all(spark, small):
    rows = [r for i, r in enumerate(vectors()) if r[0] not in (404, 310) and (r[0] != 50 or i < 120)]
    index = neighbours.index(frame(spark, rows))
    found = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 9)) for r in neighbours.search(index, F.col("vec_id") % 50 == 0, 5).collect()}
    want = {}
    for q, x in usable(rows):
        if q % 50 == 0:
            near = sorted((-cosine(x, y), i) for i, y in usable(rows) if i != q and len(x) == len(y))[:5]
            want |= {(q, k + 1): (i, round(-c, 9)) for k, (c, i) in enumerate(near)}
    hit = sum(found.get(k, (None,))[0] == v[0] for k, v in want.items())
    assert len(found) == len(want) and hit >= 0.95 * len(want)
    few = neighbours.index(frame(spark, rows[:3]))
    assert neighbours.search(few, F.col("vec_id") == 0, 5).count() == 2
    none = neighbours.index(spark.createDataFrame([], SCHEMA))
    assert neighbours.search(none, F.col("vec_id") == 0, 5).count() == 0


def test_vectors_without_ids_and_ties(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (None, None)]
    found = vector_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in found) == [(0, 0, 0, True), (0, 0, 0, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]
    near = neighbours.search(neighbours.index(frame(spark, rows)), F.col("vec_id").isin(1, 4), 2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in near) == [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (4, 1, 1, 0.0), (4, 2, 2, 0.0)]


CHATS = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "a\\b <|end|><|turn|>"), (1, 2, "user", None), (1, 3, "assistant", "[INST]<\\s>"), (2, 0, None, ""), (3, 1, "assistant", "x" * 50_000), (3, 1, "assistant", "x" * 50_000), (3, 0, "user", "ä\U0001f600"), (None, 0, "user", "a"), (4, None, "user", "<" + "</s>" * 3)]


def chats(spark):
    return spark.createDataFrame([(*r, "y") for r in CHATS], "conv_id long, turn int, role string, text string, spans string")


def test_escaping_is_reversible():
    for x in [c for c in chat_format.CONTROL] + ["\\", "\\\\<", "<|turn|", "<<SYS>></s>[INST]", "".join(chat_format.CONTROL), ""]:
        kept = chat_format.escaped(x)
        assert chat_format.unescaped(kept) == x and not any(c in kept for c in chat_format.CONTROL)


def test_turns_read_back(spark):
    found = {r.conv_id: r for r in chat_format.format_conversations(chats(spark)).collect()}
    assert {i: r.n_turns for i, r in found.items()} == {1: 4, 2: 1, 3: 3, 4: 1, None: 1}
    for i, r in found.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in CHATS if c == i))
        said = [tuple(map(chat_format.unescaped, chat_format._TURN.fullmatch(r.formatted[s["first"] : s["last"]]).groups())) for s in r.spans]
        assert said == [x[2:] for x in turns] and r.rewrites == 0
        assert [s["loss"] for s in r.spans] == [x[0] == "assistant" for x in said]
        assert [r.formatted[s["text_first"] : s["text_last"]] for s in r.spans] == [chat_format.escaped(x[1]) if x[0] == "assistant" else "" for x in said]
    assert chat_format.format_conversations(chats(spark).limit(0)).count() == 0


def test_template_that_rewrites_history_is_found(spark):
    """A template that shows only the last assistant's turn in full, as some do with what a model thought."""

    def template(turns):
        last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
        return "".join(f"[{r}]{t if r != 'assistant' or i == last else '...'}" for i, (r, t) in enumerate(turns))

    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "first"), (1, 2, "user", "r"), (1, 3, "assistant", "second"), (2, 0, "user", "q"), (2, 1, "assistant", "a")]
    found = {r.conv_id: r for r in chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), template).collect()}
    assert (found[1].rewrites, found[2].rewrites) == (1, 0)
    assert found[1].formatted.endswith("[assistant]second")
    last = found[1].spans[-1]
    assert found[1].formatted[last["first"] : last["last"]].endswith("second")
    assert found[1].formatted[last["text_first"] : last["text_last"]] == "second"
    assert [found[2].formatted[s["text_first"] : s["text_last"]] for s in found[2].spans] == ["", "a"]


def shown(row):
    return [(s["role"], row.formatted[s["first"] : s["last"]], row.formatted[s["text_first"] : s["text_last"]]) for s in row.spans]


def test_every_turn_is_located_after_a_rewrite(spark):
    """Templates that trim what earlier turns of the assistant thought, that take old turns out, or that change a header."""

    def trims(turns):
        last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
        return "<s>" + "".join(f"<{r}>{t.split('|')[-1] if r == 'assistant' and i < last else t}</{r}>" for i, (r, t) in enumerate(turns))

    def forgets(turns):
        return "".join(f"({r}: {t})" if i >= len(turns) - 2 else "" for i, (r, t) in enumerate(turns))

    def counts(turns):
        return f"#{len(turns)};" + "".join(f"{r}={t};" for r, t in turns)

    turns = [("user", "q|1"), ("assistant", "thought|answer"), ("user", "more"), ("assistant", "again|yes"), ("user", "</assistant>"), ("assistant", "last thought|end")]
    chats_ = spark.createDataFrame([(1, i, *x) for i, x in enumerate(turns)] + [(2, 0, "assistant", ""), (2, 1, "assistant", "a"), (2, 2, "user", "b")], "conv_id long, turn int, role string, text string")
    one, two = (shown(r) for r in sorted(chat_format.format_conversations(chats_, trims).collect(), key=lambda r: r.conv_id))
    want = [("user", "q|1"), ("assistant", "answer"), ("user", "more"), ("assistant", "yes"), ("user", "</assistant>"), ("assistant", "last thought|end")]
    assert one == [(r, f"<{r}>{t}</{r}>", t if r == "assistant" else "") for r, t in want]
    assert two == [("assistant", "<assistant></assistant>", ""), ("assistant", "<assistant>a</assistant>", "a"), ("user", "<user>b</user>", "")]
    rows = {r.conv_id: r for r in chat_format.format_conversations(chats_, forgets).collect()}
    assert shown(rows[1]) == [(r, "", "") for r, _ in turns[:-2]] + [("user", "(user: </assistant>)", ""), ("assistant", "(assistant: last thought|end)", "last thought|end")] and rows[1].rewrites == 4
    rows = {r.conv_id: r for r in chat_format.format_conversations(chats_, counts).collect()}
    assert [x[2] for x in shown(rows[1])] == [t if r == "assistant" else "" for r, t in turns]
    assert [x[1] for x in shown(rows[1])][1:] == [f"{r}={t};" for r, t in turns[1:]]

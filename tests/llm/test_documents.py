"""Operators on documents against brute force, on the rows of ``cases`` and on the test tables."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import SCHEMA, documents, prose, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerbline.llm import lang_id, license_scan, lm_score, minhash, mixing, packing, token_counts
from kerbline.llm.tokens import vocabulary_paths

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def lower(x):
    return (x or "").translate({c: c + 32 for c in range(65, 91)})


def components(docs, k, least=0.8):
    sets, parent = {}, {}
    for i, text, *_ in docs:
        w = WORD.findall(lower(text))
        sets.setdefault(i, set()).add(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    ids = sorted(x for x in sets if x is not None)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and len(x & y) >= least * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_against_all_pairs(spark, k):
    found = minhash.near_duplicates(documents(spark, rows()), k=k).collect()
    want = components(rows(), k)
    assert len(found) == len(rows())
    for r in found:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    kept = minhash.deduplicated(documents(spark, rows()), k=k).collect()
    assert Counter(r.doc_id for r in kept) == Counter({i: 1 for i, c in want.items() if i == c} | {None: 2})


def test_minhash_finds_all_links_of_a_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = components([(r.doc_id, r.text) for r in docs.collect()], 5)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == want
    assert len(set(want.values())) < len(want)


def test_lm_score_against_counts(spark):
    docs = documents(spark, rows())
    found = {}
    for r in lm_score.score(docs, docs.doc_id % 5 != 1).collect():
        found.setdefault(r.doc_id, []).append(r)
    train, tokens = Counter(), lambda x: [*WORD.findall(lower(x)), None]
    for i, text, *_ in rows():
        if i is not None and i % 5 != 1:
            train.update(tokens(text))
    total, types = sum(train.values()), len(train)
    assert sum(map(len, found.values())) == len(rows())
    for i, text, *_ in rows():
        if i is None:
            continue
        want = sum(math.log10((train[t] + 0.5) / (total + 0.5 * (types + 1))) for t in tokens(text))
        for r in found[i]:
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens(text)), sum(train[t] > 0 for t in tokens(text)), total)
            assert r.base_score == pytest.approx(want)
    seen = [r for i, x in found.items() if i in range(20, 40) and i % 5 != 1 for r in x]
    assert all(r.score > r.base_score for r in seen)


def backoff_scores(texts, train):
    """log10 probabilities by the formulas of ``lm_score``, with dictionaries: texts and train by key."""
    tokens = {i: [*WORD.findall(lower(x)), "END"] for i, x in texts.items()}
    c = Counter()
    for i, w in tokens.items():
        if train[i]:
            w = ["START", *w]
            c.update((x,) for x in w[1:])
            c["START",] += 1
            c.update(zip(w, w[1:], strict=False))
            c.update(zip(w, w[1:], w[2:], strict=False))
    total, types = sum(n for k, n in c.items() if len(k) == 1 and k != ("START",)), sum(len(k) == 1 and k != ("START",) for k in c)
    once, n = Counter(), Counter()
    for k, m in c.items():
        if len(k) > 1:
            at = len(k), int(math.log2(c[k[:-1]])) + 1
            once[at] += m == 1
            n[at] += m
    share = {at: min(0.999, (once[at] + 0.5) / (n[at] + 1)) for at in n}

    def chance(h, w):
        if not h:
            return (c[w,] + 0.5) / (total + 0.5 * (types + 1))
        if not c[h]:
            return chance(h[1:], w)
        new = share.get((len(h) + 1, int(math.log2(c[h])) + 1), 0.5)
        return (1 - new) * c[*h, w] / c[h] + new * chance(h[1:], w)

    return {i: sum(math.log10(chance(tuple(["START", *w][max(0, j - 1) : j + 1]), x)) for j, x in enumerate(w)) for i, w in tokens.items()}


@pytest.mark.parametrize("block_chars", [1 << 40, 4_000])
def test_lm_score_against_dictionaries(spark, small, block_chars):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = backoff_scores(texts, {i: i % 5 != 1 for i in texts})
    found = {r.doc_id: r.score for r in lm_score.score(docs, docs.doc_id % 5 != 1, block_chars=block_chars).collect()}
    assert found == pytest.approx(want, rel=1e-9)
    odd = [r for r in rows() if r[0] is not None]
    keyed = {j: t for j, (_, t, *_) in enumerate(odd)}
    want = backoff_scores(keyed, {j: r[0] % 5 != 1 for j, r in enumerate(odd)})
    docs = documents(spark, odd)
    found = Counter((r.doc_id, round(r.score, 6)) for r in lm_score.score(docs, docs.doc_id % 5 != 1, block_chars=block_chars).collect())
    assert found == Counter((odd[j][0], round(x, 6)) for j, x in want.items())


def test_lm_blocks_dont_change_scores(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one, many = ({r.doc_id: round(r.score, 6) for r in lm_score.score(docs, docs.doc_id % 5 != 1, block_chars=b).collect()} for b in (1 << 40, 30_000))
    assert one == many


def test_lm_probabilities_sum_to_one(spark):
    """The chances of all texts of one known word, of the empty text and of one unknown word don't exceed one."""
    texts = ["a b a c", "a b b", "c a b", "b"]
    asked = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)] + [(100 + i, w, "en", "a") for i, w in enumerate(["a", "b", "c", "unknown", ""])])
    got = {r.doc_id: r.score for r in lm_score.score(asked, asked.doc_id < 100).collect()}
    assert all(x < 0 for x in got.values())
    assert 0.1 < sum(10 ** got[100 + i] for i in range(5)) < 1


def test_language_held_out_accuracy(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").where("lang is not null and text is not null")
    model = lang_id.fit(docs.where("doc_id % 4 <> 2"))
    held = {r.doc_id: r.lang for r in docs.where("doc_id % 4 = 2").collect()}
    found = lang_id.predict(docs.where("doc_id % 4 = 2"), model).collect()
    good = sum(held[r.doc_id] == r.lang_pred for r in found)
    assert good >= 0.95 * len(held)
    assert sum(r.rejected for r in found) <= 0.02 * len(held)


class Neys:
    """An interpolated Kneser-Ney character model of one language, by dictionaries of runs."""

    def __init__(self, texts, order, discount):
        self.order, self.d = order, discount
        self.n = {order: Counter()}
        for p in map(lang_id.letters_of, texts):
            self.n[order].update(tuple(p[i : i + order].tolist()) for i in range(len(p) - order + 1))
        for k in range(order - 1, 0, -1):
            self.n[k] = Counter(g[1:] for g in self.n[k + 1])
        self.sum = {k: Counter() for k in self.n}
        self.types = {k: Counter() for k in self.n}
        for k, own in self.n.items():
            for g, m in own.items():
                self.sum[k][g[:-1]] += m
                self.types[k][g[:-1]] += 1

    def chance(self, g, characters):
        k = len(g)
        total = self.sum[k][g[:-1]]
        if k == 1:
            return max(self.n[1][g] - self.d, 0) / total + self.d * len(self.n[1]) / total / (characters + 1)
        lower = self.chance(g[1:], characters)
        if not total:
            return lower
        return max(self.n[k][g] - self.d, 0) / total + self.d * self.types[k][g[:-1]] / total * lower

    def entropy(self, text, characters):
        p = tuple(lang_id.letters_of(text).tolist())
        runs = [p[max(0, i + 1 - self.order) : i + 1] for i in range(1, len(p))]
        return -sum(math.log(self.chance(g, characters)) for g in runs) / len(runs)


def test_language_models_against_dictionaries(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(lang_id.CALIBRATE))
    taught = docs.where("lang is not null and text is not null").where(F.length("text") <= lang_id.SAMPLE_CHARS).withColumn("fold", fold).where("fold <> 0").collect()
    models = {lang: Neys([r.text for r in taught if r.lang == lang], lang_id.ORDER, lang_id.DISCOUNT) for lang in {r.lang for r in taught}}
    characters = len({g for m in models.values() for g in m.n[1]})
    model, odd = lang_id.fit(docs), ["ab", "xyzzy \u0531\u0574", "the", "Die Straße, 1234!"]
    for text in odd + [r.text for r in docs.where("text is not null").orderBy("doc_id").limit(60).collect()]:
        found = model.predict(text[:3000])
        if found[2] is not None:
            want = {lang: m.entropy(text[:3000], characters) for lang, m in models.items()}
            assert found[2] == pytest.approx(min(want.values()), rel=2e-4)
            n = min(len(lang_id.letters_of(text[:3000])) - 1, lang_id.EVIDENCE)
            assert found[1] == pytest.approx(1 / sum(math.exp((min(want.values()) - x) * n) for x in want.values()), abs=2e-2)


def test_language_of_odd_texts(spark):
    model = lang_id.fit(documents(spark, rows()))
    found = {}
    for r in lang_id.predict(documents(spark, rows()), model).collect():
        found.setdefault(r.doc_id, r)
        assert 0 <= r.score <= 1
    assert [found[i].lang_pred for i in (5, 6, 7)] == ["und"] * 3 and found[11].lang_pred in ("en", "de")
    nothing = lang_id.fit(spark.createDataFrame([], SCHEMA))
    assert {r.lang_pred for r in lang_id.predict(documents(spark, rows()), nothing).collect()} == {"und"}
    assert lang_id.accepted(documents(spark, rows()), model).columns == documents(spark, rows()).columns


def test_unseen_script_is_rejected_with_few_rows(spark, small, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").where("lang is not null and text is not null")
    rare = docs.groupBy("lang").count().orderBy("lang").first().lang
    ids = [r.doc_id for r in docs.where(docs.lang == rare).orderBy("doc_id").limit(15).collect()]
    one_rare = docs.where((docs.lang != rare) | docs.doc_id.isin(ids))
    unseen = " ".join(["\u0531\u0574\u0565\u0576 \u0570\u0561\u0580\u0581 \u057a\u0561\u057f\u0561\u057d\u056d\u0561\u0576"] * 12)
    for table in (one_rare, spark.read.parquet(f"{small}/documents.parquet")):
        model = lang_id.fit(table)
        assert np.isfinite(model.limit).all() and model.predict(unseen)[3]
        # Held-out texts of every language are kept, those of the rare one too where they are told apart.
        found = [model.predict(r.text) for r in docs.where(~docs.doc_id.isin(ids)).orderBy("doc_id").limit(400).collect()]
        assert sum(x[3] for x in found) <= 0.02 * len(found)


LICENCE = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_licence_places_against_search(spark):
    texts = [None, "", "CC-BY cc by, all rights reserved.", "the GNU General Public License!", "cc  b", "xcc by", "reserved", license_scan.TEMPLATES["mit"], "cc by cc by", "All Rights\nReserved all rights reserved"]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    for r in license_scan.scan(docs).collect():
        words = LICENCE.findall((texts[r.doc_id] or "").encode().lower())
        places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.encode().split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert "mit" in {r.doc_id: r.labels for r in license_scan.scan(docs).collect()}[7]


def test_licences_of_odd_rows(spark):
    long = " ".join(["x y z"] * 60_000) + " CC BY " + license_scan.TEMPLATES["mit"]
    odd = [*rows(), (90, long, None, None), (90, long, None, None)]
    found = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, "mit" in r.labels) for r in license_scan.scan(documents(spark, odd)).collect())
    words = lambda t: len(LICENCE.findall((t or "").encode().lower()))
    assert found == Counter((i, words(t), *((1, 180_000, 180_000, True) if i == 90 else (0, None, None, False))) for i, t, *_ in odd)


def test_matching_statistics_against_search():
    rng = np.random.default_rng(3)
    texts = {str(i): [b"abc"[j : j + 1] for j in rng.integers(0, 3, 12)] for i in range(4)}
    auto = license_scan.Automaton(texts)
    words = [b"abcd"[j : j + 1] for j in rng.integers(0, 4, 200)]
    runs = {tuple(t[i:j]) for t in texts.values() for i in range(12) for j in range(i + 1, 13)}
    want = {i: max((n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in runs), default=0) for i in range(200)}
    assert {i: n for i, _, n in auto.matching(words)} == {i: n for i, n in want.items() if n}


def test_licence_templates_are_found_as_if_each_stood_alone(spark):
    short = "licensed under the apache license version 2 0 the text of which is elsewhere"
    assert [(r.labels, r.score) for r in license_scan.scan(documents(spark, [(1, short, "en", "a")])).collect()] == [("apache-2.0-short", 1.0)]
    rng = np.random.default_rng(5)
    base = [str(x) for x in rng.integers(0, 9, 40)]
    texts = {f"t{i}": " ".join(base[a : a + n]) for i, (a, n) in enumerate(zip(rng.integers(0, 25, 8), rng.integers(5, 16, 8), strict=True))}
    texts["prefix"], texts["inner"] = " ".join(base[:7]), " ".join(base[9:16])
    args = (license_scan.LEAST_RUN, license_scan.MOST_GAP, license_scan.LEAST_COVER)
    together, alone = license_scan.Scanner({}, texts, *args), {k: license_scan.Scanner({}, {k: v}, *args) for k, v in texts.items()}
    hits = 0
    for _ in range(300):
        parts = [base[a : a + n] if rng.random() < 0.8 else [str(x) for x in rng.integers(0, 9, 3)] for a, n in zip(rng.integers(0, 30, 4), rng.integers(1, 20, 4), strict=True)]
        text = " ".join(x for part in parts for x in part)
        want = sorted((x for k in alone for x in alone[k].scan(text)[2]), key=lambda x: (x[1], x[0]))
        assert together.scan(text)[2] == want
        hits += len(want)
    assert hits > 300


def json_ids(text):
    """Ids by the tokenizer's JSON file itself, not by the library's faster way."""
    return JSON.encode(text or "", add_special_tokens=False).ids


JSON = Tokenizer.from_file(vocabulary_paths()[0])


def check_packing(found, texts):
    ids = {i: [*json_ids(t), 0] for i, t in texts.items()}
    groups = Counter((r.tier, r.step_group) for r in found if r.offset == 0)
    for tier in {t for t, _ in groups}:
        own = [groups[tier, g] for g in sorted(g for t, g in groups if t == tier)]
        assert all(n == packing.STEP_TOKENS // tier for n in own[:-1]) and own[-1] <= packing.STEP_TOKENS // tier
    pieces, windows = {}, {}
    for r in found:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in ids.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(own)
    padded = 0
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    return padded / max(1, sum(map(len, ids.values())))


def test_packing_round_trip(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert check_packing(packing.pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()}) < 0.01
    odd = {i: t for i, t, *_ in rows() if i is not None and i != 8}
    check_packing(packing.pack(documents(spark, [(i, t, "en", "a") for i, t in odd.items()])).collect(), odd)
    assert packing.pack(documents(spark, rows())).selectExpr("sum(length)").first()[0] == sum(len(json_ids(t)) + 1 for _, t, *_ in rows())


def test_token_counts_across_blocks(spark, tmp_path):
    docs = documents(spark, rows())
    found = Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs).collect())
    assert found == Counter((i, len(json_ids(t))) for i, t, *_ in rows())
    token_counts.write_flat(docs, str(tmp_path / "flat"))
    large, tiny = (Counter((r.file, r.ordinal, r.n_tokens) for r in token_counts.scan(spark, str(tmp_path / "flat"), block=b).collect()) for b in (1 << 18, 3))
    assert large == tiny and sum(large.values()) == len(rows())


def test_mix_near_targets_and_flow(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    found = mixing.mix_documents(docs).collect()
    assert len(found) == docs.count()
    taken, target, largest = Counter(), {}, Counter()
    for r in found:
        assert r.size >= 0 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix_documents(docs.repartition(7)).collect()))
    # Overlapping sources: both quotas are met only if the shared pattern gives way.
    out = mixing.routed({("a",): 100.0, ("a", "b"): 100.0, ("b",): 10.0}, {"a": 150.0, "b": 60.0}, 2)
    assert sum(out.values()) == pytest.approx(210) and all(out[p] <= 2 * n for p, n in {("a",): 100, ("a", "b"): 100, ("b",): 10}.items())


def met_at_most(patterns, target, epochs):
    """Words that can reach the targets at most, by augmenting paths over patterns and sources."""
    room, need, flow, met = {p: epochs * n for p, n in patterns.items()}, dict(target), Counter(), 0
    while True:
        came, queue, end = {}, [("p", p) for p in patterns if room[p] > 1e-9], None
        came = dict.fromkeys(queue)
        while queue and end is None:
            kind, x = queue.pop(0)
            for y in x if kind == "p" else [p for p in patterns if flow[p, x] > 1e-9]:
                step = ("s" if kind == "p" else "p", y)
                if step not in came:
                    came[step] = (kind, x)
                    queue.append(step)
                    if step[0] == "s" and need[y] > 1e-9:
                        end = step
                        break
        if end is None:
            return met
        way = [end]
        while came[way[-1]] is not None:
            way.append(came[way[-1]])
        way.reverse()
        amount = min([room[way[0][1]], need[end[1]], *(flow[b[1], a[1]] for a, b in zip(way, way[1:], strict=False) if a[0] == "s")])
        for a, b in zip(way, way[1:], strict=False):
            flow[(a[1], b[1]) if a[0] == "p" else (b[1], a[1])] += amount if a[0] == "p" else -amount
        room[way[0][1]] -= amount
        need[end[1]] -= amount
        met += amount


def test_flow_meets_as_much_as_can_be_met():
    rng = np.random.default_rng(8)
    for _ in range(60):
        names = "abcde"[: rng.integers(2, 6)]
        patterns = {tuple(sorted(set(rng.choice(list(names), rng.integers(1, 4))))): float(rng.integers(1, 100)) for _ in range(6)}
        target = {s: float(rng.integers(0, 150)) for s in {s for p in patterns for s in p}}
        out = mixing.routed(patterns, target, 2)
        assert sum(out.values()) == pytest.approx(met_at_most(patterns, target, 2), abs=1e-3)
        assert all(-1e-6 <= out[p] <= 2 * n + 1e-6 for p, n in patterns.items())


def test_flow_costs_as_little_as_can_be():
    """Words of second epochs, against all ways to take whole words of small patterns."""
    rng = np.random.default_rng(3)
    for _ in range(25):
        names = "abc"[: rng.integers(2, 4)]
        patterns = {tuple(sorted(set(rng.choice(list(names), rng.integers(1, 3))))): float(rng.integers(1, 4)) for _ in range(3)}
        target = {s: float(rng.integers(0, 6)) for s in {s for p in patterns for s in p}}
        most, least = met_at_most(patterns, target, 2), None
        for taken in itertools.product(*[range(int(2 * n) + 1) for n in patterns.values()]):
            cost = sum(max(0, x - n) for x, n in zip(taken, patterns.values(), strict=True))
            if sum(taken) == most and (least is None or cost < least) and met_at_most(dict(zip(patterns, map(float, taken), strict=True)), target, 1) == pytest.approx(most):
                least = cost
        out = mixing.routed(patterns, target, 2)
        assert sum(max(0.0, out[p] - n) for p, n in patterns.items()) == pytest.approx(least, abs=1e-6)


def test_the_flow_decides_what_is_taken_of_single_sources_too(spark):
    """With the share of what a flow of one epoch can carry, no row is taken twice, whatever the targets."""
    docs = documents(spark, [(i, prose(i, 30), "en", f"s{i % 3}") for i in range(60)])
    plan = mixing._routes(spark.createDataFrame([(1, ["a"], 100, "a", 100, 150.0), (2, ["b"], 100, "b", 100, 40.0), (2, ["b", "c"], 50, "b", 100, 40.0), (2, ["b", "c"], 50, "c", 50, 90.0)], "_group long, _sources array<string>, _n long, source string, size long, target double"), 2).collect()
    want = mixing.routed({("a",): 100.0, ("b",): 100.0, ("b", "c"): 50.0}, {"a": 150.0, "b": 40.0, "c": 90.0}, 2)
    assert {tuple(r._sources): r._taken for r in plan} == want
    once = mixing.mix_documents(docs, epochs=1).collect()
    assert all(r.taken in (0, r.size) for r in once) and sum(r.taken for r in once) == sum(r.size for r in once)


def test_mix_of_null_ids_and_of_one_key(spark):
    data = [(None, prose(i, 20), "en", "a") for i in range(30)] + [(7, prose(99, 20), "en", "b")] * 30 + [(i, prose(i, 20), "en", "c") for i in range(100, 130)]
    found = mixing.mix_documents(documents(spark, data)).collect()
    assert len(found) == 90 and all(r.taken <= 2 * r.size for r in found)
    for of in ((None, "a"), (7, "b")):
        assert len({r.taken for r in found if (r.doc_id, r.source) == of}) == 1


def test_mix_of_overlapping_and_of_many_sources(spark):
    made = spark.range(4000).select(F.col("id").alias("doc_id"), F.array_distinct(F.when(F.col("id") % 5 < 2, F.array(F.lit("a"), F.lit("b"))).when(F.col("id") % 5 == 2, F.array(F.lit("b"))).otherwise(F.array(F.concat(F.lit("h"), (F.col("id") % 900).cast("string"))))).alias("of"))
    found = mixing.mix(made, F.col("of"), F.lit(10), F.col("doc_id").cast("string")).collect()
    assert len(found) == 4000
    size, patterns = Counter(), Counter()
    for r in found:
        patterns[tuple(r.sources)] += 10
        for s in r.sources:
            size[s] += 10
    order = sorted(size)
    weight, left, open_, want = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(size.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= 2 * size[s]}
        want |= {s: 2.0 * size[s] if s in full else unit * weight[s] for s in (full or open_)}
        left, open_ = left - sum(want[s] for s in full), open_ - full if full else set()
    taken = Counter()
    for r in found:
        assert r.target == pytest.approx(sum(want[s] for s in r.sources)) and r.taken in (0, 10, 20)
        taken[tuple(r.sources)] += r.taken
    assert all(abs(taken[p] - want[p[0]]) <= 10 for p in patterns if p[0].startswith("h"))
    tied = {p: float(n) for p, n in patterns.items() if p[0] in "ab"}
    assert sum(taken[p] for p in tied) == pytest.approx(met_at_most(tied, {s: want[s] for s in "ab"}, 2), abs=10)


def test_mix_of_odd_rows(spark):
    found = mixing.mix_documents(documents(spark, rows())).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, *_ in rows())
    assert all(r.taken == 0 for r in found if r.size == 0)


@pytest.mark.parametrize("run", [lambda d: minhash.near_duplicates(d), lambda d: lm_score.score(d, d.doc_id > 0), lambda d: license_scan.scan(d), lambda d: packing.pack(d), lambda d: mixing.mix_documents(d), lambda d: token_counts.token_counts(d), lambda d: mixing.mixed_rows(d), lambda d: minhash.deduplicated(d)])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0

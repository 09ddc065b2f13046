"""Secret spans, importance resampling and centroids against plain Python over odd rows and made-up ones."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import SCHEMA, documents, prose, rows

from kerbline.llm import centroids, importance, secret_scan


def secret_rows():
    hexes = "0123456789abcdef" * 3
    key = "-----BEGIN RSA PRIVATE KEY-----"
    texts = [
        'token = "f33e61083db5dbdf4bd2369d2f"', "PassWd:'abcdefgh' apikey=short API_KEY := x", "Secret: aaaabbbb token:ccccdddd", f"x{hexes}y {hexes[:31]}g AKIA{'Z9' * 8} AKIA1 AKIAKIAAKIAAAAAA",
        f"é \U0001f600 {key} ß ghp_{'a1' * 18} ghx_{'a1' * 18} xoxb-12345678901 toKen = aaaaaaaaaa", "https://user:pa55@host/ ftp://user@host http://a:b c@d", " Bearer  " + "a.b" * 9, "passwordsecret=token=api_key=abcdefghij", "AKIA" + "B" * 20 + "AKIA" + "C" * 12,
        "tok", "en=abcdefgh1", "\0password:\x20\x20\x20" + "x" * 9, "a" * 31 + " " + "a" * 32, prose(3, 60_000) + " secret=" + "q" * 10, f"{'zq ' * 50}AIza{'b' * 35}", "sk_live_" + "a" * 16,
    ]
    return [(100 + i, x, "en", "a") for i, x in enumerate(texts)] + rows()


def test_secrets_equal_a_search_of_every_text_by_every_rule(spark):
    data = secret_rows()
    found = [(r.doc_id, [tuple(x) for x in r.spans]) for r in secret_scan.scan(documents(spark, data)).collect()]
    order = {r.kind: i for i, r in enumerate(secret_scan.RULES)}

    def plain(text):
        out = []
        for rule in secret_scan.RULES:
            for m in re.finditer(rule.pattern, text or "", re.ASCII | (re.I if rule.either_case else 0)):
                if len(m[rule.group]) >= rule.least:
                    out.append((rule.kind, *m.span()))
        return sorted(out, key=lambda x: (x[1], order[x[0]]))

    want = [(d, plain(t)) for d, t, *_ in data]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert {k for _, spans in found for k, *_ in spans} == set(order)


def test_base_kinds_stand_where_their_whole_patterns_say():
    """A run of hexadecimal digits is one match, so that the bound in the regex is that on the match."""
    text = "".join(random.Random(1).choice("0af ") for _ in range(20_000)).replace(" ", "g", 3) + "f" * 40
    hexes = next(r for r in secret_scan.RULES if r.kind == "hex")
    assert list(hexes.spans(text)) == [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def test_a_match_fulfils_its_trigram_query():
    cases = {
        r"(abc|abd)x?[yz]+q": ["abczq", "abdxyzyq", "abcxyq"], r"foo.*bar": ["foobar", "foo--bar"], r"ab{3}c": ["abbbc"], r"(?:hello|hi) world": ["hello world", "hi world"], r"[abc]d[ef]g": ["adeg", "cdfg"], r"x{2,}yz": ["xxyz", "xxxxyz"], r"^start|end$": ["start", "the end"],
        r"é+lan": ["élan"], r"ST[0-9]{2}A": ["ST12A"], r"a?b?c?": ["", "abc"], r"(abc){2,3}": ["abcabc"], r"[^a]bcd": ["zbcd"], r"(\w)\1\1xyz": ["aaaxyz"],
    }
    for pattern, matches in cases.items():
        query = secret_scan.trigram_query(pattern)
        for x in matches:
            assert re.search(pattern, x)
            data = f"--{x}--".encode().lower()
            assert any(all(t in data for t in alternative) for alternative in query), (pattern, x, query)
    assert secret_scan.trigram_query(r"foo.*bar") == {frozenset([b"foo", b"bar"])}
    assert secret_scan.trigram_query(r"[0-9a-f]{32,}") == secret_scan.ANY == secret_scan.trigram_query("ab")
    assert secret_scan.trigram_query(r"(abc|abd)e") == {frozenset([b"abc", b"bce"]), frozenset([b"abd", b"bde"])}


def test_the_index_gives_the_texts_that_hold_all_trigrams():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abAB") for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    queries = [frozenset([frozenset([b"aba", b"bab"]), frozenset([b"aaa"])]), secret_scan.ANY, frozenset([frozenset([b"zzz"])])]
    index = secret_scan.Index(queries)
    for part in (texts, [], texts[:1]):
        index.fill(part)
        for q in queries:
            assert index.candidates(q).tolist() == [i for i, x in enumerate(part) if any(all(t in x.lower() for t in a) for a in q)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, buckets=importance.BUCKETS):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(x.encode("utf-8", "surrogatepass")) % buckets for x in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]]


@pytest.mark.parametrize("chunk", [1, 64, 1 << 22])
def test_the_automaton_in_chunks_of_any_size(monkeypatch, chunk):
    monkeypatch.setattr(importance, "CHUNK", chunk)
    texts = [t for _, t, *_ in rows()] + ["", None, "a" * 300 + "É", "x", "y z", ""]
    column, found = pa.array(["gone", *texts, "gone"]).slice(1, len(texts)), {}
    for first, n, raw, offsets in importance._chunks(column):
        one, of_one, two, of_two = importance.features(raw, offsets, 1 << 31)
        for i in range(n):
            assert first + i not in found
            found[first + i] = one[of_one == i].tolist() + two[of_two == i].tolist()
    assert found == {i: plain_features(t, 1 << 31)[1] for i, t in enumerate(texts)}


def test_resampling_equals_plain_counts(spark):
    data = [*rows(), (50, "x" * 5000 + " É" * 30 + " Tail", "en", "a"), (51, "edge", "en", "a"), (52, "case", "en", "a"), (53, "A-Z:a_z`0{9", "en", "a")]
    target = spark.createDataFrame([(1, prose(2, 300)), (2, prose(33, 50) + " Case Ärger"), (3, None), (4, "")], "item_id long, text string")
    corpus, wanted = Counter(), Counter()
    for _, text, *_ in data:
        corpus.update(plain_features(text)[1])
    for r in target.collect():
        wanted.update(plain_features(r.text)[1])
    of_corpus, of_target, n = sum(corpus.values()), sum(wanted.values()), importance.BUCKETS
    out = []
    for doc_id, text, *_ in data:
        n_words, own = plain_features(text)
        gain = [math.floor(1000 * math.log((wanted[b] + 1) * (of_corpus + n) / ((corpus[b] + 1) * (of_target + n)))) for b in own]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    taken = able[: 25 * len(able) // 100]
    found = importance.resample(documents(spark, data), target).collect()
    assert sorted([tuple(r)[:4] for r in found], key=repr) == sorted([x[:4] for x in out], key=repr)
    assert [r.doc_id for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])] == [x[0] for x in taken]
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, len(taken) + 1))


def test_ranks_run_on_over_ranges_and_ties(spark):
    data = [(i % 7 if i % 3 else None, 30 if i % 4 else 3, i % 5) for i in range(4000)]
    found = importance.ranked(spark.createDataFrame(data, "doc_id long, n_words long, score long").repartition(9), 25, 20).collect()
    drawn = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    able = sorted(((i, n, s) for i, n, s in data if n >= 20), key=lambda x: (-x[2], x[0] is None, x[0] or 0))
    assert len(found) == 4000 and [r["rank"] for r in drawn] == list(range(1, 751))
    assert [(r.doc_id, r.n_words, r.score) for r in drawn] == able[:750]


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    target = spark.createDataFrame([], "text string")
    assert importance.resample(empty, target).collect() == [] and secret_scan.scan(empty).collect() == []
    assert centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    one = importance.resample(documents(spark, rows()), target).collect()
    assert len(one) == len(rows())


def lloyd(data, clusters, rounds, size):
    kept = [(i, [max(-centroids.MOST, min(centroids.MOST, math.floor(256 * c))) for c in x]) for i, x in data if x is not None and len(x) == size and all(c is not None and math.isfinite(c) for c in x)]
    key = lambda v: (hashlib.sha256(f"2:{'null' if v[0] is None else v[0]}".encode()).hexdigest(), v[1])
    means = [list(x) for _, x in sorted(kept, key=key)[:clusters]]
    apart = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for step in range(rounds + 1):
        placed = [min((apart(x, m), c) for c, m in enumerate(means)) for _, x in kept]
        if step < rounds:
            for c in range(len(means)):
                own = [x for (_, x), (_, d) in zip(kept, placed, strict=True) if d == c]
                means[c] = [sum(v) // len(own) for v in zip(*own, strict=True)] if own else means[c]
    by = Counter()
    for d, c in placed:
        by[c] += d
    return [(i, c, d, by[c], sum(by.values()), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, placed, strict=True)]


def vectors(seed, n, size):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    data = [(i, [float(np.float32(m + rng.gauss(0, 0.3) * (d < 3))) for d, m in enumerate(rng.choice(middles))]) for i in range(n)]
    odd = [(900, None), (901, [1.0] * (size - 1)), (902, [float("nan")] * size), (903, [1.0] * (size - 1) + [None]), (904, [float("inf")] + [0.0] * (size - 1)), (905, [0.0] * size), (3, data[5][1]), (None, data[6][1]), (906, [3e38] + [0.0] * (size - 1)), (907, [])]
    return data + odd + [(1000 + i, data[7][1]) for i in range(60)]


@pytest.mark.parametrize("n, clusters, size", [(300, 40, 64), (20, 200, 8), (200, 5, 8)])
def test_centroids_equal_plain_rounds(spark, n, clusters, size):
    data = vectors(n, n, size)
    df = spark.createDataFrame([(i, x, 1, "c") for i, x in data], "vec_id long, embedding array<float>, cluster int, x string").repartition(4)
    found = centroids.cluster(df, clusters=clusters, dimensions=size).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(lloyd([(i, x and [None if c is None else float(np.float32(c)) for c in x]) for i, x in data], clusters, 5, size), key=repr)


def test_partial_sums_abandon_no_nearest_centroid():
    rng = np.random.default_rng(4)
    x, means = rng.integers(-9, 9, (500, 16)), rng.integers(-9, 9, (30, 16))
    means[7] = means[3]
    full = ((x[:, None, :] - means[None]) ** 2).sum(axis=2)
    for step in (1, 5, 16):
        number, distance = centroids.nearest(x, means, rng.permutation(16), step)
        assert (number == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all() and 7 not in number

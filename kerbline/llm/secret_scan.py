"""Secret scan: a trigram inverted index rules texts out before any rule's regex runs.

Of each rule's regex a Boolean query over trigrams is derived, which every text with a match fulfils: an OR of ANDs. A
block of texts is indexed: of each trigram that a query names, the texts that hold it (without regard to the case of A-Z).
A rule's postings are intersected and united as its query says, and only the texts that are left are searched by the regex
itself. A rule whose regex has no trigram that a match must hold searches all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import product
from re import _constants as op
from re import _parser as regex_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kerbline.llm.shared import columns, text_batches

#: A query: alternatives, each a set of trigrams that a text must hold; ANY rules nothing out.
Query = frozenset[frozenset[bytes]]
ANY: Query = frozenset([frozenset()])
#: Strings or alternatives above these numbers aren't followed up: the query then rules out less.
MOST_STRINGS, MOST_ALTERNATIVES = 64, 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the matches of ``pattern`` whose ``group`` has ``least`` characters; ``either_case`` is for A-Z only."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    either_case: bool = False

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.either_case else 0))

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Leftmost matches that don't overlap, those of too few characters left out; in code points, the end exclusive."""
        for m in self.regex.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


#: The three base kinds. A run of hexadecimal digits is a match as a whole, so that its least length can stand in the regex.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8, either_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Published forms of other credentials.
FURTHER = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[opsur]_[A-Za-z0-9]+", least=40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]+", least=24),
    Rule("url_login", r"[a-z]{2,12}://[A-Za-z0-9._-]+:[^\x00-\x20/:@]+@"),
    Rule("bearer", r"\x20bearer\x20+([A-Za-z0-9._~+/=-]+)", group=1, least=20, either_case=True),
)
RULES = BASE + FURTHER


def _trigrams(x: bytes) -> frozenset[bytes]:
    return frozenset(x[i : i + 3] for i in range(len(x) - 2))


def _least(q: Query) -> Query:
    """Alternatives that another one implies are left out; too many rule nothing out."""
    kept = frozenset(a for a in q if not any(b < a for b in q))
    return kept if len(kept) <= MOST_ALTERNATIVES else ANY


def _both(a: Query, b: Query) -> Query:
    """Both must hold; where that makes too many alternatives, the first alone."""
    return a if len(a) * len(b) > MOST_ALTERNATIVES**2 else (made if (made := _least(frozenset(x | y for x in a for y in b))) != ANY else a)


@dataclass(frozen=True)
class Part:
    """What is known of the matches of a part of a regex: all of them where they are few, how they begin and end, and a query."""

    exact: frozenset[bytes] | None
    first: frozenset[bytes]
    last: frozenset[bytes]
    need: Query = ANY

    @staticmethod
    def of(strings: frozenset[bytes]) -> Part:
        return Part(strings, frozenset(x[:2] for x in strings), frozenset(x[-2:] for x in strings))

    def query(self) -> Query:
        return self.need if self.exact is None else _least(frozenset(map(_trigrams, self.exact)))

    def then(self, other: Part) -> Part:
        if self.exact is not None and other.exact is not None and len(self.exact) * len(other.exact) <= MOST_STRINGS:
            return Part.of(frozenset(a + b for a, b in product(self.exact, other.exact)))
        edge = _least(frozenset(_trigrams(a + b) for a, b in product(self.last, other.first)))
        first = frozenset((a + b)[:2] for a, b in product(self.exact, other.first)) if self.exact is not None else self.first
        last = frozenset((a + b)[-2:] for a, b in product(self.last, other.exact)) if other.exact is not None else other.last
        return Part(None, first, last, _both(_both(self.query(), other.query()), edge))

    def or_else(self, other: Part) -> Part:
        if self.exact is not None and other.exact is not None and len(self.exact | other.exact) <= MOST_STRINGS:
            return Part.of(self.exact | other.exact)
        return Part(None, self.first | other.first, self.last | other.last, _least(self.query() | other.query()))


EMPTY, UNKNOWN = Part.of(frozenset([b""])), Part(None, frozenset([b""]), frozenset([b""]))


def _chars(codes: set[int]) -> Part:
    """One of some characters, without regard to the case of A-Z; what else has a case stays open."""
    if len(codes) > 2 * MOST_STRINGS or any(c > 127 and chr(c).lower() != chr(c).upper() for c in codes):
        return UNKNOWN
    found = frozenset(chr(c).encode("utf-8", "surrogatepass").lower() for c in codes)
    return Part.of(found) if len(found) <= 12 else UNKNOWN


def _part(kind: object, value: object) -> Part:
    """Of one element of a parsed regex; elements that aren't known here can be anything."""
    if kind is op.LITERAL:
        return _chars({value})
    if kind is op.IN and all(k in (op.LITERAL, op.RANGE) for k, _ in value):
        return _chars({c for k, v in value for c in ([v] if k is op.LITERAL else range(v[0], min(v[1], v[0] + 300) + 1))})
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        return reduce(Part.or_else, map(_sequence, value[1]))
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return EMPTY
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, item = value
        one = _sequence(item)
        if (least, most) == (0, 1):
            return EMPTY.or_else(one)
        copies = reduce(Part.then, [one] * min(least, 3), EMPTY)
        return copies if least == most <= 3 else copies.then(UNKNOWN)
    return UNKNOWN


def _sequence(items: Sequence) -> Part:
    return reduce(Part.then, (_part(kind, value) for kind, value in items), EMPTY)


def trigram_query(pattern: str) -> Query:
    """A query that every text with a match fulfils, over lower-cased UTF-8; ANY where no trigram is sure."""
    return _sequence(regex_parser.parse(pattern, re.ASCII)).query()


class Index:
    """Inverted index of blocks of texts over the trigrams that queries name."""

    def __init__(self, queries: Sequence[Query]) -> None:
        self.slots = {t: i for i, t in enumerate(sorted({t for q in queries for a in q for t in a}))}
        self.slot_of = np.full(1 << 24, -1, np.int16)
        for t, i in self.slots.items():
            self.slot_of[int.from_bytes(t, "big")] = i

    def fill(self, texts: list[bytes]) -> None:
        """Postings of the given texts in place of those before: the numbers of texts by trigram, ascending."""
        ends = np.cumsum([len(x) for x in texts])
        raw = np.frombuffer(b"".join(texts).lower(), np.uint8).astype(np.int32)
        at = np.zeros(0, np.int64)
        if len(raw) > 2:
            slot = self.slot_of[raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]]
            at = np.flatnonzero(slot >= 0)
        text = np.searchsorted(ends, at, side="right")
        inside = at + 2 < ends[text]
        keys = np.unique(slot[at[inside]].astype(np.int64) * len(texts) + text[inside]) if len(at) else at
        self.n, self.postings = len(texts), keys % max(len(texts), 1)
        self.bounds = np.searchsorted(keys, np.arange(len(self.slots) + 1) * len(texts))

    def posting(self, trigram: bytes) -> np.ndarray:
        slot = self.slots[trigram]
        return self.postings[self.bounds[slot] : self.bounds[slot + 1]]

    def candidates(self, query: Query) -> np.ndarray:
        """Numbers of the texts that fulfil the query."""
        found = [np.arange(self.n)] if ANY == query else []
        for alternative in query if ANY != query else ():
            lists = sorted(map(self.posting, alternative), key=len)
            found.append(reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), lists))
        return np.unique(np.concatenate(found))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id and spans (kind, start, end) of each row of ``docs`` (doc_id, text), by start and then in the order of the rules.

    Places are code points of the whole text, the end exclusive; spans of one kind don't overlap, those of others may. Null
    and empty texts have no spans; null ids stay null, and repeated rows are scanned each. A block of texts is indexed at a
    time, a long text by itself; texts are never cut. Other columns of ``docs`` are ignored. At most 32,767 different
    trigrams can be asked for.
    """
    rules = tuple(rules)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        index = Index(queries)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found: list[list[tuple]] = [[] for _ in texts]
            for start, end in text_batches(texts):
                index.fill([x.encode("utf-8", "surrogatepass") if x else b"" for x in texts[start:end]])
                for order, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                    for i in index.candidates(query).tolist():
                        if text := texts[start + i]:
                            found[start + i] += [(a, order, b) for a, b in rule.spans(text)]
            spans = [[{"kind": rules[order].kind, "start": a, "end": b} for a, order, b in sorted(x)] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS)], ["doc_id", "spans"])

    kept = columns(docs, "doc_id", "text")
    return kept.mapInArrow(task, f"doc_id {dict(kept.dtypes)['doc_id']}, spans array<struct<kind: string, start: long, end: long>>")

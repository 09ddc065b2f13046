"""Registration plates: cleaning, template normalisation with recorded corrections, validity, weighted edit distance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# State codes, confusable characters, templates (L letter, D digit) in order of preference.
STATES = "AN AP AR AS BR CH CG DD DL DN GA GJ HR HP JK JH KA KL LA LD MP MH MN ML MZ NL OD OR PY PB RJ SK TN TS TR UP UK UA WB".split()
LETTER_TO_DIGIT = {"O": "0", "D": "0", "Q": "0", "U": "0", "I": "1", "L": "1", "J": "1", "Z": "2", "S": "5", "B": "8", "G": "6", "A": "4", "T": "7"}
DIGIT_TO_LETTER = {"0": "O", "1": "I", "2": "Z", "5": "S", "8": "B", "6": "G", "4": "A", "7": "T", "3": "B"}
STATE_REPAIR = {"0": "D", "O": "D", "Q": "O", "8": "B", "5": "S", "1": "L", "I": "L", "V": "U", "F": "P", "R": "P", "H": "N"}
CONFUSABLE = "0O 0D 0Q OD OQ 1I 1L 17 IL 5S 8B 2Z 6G 4A 7T 38 68 MN MH UV PR CG EF KX WV YV".split()
CONFUSED_COST = 0.35
TEMPLATES = [
    ("standard", "LLDDLLDDDD"), ("standard", "LLDDLDDDD"), ("standard", "LLDDLLLDDDD"), ("standard", "LLDDDDDD"), ("delhi", "LLDLLLDDDD"),
    ("delhi", "LLDLLDDDD"), ("standard", "LLDDLLDDD"), ("standard", "LLDDLDDD"), ("bharat", "DDLLDDDDLL"), ("bharat", "DDLLDDDDL"),
]
UNKNOWN_STATE_COST, NOT_DELHI_COST = 1.5, 3.0
STANDARD = "^([A-Z]{2})([0-9]{1,2})([A-Z]{0,3})([0-9]{3,4})$"
BHARAT = "^([0-9]{2})BH([0-9]{4})([A-Z]{1,2})$"


def clean(raw: Column) -> Column:
    """Letters and digits in upper case; a leading IND of a text of more than 8 characters goes."""
    kept = F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), "[^A-Za-z0-9]", ""))
    return F.when(kept.startswith("IND") & (F.length(kept) > 8), F.substring(kept, 4, 1 << 20)).otherwise(kept)


def is_valid(text: Column) -> Column:
    return (text.rlike(STANDARD) & F.substring(text, 1, 2).isin(STATES)) | text.rlike(BHARAT)


def display(text: Column) -> Column:
    """Groups of the plate with spaces between; other texts as they are."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(text, STANDARD, "$1 $2 $3 $4"), " +", " "))
    return F.when(text.rlike(STANDARD), spaced).when(text.rlike(BHARAT), F.regexp_replace(text, BHARAT, "$1 BH $2 $3")).otherwise(F.coalesce(text, F.lit("")))


def _translated(c: Column, table: dict[str, str]) -> Column:
    return F.translate(c, "".join(table), "".join(table.values()))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _char(cleaned: Column, template: Column, i: Column) -> Column:
    """The character at place i and what the template makes of it."""
    want, was = F.substring(template, i + 1, F.lit(1)), F.substring(cleaned, i + 1, F.lit(1))
    digit = want == "D"
    kept = F.when(digit, was.rlike("[0-9]")).otherwise(was.rlike("[A-Z]"))
    now = F.when(kept, was).when(digit, _translated(was, LETTER_TO_DIGIT)).otherwise(_translated(was, DIGIT_TO_LETTER))
    return F.struct(i.alias("position"), was.alias("was"), now.alias("now"), F.when(digit, "digit-expected").otherwise("letter-expected").alias("reason"))


def _state_repair(text: Column) -> Column:
    """struct(state, correction) that makes the first two letters a known state by one swap, the first letter's before the second's; null if they are one or none does."""
    trials = []
    for i in (0, 1):
        was = F.substring(text, i + 1, 1)
        now = _translated(was, STATE_REPAIR)
        state = F.concat(now, F.substring(text, 2, 1)) if i == 0 else F.concat(F.substring(text, 1, 1), now)
        trials.append(F.struct(state.alias("state"), F.struct(F.lit(i).alias("position"), was.alias("was"), now.alias("now"), F.lit("state-code").alias("reason")).alias("how")))
    fits = F.filter(F.array(*trials), lambda x: (x["how"]["was"] != x["how"]["now"]) & x["state"].isin(STATES))
    return F.when(~F.substring(text, 1, 2).isin(STATES), F.get(fits, F.lit(0)))


def _reading(template: Column, chars: Column) -> Column:
    """What a template that fits makes of a text: struct(cost, order, format, text, corrections)."""
    bharat, delhi = template["format"] == "bharat", template["format"] == "delhi"
    changed = F.filter(chars, lambda c: c["was"] != c["now"])
    text = F.array_join(F.transform(chars, lambda c: c["now"]), "")

    def read(x: Column) -> Column:
        fix = F.when(~bharat, _state_repair(x["text"]))
        return _let(F.struct(x["text"].alias("text"), x["changed"].alias("changed"), fix.alias("fix")), repaired)

    def repaired(x: Column) -> Column:
        now = F.when(x["fix"].isNull(), x["text"]).otherwise(F.concat(x["fix"]["state"], F.substring(x["text"], 3, 1 << 20)))
        hows = F.when(x["fix"].isNull(), x["changed"]).otherwise(F.concat(x["changed"], F.array(x["fix"]["how"])))
        unknown = F.when(bharat | F.substring(now, 1, 2).isin(STATES), 0.0).otherwise(UNKNOWN_STATE_COST)
        abroad = F.when(delhi & ~now.startswith("DL"), NOT_DELHI_COST).otherwise(0.0)
        return F.struct((F.size(x["changed"]) + unknown + abroad).alias("cost"), template["order"].alias("order"), template["format"].alias("format"), now.alias("text"), hows.alias("corrections"))

    return _let(F.struct(text.alias("text"), changed.alias("changed")), read)


def normalised(raw: Column) -> Column:
    """struct(cleaned, normalized, is_valid, format, corrections): the cheapest template, the earlier of equals."""
    every = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(kind).alias("format"), F.lit(t).alias("template")) for i, (kind, t) in enumerate(TEMPLATES)])

    def chars(cleaned: Column, t: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.length(t["template"]) - 1), lambda i: _char(cleaned, t["template"], i))

    def fits(t: Column, c: Column) -> Column:
        want = F.substring(t["template"], c["position"] + 1, F.lit(1))
        return F.when(want == "D", c["now"].rlike("[0-9]")).otherwise(c["now"].rlike("[A-Z]"))

    def best(cleaned: Column) -> Column:
        long_enough = F.filter(every, lambda t: F.length(t["template"]) == F.length(cleaned))
        read = F.transform(long_enough, lambda t: _let(chars(cleaned, t), lambda c: F.when(F.forall(c, lambda x: fits(t, x)), _reading(t, c))))
        return _let(F.struct(cleaned.alias("cleaned"), F.array_min(read).alias("best")), chosen)

    def chosen(x: Column) -> Column:
        text = F.coalesce(x["best"]["text"], x["cleaned"])
        valid = x["best"].isNotNull() & is_valid(text)
        return F.struct(x["cleaned"].alias("cleaned"), text.alias("normalized"), valid.alias("is_valid"), x["best"]["format"].alias("format"), x["best"]["corrections"].alias("corrections"))

    return _let(clean(raw), best)


_COST = np.ones((128, 128))
np.fill_diagonal(_COST, 0.0)
for _a, _b in CONFUSABLE:
    _COST[ord(_a), ord(_b)] = _COST[ord(_b), ord(_a)] = CONFUSED_COST


def codes(texts: list[str], width: int) -> np.ndarray:
    """A row of characters' numbers for each text, filled up with zeros."""
    return np.array(texts, f"<U{width}").view(np.int32).reshape(len(texts), width)


def coded_distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Weighted edit distances of pairs of ``codes`` with their lengths: one table of costs for all pairs at once, row by row; what both begin with costs nothing and is left out."""
    if not len(a):
        return np.zeros(0)
    n, width = a.shape
    alike = np.minimum(np.cumprod(a == b, axis=1, dtype=np.int64).sum(axis=1), np.minimum(la, lb))
    at = np.minimum(alike[:, None] + np.arange(width), width - 1)
    ca, cb = (np.minimum(np.take_along_axis(x, at, 1), 127).T for x in (a, b))
    la, lb, every = la - alike, lb - alike, np.arange(n)
    row = np.repeat(np.arange(lb.max() + 1.0)[:, None], n, axis=1)
    out = row[lb, every]
    for i in range(1, la.max() + 1):
        now = np.empty_like(row)
        now[0] = i
        for j in range(1, len(row)):
            swap = row[j - 1] + _COST[ca[i - 1], cb[j - 1]]
            now[j] = np.minimum(np.minimum(row[j], now[j - 1]) + 1.0, swap)
        row = now
        done = np.flatnonzero(la == i)
        out[done] = row[lb[done], done]
    return out


def _distances(a: list[str], b: list[str]) -> np.ndarray:
    """Weighted edit distances of pairs."""
    la, lb = (np.array([len(x) for x in t], np.int64) for t in (a, b))
    width = max(la.max(initial=1), lb.max(initial=1))
    return coded_distances(codes(a, width), la, codes(b, width), lb)


def _weighted(a: pd.Series, b: pd.Series) -> pd.Series:
    has = a.notna() & b.notna()
    out = pd.Series(np.nan, index=a.index)
    order = np.flatnonzero(has.to_numpy())
    for s in range(0, len(order), 4096):
        at = order[s : s + 4096]
        out.iloc[at] = _distances(a.iloc[at].tolist(), b.iloc[at].tolist())
    return out.astype("Float64").mask(~has)


def weighted_distance(a: Column | str, b: Column | str) -> Column:
    """Edit distance in which confusable characters are cheap to swap; null if either is null."""
    return F.pandas_udf(_weighted, T.DoubleType())(a, b)


_CHEAP = {frozenset(x) for x in CONFUSABLE}


def edit_distance(a: str, b: str) -> float:
    """``weighted_distance`` of two values."""
    before = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            swap = 0.0 if x == y else CONFUSED_COST if frozenset((x, y)) in _CHEAP else 1.0
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + swap))
        before = row
    return before[-1]


def similarity(a: Column, b: Column, distance: Column) -> Column:
    """1 - distance / longer length, at least 0; null if either is null or empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - distance / longer)))


def with_normalised(reads: DataFrame, raw: str) -> DataFrame:
    """``reads`` with ``plate``, what ``normalised`` makes of the column ``raw``: worked out once for each distinct text and joined back."""
    distinct = reads.select(F.col(raw).alias("_raw")).distinct()
    known = distinct.select("_raw", normalised(F.col("_raw")).alias("plate"))
    return reads.join(known, F.col(raw).eqNullSafe(F.col("_raw")), "left").drop("_raw")

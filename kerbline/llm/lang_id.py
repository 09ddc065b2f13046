"""Language identification with interpolated Kneser-Ney character models.

One model for each language is learnt from a bounded sample of labelled rows. All models share sorted arrays of n-gram
hashes; beside each hash stand the log-probabilities of all languages, so that one search scores them all. A text takes the
language with the lowest cross-entropy for each character, and is rejected where even that lies above a limit calibrated
on labelled rows that the model hasn't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.shared import columns, stored
from kerbline.llm.textnum import mixed

ORDER, DISCOUNT = 4, 0.75
#: Characters that the score's odds count at most.
EVIDENCE = 40
#: The bound of the sample: labelled rows of a language, in expectation, and characters of a sampled row at most.
SAMPLE_ROWS, SAMPLE_CHARS = 1200, 20_000
#: One in so many sampled rows calibrates the rejection instead of fitting. The limit is the quantile of their
#: cross-entropies plus a margin in nats, wider for short texts.
CALIBRATE, QUANTILE, MARGIN, SHORT_MARGIN = 5, 0.999, 0.35, 6.0
#: A limit of a language's own needs so many held-out rows. Of a language with fewer rows than the second number each row
#: is held out once, by a model of the others.
LEAST_HELD, FEW_ROWS = 20, 200
UNDETERMINED = "und"
SPACE = 32
SCHEMA = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text; runs of anything but letters become one space, one stands at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.where(_is_letter(points), points, SPACE).astype(np.uint32)
    kept = np.concatenate(([SPACE], kept, [SPACE])).astype(np.uint32)
    return kept[np.concatenate(([True], (kept[1:] != SPACE) | (kept[:-1] != SPACE)))]


_LETTER = np.zeros(0x10000, bool)


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _LETTER.any():
        _LETTER[:] = [chr(i).isalpha() for i in range(0x10000)]
    out = _LETTER[np.minimum(points, 0xFFFF)]
    if (high := points > 0xFFFF).any():
        out[high] = [chr(x).isalpha() for x in points[high]]
    return out


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n code points."""
    h = np.full(max(0, len(points) - n + 1), n, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[j : len(h) + j]
    return mixed(h)


@dataclass
class Model:
    """``keys[n]``: sorted hashes of the n-grams of all languages; ``prob[n]`` and ``back[n]``: a row for each, a column for each language."""

    langs: list[str]
    keys: list[np.ndarray]
    prob: list[np.ndarray]
    back: list[np.ndarray]
    unseen: np.ndarray
    limit: np.ndarray

    def log_probs(self, points: np.ndarray) -> np.ndarray:
        """Sum over the characters after the first of each language's log-probability (natural)."""
        order = len(self.keys) - 1
        total = np.zeros(len(self.langs))
        for n in range(2, min(order, len(points))):  # the first characters have shorter histories
            total += self._scored(points[:n][None, :], n)[0]
        if len(points) >= order:
            hashes = gram_hashes(points, order)
            h = np.sort(hashes)  # a search for sorted hashes walks along the keys
            keys = self.keys[order]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            total += self.prob[order][at[hit]].sum(axis=0, dtype=np.float64)
            if not hit.all():
                new = np.unique(h[~hit])
                miss = new[np.minimum(np.searchsorted(new, hashes), len(new) - 1)] == hashes
                runs = np.lib.stride_tricks.sliding_window_view(points, order)
                total += self._scored(runs[miss], order).sum(axis=0)
        return total

    def _scored(self, runs: np.ndarray, n: int) -> np.ndarray:
        """Log-probabilities of each run's last character after the others, with backing off."""
        if n == 0 or not len(runs):
            return np.broadcast_to(self.unseen, (len(runs), len(self.langs))).astype(np.float64)
        at, hit = self._find(runs, n)
        out = self.prob[n][at].astype(np.float64)
        if not hit.all():
            lower = self._scored(runs[~hit][:, 1:], n - 1)
            if n > 1:
                before, known = self._find(runs[~hit][:, :-1], n - 1)
                lower += np.where(known[:, None], self.back[n - 1][before], 0.0)
            else:
                lower = lower * 1.0
            out[~hit] = lower
        return out

    def _find(self, runs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        h = np.full(len(runs), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + runs[:, j]
        h = mixed(h)
        at = np.minimum(np.searchsorted(self.keys[n], h), len(self.keys[n]) - 1)
        return at, self.keys[n][at] == h

    def predict(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """Language, score, cross-entropy in nats for each character, and whether the text is rejected."""
        if not text or not self.langs:
            return UNDETERMINED, 0.0, None, True
        points = letters_of(text)
        if len(points) < 3 and not (points != SPACE).any():
            return UNDETERMINED, 0.0, None, True
        n = len(points) - 1
        entropy = -self.log_probs(points) / n
        best = int(np.argmin(entropy))
        odds = np.exp(-(entropy - entropy[best]) * min(n, EVIDENCE))
        rejected = bool(entropy[best] > self.limit[best] + SHORT_MARGIN / np.sqrt(n))
        return self.langs[best], float(1 / odds.sum()), float(entropy[best]), rejected


def _kneser_ney(counts: dict[str, pd.DataFrame], order: int, discount: float) -> tuple[list, list, list, list, np.ndarray]:
    """Shared arrays from each language's counts of the longest n-grams (columns gram, n)."""
    langs = sorted(counts)
    grams: list[dict[str, pd.Series]] = [{} for _ in range(order + 1)]
    for lang in langs:
        level = counts[lang].groupby("gram")["n"].sum()
        for n in range(order, 0, -1):
            grams[n][lang] = level
            if n > 1:  # how many characters precede each shorter run, not how often it occurs
                level = pd.Series(1, index=level.index.str[1:]).groupby(level=0).sum()
    every = [pd.Index([])] + [pd.Index(sorted(set().union(*[grams[n][x].index for x in langs]))) for n in range(1, order + 1)]
    prob: list[pd.DataFrame] = [pd.DataFrame()] * (order + 1)
    back: list[pd.DataFrame] = [pd.DataFrame()] * (order + 1)
    # The shortest history: continuation counts with the rest spread over one class more than there are characters.
    unseen = np.zeros(len(langs))
    for n in range(1, order + 1):
        table = {}
        for k, lang in enumerate(langs):
            own = grams[n][lang]
            if n == 1:
                total, types = own.sum(), len(own)
                floor = discount * types / total / (len(every[1]) + 1)
                unseen[k] = np.log(floor)
                table[lang] = np.log(np.maximum(own.reindex(every[1], fill_value=0) - discount, 0) / total + floor)
                continue
            history = own.index.str[:-1]
            totals = own.groupby(history).agg(["sum", "size"])
            weight = np.log(discount * totals["size"] / totals["sum"])
            back[n - 1] = back[n - 1].reindex(every[n - 1]) if len(back[n - 1]) else pd.DataFrame(index=every[n - 1])
            back[n - 1][lang] = weight.reindex(every[n - 1]).fillna(0.0)
            lower = prob[n - 1][lang].reindex(every[n].str[1:])
            before = back[n - 1][lang].reindex(every[n].str[:-1]).fillna(0.0)
            base = np.where(lower.isna(), unseen[k], lower) + before.to_numpy()
            seen = np.maximum(own.reindex(every[n], fill_value=0).to_numpy() - discount, 0)
            held = totals["sum"].reindex(every[n].str[:-1]).to_numpy()
            table[lang] = np.log(np.where(np.isnan(held), 0, seen / np.where(np.isnan(held), 1, held)) + np.exp(base))
        prob[n] = pd.DataFrame(table, index=every[n])
    keys, probs, backs = [np.zeros(0, np.uint64)], [np.zeros((0, len(langs)))], [np.zeros((0, len(langs)))]
    for n in range(1, order + 1):
        h = np.concatenate([gram_hashes(np.frombuffer(g.encode("utf-32-le"), np.uint32), n) for g in every[n]])
        by = np.argsort(h)
        keys.append(h[by])
        probs.append(prob[n].to_numpy(np.float32)[by])
        backs.append((back[n][langs].reindex(every[n]).fillna(0.0).to_numpy(np.float32) if n < order else np.zeros((len(h), 0), np.float32))[by])
    return langs, keys, probs, backs, unseen


def fit(labelled: DataFrame, order: int = ORDER, discount: float = DISCOUNT, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model of the languages of ``labelled`` (doc_id, text, lang); rows with null text or lang teach nothing.

    About ``sample_rows`` rows of each language are drawn by a hash of the row's id, and so reruns agree. They bound what
    reaches the driver: the n-grams of ``sample_rows`` rows of ``sample_chars`` characters for each language. Longer rows
    are left out of the sample, unless a language has no others. The model has a column for each distinct lang, and so these
    should be languages and not free text. Every language gets a finite limit of rejection: that of
    its own held-out rows, and where these are few, that of all languages' but not below what its own ask for.
    """
    rows = columns(labelled, "doc_id", "text", "lang").where("text is not null and lang is not null")
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    fits = F.length("text") <= sample_chars
    sizes = stored(rows.groupBy("lang").agg(F.count(F.when(fits, 1)).alias("n"), F.count("*").alias("all")), "lang-sizes")
    few = {r["lang"] for r in sizes.where(F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("all")) < FEW_ROWS).collect()}
    # A row for each language, as the model has a column for each.
    rows = rows.join(F.broadcast(sizes), "lang")
    share = F.when(F.col("n") == 0, sample_rows / F.col("all")).when(fits, F.try_divide(F.lit(sample_rows), F.col("n"))).otherwise(0.0)
    sample = rows.where(drawn < share).withColumn("fold", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("fold")), F.lit(CALIBRATE)))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (lang, fold), part in batch.groupby(["lang", "fold"]):
                if fold == 0 or lang in few:
                    yield pd.DataFrame({"lang": lang, "fold": fold, "gram": part["text"], "n": 0})
                if fold == 0 and lang not in few:
                    continue
                runs = [np.lib.stride_tricks.sliding_window_view(p, order) for p in map(letters_of, part["text"]) if len(p) >= order]
                if runs:
                    flat = np.ascontiguousarray(np.concatenate(runs).astype("<u4")).view(f"<U{order}").ravel()
                    gram, n = np.unique(flat, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "fold": fold if lang in few else 1, "gram": gram.astype(str), "n": n.astype(np.int64)})

    found = sample.select("text", "lang", "fold").mapInPandas(grams, "lang string, fold long, gram string, n long").groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n")).toPandas()
    in_few = found["lang"].isin(few)

    def learnt(without: int) -> Model:
        kept = found[(found["n"] > 0) & (found["fold"] != np.where(in_few, without, 0))]
        counts = dict(iter(kept.groupby("lang")))
        return Model(*_kneser_ney(counts, order, discount), np.full(len(counts), np.inf)) if counts else Model([], [], [], [], np.zeros(0), np.zeros(0))

    model = learnt(0)
    if not model.langs:
        return model
    held: dict[str, list[float]] = {lang: [] for lang in found["lang"].unique()}
    for fold in range(CALIBRATE if few else 1):
        asked = found[(found["n"] == 0) & (found["fold"] == fold) & (in_few if fold else True)]
        if len(asked):
            other = learnt(fold) if fold else model
            for lang, text in zip(asked["lang"], asked["gram"], strict=True):
                x = other.predict(text)
                if x[2] is not None and x[0] == lang:
                    held[lang].append(x[2])
    pool = [x for own in held.values() for x in own]

    def limit(k: int, own: list[float]) -> float:
        if len(own) >= LEAST_HELD:
            return np.quantile(own, QUANTILE) + MARGIN
        if pool:
            return max([np.quantile(pool, QUANTILE), *own]) + MARGIN
        return -0.75 * model.unseen[k]  # nothing to calibrate with: well below what a letter that nobody taught costs

    model.limit = np.array([limit(k, held[lang]) for k, lang in enumerate(model.langs)])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): language, score from 0 to 1, cross-entropy and whether rejected.

    The language and the rejection go by the cross-entropy of the whole text. The score is the share of the best language in
    odds of ``EVIDENCE`` characters at that cross-entropy (all characters of shorter texts), since the characters of a text
    are no independent pieces of evidence, and with all of them the score would be 1 for any text of a few lines.

    Null texts and texts without a letter, and every text where nothing could be learnt, are ``und`` with score 0 and
    rejected. Texts of any length count whole. Null ids stay null, repeated rows are predicted each, other columns of
    ``docs`` are ignored. The model is bounded by the sample that it was fitted on.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = sent.value
        for batch in batches:
            found = [held.predict(x) for x in batch["text"].tolist()]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "cross_entropy": pd.Series([x[2] for x in found], dtype="Float64"), "rejected": [x[3] for x in found]})

    return columns(docs, "doc_id", "text").selectExpr("cast(doc_id as string) doc_id", "text").mapInPandas(task, SCHEMA)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (text and any other columns) that ``predict`` doesn't reject, as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepts(text: pd.Series) -> pd.Series:
        return pd.Series([not sent.value.predict(x)[3] for x in text.tolist()], dtype=bool)

    return docs.where(accepts("text"))

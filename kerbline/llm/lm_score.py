"""Language-model scoring: a weighted backoff automaton over word trigrams, learnt from all training rows.

The model is P(w | h) = (1 - l) c(h, w) / c(h) + l P(w | h'), where h' is h without its first word, and without history
P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). The share l depends on the order and on the size class of c(h): it is the share of
the class's tokens whose n-gram occurs once (Good and Turing's estimate of what is new).

As an automaton, each bigram and each word seen in training is a state, and so are the start of a text and the empty
history. An explicit arc leads along each seen n-gram, and a failure arc of weight l leads to the state of the shorter
history. One walk from left to right carries the longest known history, adds up the explicit arcs of its state and of those
along its failure arcs, and accumulates the logarithms.

The model grows with the corpus, so it is never in one place. Rows are gathered into blocks, and a block asks only for what
it holds: its distinct n-grams go, as sorted hashes, to the ranges of hashes that count them over all blocks, and the
counts come back in the same order. Words and bigrams go first. A trigram can only stand in another block if both its
bigrams do, and so only such trigrams go in the second exchange; the others are counted where they are. Each block then
builds its own part of the automaton and walks it. What is sent is an array for each block and range that isn't empty, so
never more arrays than n-grams, already summed within the block; no range is hot, since a block sends each n-gram once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.shared import dropped, stored, text_batches
from kerbline.llm.textnum import BASE, mixed, word_hashes

#: Characters of a block; a longer text is a block of its own. Blocks whose n-grams are counted together in one range.
BLOCK_CHARS, BLOCKS_OF_RANGE = 5_000_000, 3
#: Hashes of the end of a text (a token) and of the start (only a history).
END, START = np.uint64(0x517CC1B727220A95), np.uint64(0x6C62272E07BB0142)
#: Share of what is new where no training row tells it, and the most that it can be.
UNKNOWN_SHARE, MOST_SHARE = 0.5, 0.999

_SENT = "order int, part int, block long, keys binary, counts binary, classes binary, stats array<struct<order: int, size: int, once: long, n: long>>"
_COUNTS = "order int, part int, block long, counts binary, n long, types long, stats array<struct<order: int, size: int, once: long, n: long>>"


def packed(x: np.ndarray) -> bytes:
    """Bytes of the integers by significance: the planes of high bytes are runs of zeros, which the shuffle's codec removes."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unpacked(data: bytes, dtype: type = np.uint64) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def packed_sorted(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def parts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of hashes begins in the sorted keys, and the end."""
    firsts = np.array([(i << 64) // n for i in range(n)], np.uint64)
    return np.append(np.searchsorted(keys, firsts), len(keys))


def size_class(c: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(c, 1).astype(np.float64))[1].astype(np.uint8)


def gathered(docs: DataFrame, train: Column, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) in blocks: one row each of ids, compressed texts, their lengths and whether they teach."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        base, made, held, size = (context.partitionId() if context else 0) << 33, 0, [], 0

        def row() -> pd.DataFrame:
            nonlocal made, size
            data = [x.encode("utf-8", "surrogatepass") for _, x, _ in held]
            lengths = np.array([len(x) for x in data], np.uint64)
            frame = pd.DataFrame({"block": [base + made], "ids": [[i for i, _, _ in held]], "texts": [zstandard.ZstdCompressor(level=1).compress(b"".join(data))], "lengths": [packed(lengths)], "train": [bytes(t for _, _, t in held)]})
            made, size = made + 1, 0
            held.clear()
            return frame

        for batch in batches:
            for i, x, t in zip(batch["doc_id"].tolist(), batch["text"].tolist(), batch["train"].tolist(), strict=True):
                if held and size + len(x) > block_chars:
                    yield row()
                held.append((None if pd.isna(i) else i, x, bool(t)))
                size += len(x) + 1
        if held:
            yield row()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    return stored(rows.mapInPandas(task, "block long, ids array<string>, texts binary, lengths binary, train binary"), "lm-blocks")


class Block:
    """A block's tokens, text by text, each with its end: their ranks among its sorted distinct words and bigrams.

    Histories of tokens: the word before (the start before a text's first), and the bigram that ends there.
    """

    def __init__(self, row: pd.Series) -> None:
        self.block, self.ids = int(row["block"]), list(row["ids"])
        data, ends = zstandard.ZstdDecompressor().decompress(row["texts"]), np.cumsum(unpacked(row["lengths"]).astype(np.int64))
        starts = np.append(0, ends[:-1]) if len(ends) else ends
        texts = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        found, lengths = [], []
        for a, b in text_batches(texts, 128_000):
            h, offsets = word_hashes(texts[a:b])
            found.append(np.insert(h, offsets[1:], END))
            lengths.append(np.diff(offsets) + 1)
        tokens = np.concatenate(found)
        self.lengths = np.concatenate(lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(np.frombuffer(row["train"], bool), self.lengths)
        self.words, self.rank = np.unique(tokens, return_inverse=True)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.first] = START
        self.bigrams, self.bigram = np.unique(mixed(before * np.uint64(BASE) + tokens), return_inverse=True)
        self.tokens = tokens

    def trigrams(self, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct trigrams and each token's rank among them, -1 for a text's first token and tokens not in ``among``."""
        has = np.ones(len(self.tokens), bool) if among is None else among.copy()
        has[self.first] = False
        at = np.flatnonzero(has)
        keys, rank = np.unique(mixed(self.bigrams[self.bigram[at - 1]] * np.uint64(BASE) + self.tokens[at]), return_inverse=True)
        out = np.full(len(self.tokens), -1)
        out[at] = rank
        return keys, out

    def counts(self, rank: np.ndarray, n: int) -> np.ndarray:
        """Training counts of the block's n-grams by their tokens' ranks."""
        has = rank >= 0
        return np.bincount(rank[has], weights=self.train[has], minlength=n).astype(np.uint64)


class Totals:
    """Counts over all blocks as they came back to a block, with whether another block has the n-gram and whether this block tells of it."""

    def __init__(self, back: pd.DataFrame, order: int) -> None:
        found = [unpacked(x) for x in back[back["order"] == order].sort_values("part")["counts"]]
        x = np.concatenate(found) if found else np.zeros(0, np.uint64)
        self.count, self.elsewhere, self.own = (x >> np.uint64(2)).astype(np.int64), (x & np.uint64(2)) > 0, (x & np.uint64(1)) > 0


def _histories(block: Block, words: Totals, bigrams: Totals) -> tuple[np.ndarray, np.ndarray]:
    """Training count of each token's history of one word, and of two (0 at a text's first token)."""
    one, two = np.empty(len(block.rank), np.int64), np.zeros(len(block.rank), np.int64)
    one[1:] = words.count[block.rank[:-1]]
    one[block.first] = words.count[np.searchsorted(block.words, END)]
    two[1:] = bigrams.count[block.bigram[:-1]]
    two[block.first] = 0
    return one, two


def _class_sums(order: int, classes: np.ndarray, counts: np.ndarray) -> list[dict]:
    once, n = np.bincount(classes[counts == 1], minlength=256), np.bincount(classes, weights=counts, minlength=256)
    return [{"order": order, "size": int(i), "once": int(once[i]), "n": int(n[i])} for i in np.flatnonzero(n)]


def _of_types(rank: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """A value of each distinct n-gram from those of its tokens."""
    out, has = np.zeros(n, values.dtype), rank >= 0
    out[rank[has]] = values[has]
    return out


class Automaton:
    """A block's part of the automaton: states, their failure arcs and weights, and the explicit arcs that its tokens ask for.

    State 0 is the empty history, then follow the words, the start of a text, and the bigrams. A history that training
    doesn't know has no arcs, and its failure arc has weight 1.
    """

    def __init__(self, block: Block, words: Totals, bigrams: Totals, trigrams: np.ndarray, total: int, types: int, share_new: dict[tuple[int, int], float]) -> None:
        self.block, n = block, len(block.words)
        self.base = np.log10((words.count + 0.5) / (total + 0.5 * (types + 1)))
        self.known = words.count > 0
        last = _of_types(block.bigram, len(block.bigrams), block.rank)
        self.start = n + 1
        self.count = np.concatenate([[0], words.count, [words.count[np.searchsorted(block.words, END)]], bigrams.count])
        self.failure = np.concatenate([np.zeros(n + 2, np.int64), last + 1])
        self.depth = np.concatenate([[0], np.ones(n + 1, np.int64), np.full(len(bigrams.count), 2)])
        table = np.full((3, 256), UNKNOWN_SHARE)
        for (order, size), share in share_new.items():
            table[order - 1, size] = share
        self.weight = np.where(self.count > 0, table[self.depth, size_class(self.count)], 1.0)
        self.arcs = (bigrams.count[block.bigram], trigrams)  # of each token, from a state of one word and of two

    def walk(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: known tokens, the base score and the model's score."""
        block = self.block
        state = np.empty(len(block.rank), np.int64)  # before each token: the longest history
        state[1:] = len(block.words) + 2 + block.bigram[:-1]
        state[block.first] = self.start
        base = self.base[block.rank]
        chance, passed = np.zeros(len(state)), np.ones(len(state))
        while (at := np.flatnonzero(state)).size:
            here, weight = state[at], self.weight[state[at]]
            own = np.where(self.depth[here] == 2, self.arcs[1][at], self.arcs[0][at])
            chance[at] += passed[at] * (1 - weight) * own / np.maximum(self.count[here], 1)
            passed[at] *= weight
            state[at] = self.failure[here]
        score = np.log10(chance + passed * np.power(10.0, base))
        sums = lambda x: np.add.reduceat(x, block.first)
        return sums(self.known[block.rank].astype(np.int64)), sums(base), sums(score)


def _sent(order: int, block: int, keys: np.ndarray, counts: np.ndarray, classes: np.ndarray | None, n_parts: int) -> list[tuple]:
    at = parts(keys, n_parts)
    return [(order, p, block, packed_sorted(keys[a:b]), packed(counts[a:b]), b"" if classes is None else classes[a:b].tobytes(), []) for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["order", "part", "block", "keys", "counts", "classes", "stats"])


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts over all blocks of the keys of one range, returned to each block in the order of its keys; sums of a block pass through."""
    order, told = int(rows["order"].iat[0]), [x for s in rows["stats"] for x in s]
    out = pd.DataFrame({"order": order, "part": rows["part"], "block": rows["block"], "counts": b"", "n": 0, "types": 0, "stats": [[] for _ in range(len(rows))]})
    if order == 0:
        out.at[out.index[0], "stats"] = told
        return out
    sent = [unpacked_sorted(x) for x in rows["keys"]]
    counts = np.concatenate([unpacked(x) for x in rows["counts"]])
    keys, first, at = np.unique(np.concatenate(sent), return_index=True, return_inverse=True)
    total = np.zeros(len(keys), np.uint64)
    np.add.at(total, at, counts)
    back = (total << np.uint64(2) | (np.bincount(at, minlength=len(keys)) > 1).astype(np.uint64) << np.uint64(1))[at]
    back[first] |= np.uint64(1)
    out["counts"] = [packed(np.ascontiguousarray(x)) for x in np.split(back, np.cumsum([len(x) for x in sent])[:-1])]
    out.loc[out.index[0], ["n", "types"]] = int(total.sum()), int((total > 0).sum())
    if order == 3:
        out.at[out.index[0], "stats"] = _class_sums(3, np.frombuffer(b"".join(rows["classes"]), np.uint8)[first], total)
    return out


def score(docs: DataFrame, train: Column, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): n_tokens, n_known, train_tokens, base_score and score (log10).

    ``train`` says which rows teach the model. A null or empty text is its end alone; null ids stay null and, like
    repeated rows, are scored each; without any training row every token has probability 1; an empty table gives no
    rows; other columns of ``docs`` are ignored. Two n-grams whose hashes of 64 bits are equal count as one.
    """
    blocks = gathered(docs, train, block_chars)
    n = max(1, -(-blocks.count() // BLOCKS_OF_RANGE))

    def words_and_bigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                b = Block(row)
                yield _frame(_sent(1, b.block, b.words, b.counts(b.rank, len(b.words)), None, n) + _sent(2, b.block, b.bigrams, b.counts(b.bigram, len(b.bigrams)), None, n))

    sent = blocks.mapInPandas(words_and_bigrams, _SENT)
    known = stored(sent.groupBy("order", "part").applyInPandas(_summed, _COUNTS), "lm-known")
    total, types = (int(x or 0) for x in known.where("order = 1").agg(F.sum("n"), F.sum("types")).first())

    def trigrams(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return _frame([])
        b = Block(pdf.iloc[0])
        words, bigrams = Totals(back, 1), Totals(back, 2)
        one, two = _histories(b, words, bigrams)
        met = bigrams.elsewhere[b.bigram]
        met[1:] &= bigrams.elsewhere[b.bigram[:-1]]
        keys, rank = b.trigrams(met)
        alone, own = b.trigrams(~met)
        stats = _class_sums(2, _of_types(b.bigram, len(b.bigrams), size_class(one))[bigrams.own], bigrams.count[bigrams.own])
        stats += _class_sums(3, _of_types(own, len(alone), size_class(two)), b.counts(own, len(alone)))
        return _frame([*_sent(3, b.block, keys, b.counts(rank, len(keys)), _of_types(rank, len(keys), size_class(two)), n), (0, b.block % 61, b.block, b"", b"", b"", stats)])

    returned = known.select("order", "part", "block", "counts")
    sent = blocks.groupBy("block").cogroup(returned.groupBy("block")).applyInPandas(trigrams, _SENT)
    longer = stored(sent.groupBy("order", "part").applyInPandas(_summed, _COUNTS), "lm-trigrams")
    # One row for each order and size class, of which there are 64 at most.
    sums = longer.selectExpr("explode(stats) c").groupBy("c.order", "c.size").agg(F.sum("c.once").alias("once"), F.sum("c.n").alias("n")).collect()
    share_new = {(r["order"], r["size"]): min(MOST_SHARE, (r["once"] + 0.5) / (r["n"] + 1)) for r in sums}

    def walked(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        b = Block(pdf.iloc[0])
        words, bigrams = Totals(back, 1), Totals(back, 2)
        met = bigrams.elsewhere[b.bigram]
        met[1:] &= bigrams.elsewhere[b.bigram[:-1]]
        (_, rank), (alone, own) = b.trigrams(met), b.trigrams(~met)
        arcs, sent_counts = np.zeros(len(rank), np.int64), Totals(back, 3).count
        arcs[rank >= 0] = sent_counts[rank[rank >= 0]]
        arcs[own >= 0] = b.counts(own, len(alone)).astype(np.int64)[own[own >= 0]]
        n_known, base, model = Automaton(b, words, bigrams, arcs, total, types, share_new).walk()
        return pd.DataFrame({"doc_id": pd.array([None if i is None else int(i) for i in b.ids], "Int64"), "n_tokens": b.lengths, "n_known": n_known, "train_tokens": total, "base_score": base, "score": model})

    returned = returned.unionByName(longer.where("order = 3").select("order", "part", "block", "counts"))
    out = stored(blocks.groupBy("block").cogroup(returned.groupBy("block")).applyInPandas(walked, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "lm-scores")
    for used in (blocks, known, longer):
        dropped(used)
    return out

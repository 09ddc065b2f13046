"""Hierarchical multi-length packing of documents into training sequences.

Documents are cut into pieces and packed into windows of several context sizes (tiers). Whole windows of the longest tier
are cut off first; what remains of a document is routed to the smallest tier that holds it. Each tier, longest first, is
packed from its own pieces; the gap of a window is filled with the longest pieces of the shorter tiers that fit, and at
last a piece is cut to close it. What a partition has left at its end is cut for ever shorter tiers, so that every window
is full. Windows of a tier have one length, and step groups of the same number of tokens hold equal work.

Every partition packs its own documents: no shuffle of texts, memory bounded by a batch of them, and a lost task repeats to
the same result. Step groups are dealt out afterwards, from the number of windows of each tier in each partition, so that
groups run on over partitions and at most one of each tier isn't full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.llm.shared import columns, stored
from kerbline.llm.tokens import encode, vocabulary_paths

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, part int, nth long"
#: Context sizes, longest first; each is a power of two. The last ones take only what a partition has left at its end.
TIERS, TAIL_TIERS = (1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1), 7
#: Windows of the longest tier whose pieces wait, so that there is a choice to fill gaps from.
POOL = 128
END_ID = 0
#: Tokens of a step group: its sequences have one length, so that the groups of a tier hold equal work.
STEP_TOKENS = 32_768
#: Rows of three numbers that are broadcast at most.
MOST_SENT = 500_000


class Pieces:
    """Pieces by length, with the longest that fits found by bit arithmetic. A piece: (document, start, length)."""

    def __init__(self) -> None:
        self.by: dict[int, list[tuple[int, int, int]]] = {}
        self.has = 0  # bit n: there are pieces of length n
        self.total = 0

    def add(self, doc: int, start: int, length: int) -> None:
        self.by.setdefault(length, []).append((doc, start, length))
        self.has |= 1 << length
        self.total += length

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most ``most`` tokens, the earliest of equals last in first out."""
        n = (self.has & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n <= 0:
            return None
        found = self.by[n].pop()
        if not self.by[n]:
            self.has ^= 1 << n
        self.total -= n
        return found

    def shortest_over(self, least: int) -> int:
        """The smallest length above ``least``, 0 if there is none."""
        over = self.has >> (least + 1)
        return (over & -over).bit_length() + least if over else 0


def windows(pieces: Pieces, tiers: tuple[int, ...], last: bool) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(tier, pieces) of each full window. Unless ``last``, a pool of pieces stays, so that gaps find pieces that fit.

    A piece belongs to the smallest tier that holds it. A tier's windows begin with its own longest piece.
    """
    for k, tier in enumerate(tiers if last else tiers[:-TAIL_TIERS]):
        below = tiers[k + 1] if k + 1 < len(tiers) and (last or k + 1 < len(tiers) - TAIL_TIERS) else 0
        while pieces.total >= (tier if last else POOL * tiers[0]) and pieces.has >> (below + 1):
            held = [pieces.take(tier)]
            gap = tier - held[0][2]
            while gap:
                piece = pieces.take(gap)
                if piece is None:  # all that is left is longer than the gap: cut the shortest
                    doc, start, length = pieces.take(pieces.shortest_over(gap))
                    pieces.add(doc, start + gap, length - gap)
                    piece = (doc, start, gap)
                held.append(piece)
                gap -= piece[2]
            yield tier, held
        while last and pieces.has >> (below + 1):  # too little is left for this tier: what belongs to it is cut for the next
            doc, start, length = pieces.take(tier)
            pieces.add(doc, start, below)
            pieces.add(doc, start + below, length - below)


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, json_path: str | None = None, rank_path: str | None = None, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece of each document of ``docs`` (doc_id, text); other columns are ignored.

    A document is its token ids and then ``end_id``; a null or empty text is the end alone, a null doc_id stays null,
    repeated rows are packed each, an empty table gives no rows, and a text of any length is cut into windows. ``tier`` is
    the length of the sequence, ``offset`` the piece's place there, ``step_group`` its group of ``step_tokens`` tokens,
    numbered within the tier; all groups of a tier but its last are full.
    """
    json_path, rank_path = (json_path, rank_path) if json_path and rank_path else vocabulary_paths()
    longest = tiers[0]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        base = part << 33
        pieces, known, made, in_tier = Pieces(), {}, 0, dict.fromkeys(tiers, 0)
        serial = 0

        def rows(last: bool) -> pd.DataFrame:
            nonlocal made
            out = []
            for tier, held in windows(pieces, tiers, last):
                offset = 0
                for doc, start, length in held:
                    doc_id, ids, left = known[doc]
                    out.append((doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), base + made, offset, tier, part, in_tier[tier]))
                    offset += length
                    if left == length:
                        del known[doc]
                    else:
                        known[doc] = doc_id, ids, left - length
                made += 1
                in_tier[tier] += 1
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in _PIECES.split(", ")])
            return frame.astype({"doc_id": "Int64"})

        for batch in batches:
            size = 0
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                ids = np.array([*encode(text, json_path, rank_path), end_id], "<u4")
                known[serial] = None if pd.isna(doc_id) else int(doc_id), ids, len(ids)
                whole = len(ids) // longest * longest
                for start in range(0, whole, longest):
                    pieces.add(serial, start, longest)
                if len(ids) > whole:
                    pieces.add(serial, whole, len(ids) - whole)
                serial += 1
                size += len(ids)
                if size > 1_000_000:
                    yield rows(False)
                    size = 0
            yield rows(False)
        yield rows(True)

    # The id goes through Arrow as decimal text where it may be null, so that no long passes through a float.
    packed = stored(columns(docs, "doc_id", "text").selectExpr("cast(doc_id as string) doc_id", "text").mapInPandas(task, _PIECES), "packed")
    # A row for each partition and tier; numbered within the tier, partition by partition.
    counts = packed.where("offset = 0").groupBy("tier", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = stored(counts.select("tier", "part", before.alias("before")), "packed-before")
    # Eleven rows at most for each task of the scan.
    rows = packed.join(F.broadcast(ahead) if ahead.count() <= MOST_SENT else ahead, ["tier", "part"])
    group = F.floor((F.col("before") + F.col("nth")) / F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("tier")))).cast("long")
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", group.alias("step_group"))

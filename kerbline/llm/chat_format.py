"""Chat formatting with a black-box template: turn spans by incremental rendering.

A template is any function from a list of (role, text) turns to a string. Successive prefixes of a conversation are
rendered, and the outputs compared: what a prefix adds to the one before is its last turn's span. Where an output doesn't
begin with the one before, the template rewrites history, and the conversation is marked; all its turns are then located
anew in the last output.

Within a turn that is learnt from, the place of the text alone is found the same way: the turn is rendered with two other
texts of one character each, and what these renderings share before and after that character is what the template puts
around a text. After a rewrite each earlier turn is rendered so in the whole conversation: there its text is, or what the
template has left of it, and the turn goes on as far as it did behind its text when it was the last.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.shared import columns

#: Control strings of the template and of others in use, escaped inside texts: fixed values.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN, TEXT, END = CONTROL[:3]
_BEGINS = re.compile("|".join(f"{re.escape(x[0])}(?={re.escape(x[1:])})" for x in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

SCHEMA = "conv_id long, n_turns long, formatted string, spans array<struct<role: string, first: long, last: long, loss: boolean, text_first: long, text_last: long>>, rewrites long"


def escaped(text: str) -> str:
    """``text`` without any control string: backslashes are doubled, and one is set after the first character of each."""
    return _BEGINS.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(turns: list[tuple[str, str]]) -> str:
    """The template of the query: every turn is marked, roles and texts are escaped."""
    return "".join(f"{TURN}{escaped(role)}{TEXT}{escaped(text)}{END}" for role, text in turns)


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


#: Two texts of one character that templates have no reason to treat differently from each other.
PROBES = ("a", "b")


class Spans:
    """Renders ever longer prefixes of one conversation and keeps the span that each turn added, and of turns of ``loss_roles`` that of the text in it."""

    def __init__(self, template: Callable[[list[tuple[str, str]]], str], loss_roles: tuple[str, ...]) -> None:
        self.template, self.loss_roles = template, loss_roles
        self.turns: list[tuple[str, str]] = []
        self.text = template([])
        self.found: list[tuple[str, int, int, int, int]] = []
        self.rewrites = 0

    def _place(self, turns: list[tuple[str, str]], i: int, now: str) -> tuple[int, int] | None:
        """From where to where the text of turn i stands in ``now``, the output for ``turns``; None where the template doesn't show it."""
        one, other = (self.template([*turns[:i], (turns[i][0], x), *turns[i + 1 :]]) for x in PROBES)
        if one == other:
            return None
        first = _common(one, other)
        return first, max(first, len(now) - (len(one) - first - 1))

    def add(self, role: str, text: str) -> None:
        self.turns.append((role, text))
        now = self.template(self.turns)
        if now.startswith(self.text):
            at = len(self.text)
        else:
            self.rewrites += 1
            at = _common(now, self.text)
        said = (self._place(self.turns, len(self.turns) - 1, now) or (len(now), len(now))) if role in self.loss_roles else (at, at)
        self.text = now
        self.found.append((role, at, len(now), *said))

    def located(self) -> list[tuple[str, int, int, int, int]]:
        """(role, first, last, text_first, text_last) of each turn in the last output."""
        if not self.rewrites:
            return self.found
        out, begin = [], min(self.found[0][1], len(self.text))
        places = [self._place(self.turns, i, self.text) for i in range(len(self.turns))]
        for i, (role, _) in enumerate(self.turns):
            end = len(self.text)
            first, last = places[i] or (begin, begin)
            if i + 1 < len(self.turns):
                head = self.template(self.turns[: i + 1])
                own = self._place(self.turns[: i + 1], i, head)
                after = next((x[0] for x in places[i + 1 :] if x), end)
                end = min(last + (len(head) - own[1] if own and places[i] else 0), after)
            out.append((role, begin, max(begin, end), *((first, last) if role in self.loss_roles else (begin, begin))))
            begin = max(begin, end)
        return out


def format_conversations(turns: DataFrame, template: Callable[[list[tuple[str, str]]], str] = render, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conv_id of ``turns`` (conv_id, turn, role, text): the formatted text and each turn's span in it.

    Spans are in code points, from ``first`` up to ``last``; ``loss`` marks turns of ``loss_roles``, of which ``text_first``
    to ``text_last`` is the text alone, as the template wrote it: the loss mask (empty in other turns). Turns are ordered by
    turn (null first), role and text, so that ties and repeated rows have one order; null roles and texts are empty; the
    rows of a null conv_id are one conversation; an empty table gives no rows; other columns are ignored. ``rewrites``
    counts the turns at which the template changed what it had rendered before. A turn that the template has taken out has an
    empty span, and so has a text that it doesn't show.

    Spark sorts the turns of each conversation into one partition and a task streams them: it holds one conversation. A
    black-box template must be rendered anew for every prefix, so that a conversation costs its turns times its length.
    """
    rows = columns(turns, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("string").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        now: Spans | None = None
        at: str | None = None

        def close() -> None:
            if now is not None:
                spans = [{"role": r, "first": a, "last": b, "loss": r in loss_roles, "text_first": x, "text_last": y} for r, a, b, x, y in now.located()]
                out.append((None if at is None else int(at), len(now.turns), now.text, spans, now.rewrites))

        def frame() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=["conv_id", "n_turns", "formatted", "spans", "rewrites"]).astype({"conv_id": "Int64"})
            out.clear()
            return made

        for batch in batches:
            for conv, role, text in zip(batch["conv_id"].tolist(), batch["role"].tolist(), batch["text"].tolist(), strict=True):
                conv = None if pd.isna(conv) else conv
                if now is None or conv != at:
                    close()
                    now, at = Spans(template, loss_roles), conv
                now.add(role, text)
            yield frame()
        close()
        yield frame()

    return rows.mapInPandas(task, SCHEMA)


_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output of ``format_conversations`` with the template ``render``: digests of turns and of the text under the loss mask."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, text, spans in zip(batch["conv_id"].tolist(), batch["formatted"].tolist(), batch["spans"].tolist(), strict=True):
                turns, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                for span in spans:
                    role, said = (unescaped(x) for x in _TURN.fullmatch(text[span["first"] : span["last"]]).groups())
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    if span["loss"]:
                        learnt = unescaped(text[span["text_first"] : span["text_last"]])
                        loss.update(learnt.encode("utf-8", "surrogatepass"))
                        chars += len(learnt)
                out.append((None if pd.isna(conv) else int(conv), len(spans), turns.hexdigest(), chars, loss.hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return formatted.selectExpr("cast(conv_id as string) conv_id", "formatted", "spans").mapInPandas(task, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

"""Licence scan: matching statistics of a generalised suffix automaton of licence templates, chained into covered spans.

The automaton holds every run of words of every template. A text is streamed through it word by word; after each word it
stands at the longest run of words, ending there, that occurs in some template, and by its suffixes at the longest of each
template. Long runs of a template are chained, where they follow one another in it with small gaps on both sides, and a
chain that covers enough of its template is a hit, whatever longer runs of other templates the text holds there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame

from kerbline.llm.shared import columns

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Fixed phrases and their labels: each place where a phrase's words stand consecutively counts.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Passages of public licences, from their published texts: fixed values.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-2.0-short": "licensed under the apache license version 2 0",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-short": "this work is licensed under the gnu general public license version 3",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
}
#: A run counts from so many words, is chained over gaps of so many, and a chain must cover this share of its template.
LEAST_RUN, MOST_GAP, LEAST_COVER = 4, 6, 0.6

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<template: string, first: long, last: long, covered: int, cover: double>>"


class Automaton:
    """Suffix automaton over several word sequences: ``step`` maps words to states; a state is the longest of its runs."""

    def __init__(self, sequences: Mapping[str, list[bytes]]) -> None:
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[str, int]]] = [[]]  # (sequence, position of the last word) of one or more occurrences
        for name, words in sequences.items():
            state = 0
            for i, word in enumerate(words):
                state = self._extend(state, word)
                self.ends[state].append((name, i))
        # An occurrence of a run is one of all its suffixes.
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                up = self.ends[self.link[state]]
                up.extend(x for x in self.ends[state] if x not in up)

    def _state(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """The state of p's run with ``word`` where q also holds longer runs."""
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = twin
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, word: bytes) -> int:
        if (q := self.step[last].get(word)) is not None:  # a run that an earlier sequence has
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def matching(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) after each word at which some run of the templates ends."""
        step, link, size = self.step, self.link, self.length
        first = step[0]
        state = length = 0
        for i, word in enumerate(words):
            if not length:
                if word in first:
                    state, length = first[word], 1
                    yield i, state, 1
                continue
            while state and word not in step[state]:
                state = link[state]
                length = size[state]
            if (to := step[state].get(word)) is None:
                state = length = 0
            else:
                state, length = to, length + 1
                yield i, state, length


class Scanner:
    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, str], least_run: int, most_gap: int, least_cover: float) -> None:
        split = lambda x: WORD.findall(x.encode().lower())
        self.texts = {name: split(x) for name, x in templates.items()} | {f"phrase {x}": split(x) for x in phrases}
        self.auto = Automaton(self.texts)
        self.label = {f"phrase {x}": label for x, label in phrases.items()}
        self.least_run, self.most_gap, self.least_cover = least_run, most_gap, least_cover
        # Of each state, the phrases that its runs end with: they occur wherever the state is reached with a run as long.
        self.phrases: list[list[tuple[str, int]]] = [[] for _ in self.auto.length]
        for state, ends in enumerate(self.auto.ends):
            for name, i in ends:
                if name in self.label and i + 1 == len(self.texts[name]) <= self.auto.length[state]:
                    self.phrases[state].append((name, len(self.texts[name])))
        for state in sorted(range(1, len(self.auto.length)), key=self.auto.length.__getitem__):
            if self.auto.link[state] > 0:
                have = self.phrases[state]
                have.extend(x for x in self.phrases[self.auto.link[state]] if x not in have)
        # Of each state, the templates with a run that counts: the longest's words (0: as many as the text has), and where it ends.
        self.within: list[dict[str, tuple[int, list[int]]]] = [{} for _ in self.auto.length]
        for state in sorted(range(1, len(self.auto.length)), key=self.auto.length.__getitem__):
            up = self.auto.link[state]
            if self.auto.length[up] >= least_run:
                self.within[state] = {name: (n or self.auto.length[up], at) for name, (n, at) in self.within[up].items()}
            own: dict[str, tuple[int, list[int]]] = {}
            for name, at in self.auto.ends[state]:
                if name not in self.label:
                    own.setdefault(name, (0, []))[1].append(at)
            self.within[state] |= own

    def scan(self, text: str | None) -> tuple:
        """n_words, base places (label, first word), spans (template, first, last, covered words, cover)."""
        words = WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
        base, runs = [], []
        last, growing = -2, {}  # of each template the run that ends at the last word: its words, and where it ends
        for i, state, length in self.auto.matching(words):
            for name, n in self.phrases[state]:
                if length >= n:
                    base.append((self.label[name], i - n + 1))
            if not growing and length < self.least_run:
                continue
            now = {name: (n or length, at) for name, (n, at) in self.within[state].items()} if length >= self.least_run else {}
            runs += [(last, name, n, at) for name, (n, at) in growing.items() if last != i - 1 or name not in now or now[name][0] != n + 1]
            last, growing = i, now
        runs += [(last, name, n, at) for name, (n, at) in growing.items()]
        return len(words), base, self.chained(runs)

    def chained(self, runs: list[tuple[int, str, int, list[int]]]) -> list[tuple]:
        """Chains of each template's maximal runs (last word, template, words, ends in it), in order of the text; those that cover enough of it."""
        open_: dict[str, list] = {}
        done = []

        def close(name: str, chain: list) -> None:
            if chain[3] >= self.least_cover * len(self.texts[name]):
                done.append((name, chain[0], chain[1], chain[3], chain[3] / len(self.texts[name])))

        for i, name, length, ends in runs:
            chain = open_.get(name)
            fitting = [at for at in ends if chain and chain[2] < at and at - length - chain[2] <= self.most_gap and -length < i - length - chain[1] <= self.most_gap]
            if fitting:
                at = min(fitting)
                covered = min(length, at - chain[2], i - chain[1])
                open_[name] = [chain[0], i, at, chain[3] + covered]
            else:
                if chain:
                    close(name, chain)
                open_[name] = [i - length + 1, i, ends[0], length]
        for name, chain in open_.items():
            close(name, chain)
        return sorted(done, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, phrases: Mapping[str, str] | None = None, templates: Mapping[str, str] | None = None, least_run: int = LEAST_RUN, most_gap: int = MOST_GAP, least_cover: float = LEAST_COVER) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): words, base places, labels, score and the covered spans.

    ``score`` is 1 where a base phrase stands, else the largest share of a template that a chain covers, 0 without one.
    Null and empty texts have no words, no labels ('') and score 0; null ids stay null; repeated rows are scanned each.
    A text is streamed once; the automaton's size is that of the templates. Other columns of ``docs`` are ignored.
    """
    scanner = Scanner(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates, least_run, most_gap, least_cover)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                n, base, spans = scanner.scan(text)
                starts = [x[1] for x in base]
                own = {x[0] for x in base}
                labels = own | {x[0] for x in spans}
                score = 1.0 if base else max((min(1.0, x[4]) for x in spans), default=0.0)
                out.append((None if doc_id is None else int(doc_id), n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), score, [dict(zip(("template", "first", "last", "covered", "cover"), x, strict=True)) for x in spans]))
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            yield frame.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    return columns(docs, "doc_id", "text").selectExpr("cast(doc_id as string) doc_id", "text").mapInPandas(task, SCHEMA)

"""Licence scan: a generalised suffix automaton over the tokens of licence templates.

The templates are whole licence texts and notices (``license_texts``) and clauses that name a licence. The automaton of
all is built once on the driver (a few thousand states, a fixed bound) and streamed over
each text's words. For every word it gives the matching statistic: the length of the longest template passage that
ends there. Long matches are chained per template, in order and across small gaps, to the span of the text that the
template covers; a template counts when the chain covers enough of it.

Only runs of words that occur in some template are fed to the automaton, as any other word resets it. That is the
same result for less work.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafwise.llm.common import binary, mapped
from leafwise.llm.license_texts import TEXTS

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases that are looked for as they are, whatever stands around them.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Clauses and names that identify a licence: (label, text).
CLAUSES = [
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person"),
    ("apache-2.0", "licensed under the Apache License, Version 2"),
    ("apache-2.0", "Apache License Version 2.0, January 2004"),
    ("gpl-2", "GNU General Public License version 2"),
    ("gpl-3", "GNU General Public License version 3"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License"),
    ("epl", "Eclipse Public License Version 2"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication"),
    ("cc-by-nc", "licensed under CC BY NC"),
    ("cc-by-sa", "licensed under CC BY SA"),
    ("cc-by-nd", "licensed under CC BY ND"),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial"),
    ("cc-by-sa", "Creative Commons Attribution ShareAlike"),
    ("cc-by-nd", "Creative Commons Attribution NoDerivatives"),
    ("proprietary", "unauthorized copying of this file is strictly prohibited"),
]
TEMPLATES = [*CLAUSES, *TEXTS]


@dataclass
class Automaton:
    """Suffix automaton of several token sequences; ``ends[state]`` has (sequence, end) pairs of the state's passages."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set] = field(default_factory=lambda: [set()])

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int], number: int) -> None:
        last, visited = 0, []
        for token in sequence:
            q = self.next[last].get(token)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and token not in self.next[p]:
                    self.next[p][token] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][token]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
                last = new
            visited.append(token)
        state = 0
        for end, token in enumerate(visited):  # splits during the build may have moved states: walk again
            state = self.next[state][token]
            self.ends[state].add((number, end))

    def finish(self) -> Automaton:
        """Hands each state's ends up its suffix links."""
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]
        return self

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest passage that ends at each token."""
        out, state, n = [], 0, 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if token in self.next[state]:
                state, n = self.next[state][token], n + 1
            out.append((n, state))
        return out


@dataclass
class LicenseScanner:
    """The compiled templates. ``min_match``: shortest match in words; ``max_gap``: words between chained matches;
    ``coverage``: least part of a template that a chain must cover; one of fewer than ``whole`` words is covered whole,
    as a single word may tell it from another licence."""

    templates: list[tuple[str, str]] = field(default_factory=lambda: list(TEMPLATES))
    phrases: dict[str, str] = field(default_factory=lambda: dict(PHRASES))
    min_match: int = 3
    max_gap: int = 6
    coverage: float = 0.75
    whole: int = 8

    def __post_init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        code = lambda text: [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in WORD.findall(text.encode().lower())]
        self.coded_phrases = {k: code(v) for k, v in self.phrases.items()}
        self.sequences = [code(text) for _, text in self.templates]
        automaton = Automaton()
        for k, sequence in enumerate(self.sequences):
            automaton.add(sequence, k)
        self.automaton = automaton.finish()
        self.reach = self._reach()

    def _reach(self) -> list[dict[tuple[int, int], int]]:
        """Of each state, the longest match of every (template, end) of it and its suffix links, as far as long enough."""
        a = self.automaton
        out: list[dict[tuple[int, int], int]] = [{} for _ in a.next]
        for state in sorted(range(1, len(a.next)), key=a.length.__getitem__):
            own = dict(out[a.link[state]]) if a.link[state] > 0 else {}
            if a.length[state] >= self.min_match:
                own |= dict.fromkeys(a.ends[state], a.length[state])
            out[state] = own
        return out

    def spans(self, codes: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, coverage) of each template chain that covers enough."""
        known = np.flatnonzero(codes)
        if known.size < self.min_match:
            return []
        breaks = np.flatnonzero(np.diff(known) > 1)
        starts, ends = np.r_[0, breaks + 1], np.r_[breaks, known.size - 1]
        long = np.flatnonzero(ends - starts + 1 >= self.min_match)
        found: dict[int, list[tuple[int, int, int]]] = {}  # template: (text end, template end, length)
        for r in long.tolist():
            at = int(known[starts[r]])
            stats = self.automaton.statistics(codes[at : int(known[ends[r]]) + 1].tolist())
            here: dict[tuple[int, int], int] = {}
            for i, (n, state) in enumerate([*stats, (0, 0)]):
                after = {k: min(n, m) for k, m in self.reach[state].items()} if n >= self.min_match else {}
                for (template, end), size in here.items():  # matches that cannot be extended
                    if after.get((template, end + 1), 0) <= size:
                        found.setdefault(template, []).append((at + i - 1, end, size))
                here = after
        out = []
        for template, matches in found.items():
            size = len(self.sequences[template])
            least = 1.0 if size < self.whole else self.coverage
            out += [(self.templates[template][0], a, b, covered / size) for a, b, covered in self._chains(sorted(set(matches))) if covered / size >= least]
        return sorted(out)

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(first word, last word, words covered) of the best chains of one template's matches, none overlapping.

        A chain goes forward in text and template, over at most ``max_gap`` words of text between matches; only matches
        that near are tried as predecessors, so the time grows with the text, not with its square."""
        best: list[tuple[int, int]] = []  # words covered, first word
        for j, (stop, end, n) in enumerate(matches):
            top = (n, stop - n + 1)
            i = j - 1
            while i >= 0 and matches[i][0] >= stop - n - self.max_gap:
                if matches[i][0] < stop and matches[i][1] < end:
                    top = max(top, (best[i][0] + min(n, end - matches[i][1], stop - matches[i][0]), best[i][1]))
                i -= 1
            best.append(top)
        out: list[tuple[int, int, int]] = []
        taken: list[tuple[int, int]] = []
        for (covered, first), (stop, _, _) in sorted(zip(best, matches, strict=True), key=lambda x: (-x[0][0], x[1])):
            at = bisect.bisect(taken, (stop + 1,))
            if not at or taken[at - 1][1] < first:
                taken.insert(at, (first, stop))
                out.append((first, stop, covered))
        return out

    def scan(self, text: bytes | None) -> dict:
        words = WORD.findall((text or b"").lower())
        get = self.vocabulary.get
        codes = np.array([get(w, 0) for w in words], np.int32)
        places: dict[str, np.ndarray] = {}
        for label, phrase in self.coded_phrases.items():
            n = len(words) - len(phrase) + 1
            if n > 0 and (hit := np.flatnonzero(np.logical_and.reduce([codes[i : i + n] == c for i, c in enumerate(phrase)]))).size:
                places[label] = hit
        spans = self.spans(codes)
        base = sorted(places)
        return {
            "n_words": len(words),
            "n_base": sum(p.size for p in places.values()),
            "first_word": min((int(p[0]) for p in places.values()), default=None),
            "last_word": max((int(p[-1]) for p in places.values()), default=None),
            "base_labels": ",".join(base),
            "labels": ",".join(sorted({*base, *(s[0] for s in spans)})),
            "score": max([1.0 if base else 0.0, *(min(1.0, s[3]) for s in spans)]),
            "spans": [{"label": a, "first_word": b, "last_word": c, "coverage": float(d)} for a, b, c, d in spans],
        }


SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())])
FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(SPAN))]


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: LicenseScanner | None = None) -> DataFrame:
    """Per row: id, counts, first and last phrase place, labels, score and the covered template spans.

    One narrow pass, no shuffle. A null or empty text has no words, empty labels and score 0; null ids and repeated
    rows pass as they are; other columns are not read. An empty table gives an empty result."""
    scanner = scanner or LicenseScanner()

    def kernel(chunk: pa.RecordBatch) -> dict:
        rows = [scanner.scan(t) for t in binary(chunk.column("text")).to_pylist()]
        return {k: pa.array([r[k] for r in rows], kind) for k, kind in FIELDS}

    source = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    span = "array<struct<label:string,first_word:bigint,last_word:bigint,coverage:double>>"
    kind = source.schema["doc_id"].dataType.simpleString()
    return mapped(source, kernel, "text", f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {span}", ("doc_id",))

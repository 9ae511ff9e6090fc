"""Operator 2, license scans: template markup compiled to token automata.

A template is licence wording with two kinds of markup:

    [[ wording ]]          an optional region, may hold further markup
    {{lo-hi}}              a replaceable region of lo to hi words of any kind
    {{this work|it}}       a replaceable region with a closed list of wordings

Everything else is mandatory and must match word for word. Words are runs of 0-9, a-z
(after lower-casing A-Z) and non-ASCII characters, so punctuation, case and layout do not
count. A template compiles to a word automaton (Thompson construction, determinised on
the fly); a text is accepted from a start word if some path reaches the end, and the
longest such span is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import text_bytes

# Fixed values of the contract: base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# (label, template). Mandatory wording outside the markup.
TEMPLATES = [
    ("apache-2.0", "licensed under the Apache License[[,]] Version 2.0 [[(the License)]]"),
    ("gpl-3.0", "licensed under [[the terms of]] the GNU General Public License[[,]] version 3 [[or (at your option) any later version]]"),
    ("gpl-2.0", "licensed under [[the terms of]] the GNU General Public License[[,]] version 2 [[or (at your option) any later version]]"),
    ("mit-notice", "{{released|licensed|distributed|available}} under the [[terms of the]] MIT License"),
    ("cc-by-4.0", "licensed under [[a]] {{creative commons|cc}} {{by|attribution}} 4.0 [[international]]"),
    ("cc-by-nc-4.0", "licensed under [[a]] {{creative commons|cc}} {{by|attribution}} {{nc|noncommercial}} 4.0 [[international]]"),
    ("cc-by-sa-4.0", "licensed under [[a]] {{creative commons|cc}} {{by|attribution}} {{sa|sharealike}} 4.0 [[international]]"),
    ("bsd-head", "redistribution and use in source and binary forms[[,]] with or without modification[[,]] are permitted "
                 "provided that the following conditions are met"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of {{1-6}} to deal in "
                  "{{1-4}} without restriction [[including without limitation the rights to use copy modify merge publish "
                  "distribute sublicense and or sell copies of {{1-4}}]]"),
    ("all-rights", "copyright [[(c)]] {{1-6}} all rights reserved"),
]

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass
class Automaton:
    """Word automaton of one template. States are bit positions; ``step`` determinises lazily."""

    label: str
    edges: list[dict[bytes | None, int]] = field(default_factory=list)  # state -> word (None: any) -> target mask
    eps: list[int] = field(default_factory=list)
    start: int = 0
    final: int = 0
    runs: list[bytes] = field(default_factory=list)  # mandatory word runs, each " w1 w2 " in every accepted text
    vocabulary: frozenset = frozenset()
    cache: dict = field(default_factory=dict)

    def state(self) -> int:
        self.edges.append({})
        self.eps.append(0)
        return len(self.edges) - 1

    def closure(self, mask: int) -> int:
        todo, seen = mask, mask
        while todo:
            low = todo & -todo
            todo ^= low
            new = self.eps[low.bit_length() - 1] & ~seen
            seen |= new
            todo |= new
        return seen

    def step(self, mask: int, word: bytes) -> int:
        key = (mask, word if word in self.vocabulary else None)
        if (out := self.cache.get(key)) is None:
            out, rest = 0, mask
            while rest:
                low = rest & -rest
                rest ^= low
                e = self.edges[low.bit_length() - 1]
                out |= e.get(None, 0)
                if key[1] is not None:
                    out |= e.get(word, 0)
            out = self.cache[key] = self.closure(out)
        return out

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted span from ``at``, or -1."""
        mask, end, i = self.closure(1 << self.start), -1, at
        while mask:
            if mask >> self.final & 1:
                end = i
            if i == len(words):
                break
            mask = self.step(mask, words[i])
            i += 1
        return end


def compile_template(label: str, template: str) -> Automaton:
    a = Automaton(label)
    vocabulary: set[bytes] = set()
    run: list[bytes] = []

    def close_run() -> None:
        if run:
            a.runs.append(b" " + b" ".join(run) + b" ")
            run.clear()

    def chain(at: int, words: list[bytes]) -> int:
        for w in words:
            vocabulary.add(w)
            to = a.state()
            a.edges[at][w] = a.edges[at].get(w, 0) | 1 << to
            at = to
        return at

    at = a.start = a.state()
    depth: list[int] = []
    for part in re.split(r"(\[\[|\]\]|\{\{.*?\}\})", template):
        if part == "[[":
            close_run()
            depth.append(at)
        elif part == "]]":
            if not depth:
                raise ValueError(f"{label}: ]] without [[")
            to = a.state()
            a.eps[at] |= 1 << to
            a.eps[depth.pop()] |= 1 << to
            at = to
        elif part.startswith("{{"):
            close_run()
            if m := re.fullmatch(r"\{\{(\d+)-(\d+)\}\}", part):
                lo, hi = int(m[1]), int(m[2])
                if hi < lo:
                    raise ValueError(f"{label}: {part} has no length")
                end = a.state()
                for n in range(hi + 1):
                    if n >= lo:
                        a.eps[at] |= 1 << end
                    if n < hi:
                        to = a.state()
                        a.edges[at][None] = a.edges[at].get(None, 0) | 1 << to
                        at = to
                at = end
            else:
                end = a.state()
                for wording in part[2:-2].split("|"):
                    a.eps[chain(at, words_of(wording.encode()))] |= 1 << end
                at = end
        else:
            words = words_of(part.encode())
            at = chain(at, words)
            if not depth:
                run += words
    close_run()
    if depth:
        raise ValueError(f"{label}: [[ without ]]")
    a.final, a.vocabulary = at, frozenset(vocabulary)
    if a.closure(1 << a.start) >> a.final & 1 or not a.runs:
        raise ValueError(f"{label}: a template needs mandatory wording")
    return a


def starts(automaton: Automaton, words: list[bytes], joined: bytes) -> Iterator[int]:
    """Words at which a match can begin: those that leave the start state, in texts that hold all mandatory runs."""
    if all(r in joined for r in automaton.runs):
        begin = automaton.closure(1 << automaton.start)
        for i, w in enumerate(words):
            if automaton.step(begin, w):
                yield i


def scan_text(text: bytes, automata: list[Automaton], phrases: list[tuple[bytes, str]]) -> tuple[int, list, list]:
    """Number of words, base places (label, word), template spans (label, first word, end word)."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    places = []
    for phrase, label in phrases:
        at, counted, word = joined.find(phrase), 0, 0
        while at >= 0:
            word += joined.count(b" ", counted, at)
            counted = at
            places.append((label, word))
            at = joined.find(phrase, at + 1)
    spans = []
    for a in automata:
        for i in starts(a, words, joined):
            if (end := a.longest(words, i)) >= 0:
                spans.append((a.label, i, end))
    return len(words), places, spans


RESULT = (
    "doc_id long, n_words long, places array<struct<label:string,word:long>>, "
    "spans array<struct<label:string,first:long,end:long>>"
)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, places (base phrase label and start word), spans (template label, first word, word after the last).

    Whole texts, one pass, no shuffle; one row per row of ``docs``. A null text counts as
    empty: no words, empty lists. Equal rows give equal rows. Empty table: no rows. Other
    columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    fixed = [(b" " + p.encode() + b" ", label) for p, label in (PHRASES if phrases is None else phrases).items()]
    for label, t in templates:
        compile_template(label, t)  # wrong markup fails here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [compile_template(*t) for t in templates]
        for b in batches:
            found = [scan_text(t.as_py(), automata, fixed) for t in b.column(1)]
            yield pa.record_batch(
                [
                    b.column(0),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([[{"label": x, "word": w} for x, w in p] for _, p, _ in found],
                             pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
                    pa.array([[{"label": x, "first": i, "end": e} for x, i, e in s] for _, _, s in found],
                             pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "places", "spans"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_bytes(docs["text"]).alias("t")).mapInArrow(run, RESULT)

"""License scans: templates with optional and replaceable regions, compiled into token automata.

A template is its wording in lower case. ``[ ... ]`` may be left out, ``{n}`` stands for one to n words of any kind,
all other words are mandatory and must stand there exactly. An automaton's states are places in the template; it reads
the words of a text one by one and accepts when it comes to the end. Automata start only where a text has the
template's longest run of mandatory words, which is looked for first.

Defined results: a null or empty text, or one without words, has no places and no labels. Repeated rows are scanned
each. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbytes import ALNUM, LOWER, column_bytes, row_runs, words

#: Fixed values of the contract: a phrase's words, and its label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Labels of this method and the wording that each asks for.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 [ the license ] [ you may not use this file except in compliance with the license ]",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "[ this work is ] licensed under [ a ] cc by 4 0",
    "cc-by-nc": "[ this work is ] licensed under [ a ] cc by nc [ {1} 0 ]",
    "cc-by-sa": "[ this work is ] licensed under [ a ] cc by sa [ {1} 0 ]",
    "cc0": "[ this work is ] dedicated to the public domain [ under cc0 ]",
    "copyright": "copyright [ c ] {8} all rights reserved",
    "gpl-notice": "[ this {3} is ] licensed under the gnu general public license [ version {1} ]",
    "gpl-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu [ lesser ] general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this {12} to deal in the software without restriction",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_GAP = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class TokenAutomaton:
    """States 0..n over the template's tokens; each step is (word or None for any, next states by leaving regions out)."""

    def __init__(self, template: str) -> None:
        self.steps: list[tuple[str | None, bool]] = []  # word, mandatory
        self.skips: dict[int, int] = {}  # start of an optional region: its end
        opened: list[int] = []
        anchor: list[str] = []
        runs: list[list[str]] = [anchor]
        for t in template.split():
            if t == "[":
                opened.append(len(self.steps))
                runs.append([])
            elif t == "]":
                self.skips[opened.pop()] = len(self.steps)
                runs.append([])
            elif t[0] == "{":
                n = int(t[1:-1])
                self.steps.append((None, not opened))
                for _ in range(n - 1):  # each further word may be left out, with all that follow it
                    self.skips[len(self.steps)] = len(self.steps) + 1
                    self.steps.append((None, False))
                runs.append([])
            else:
                self.steps.append((t, not opened))
                if not opened:
                    runs[-1].append(t)
        self.anchor = max(runs, key=len)
        self.before = next(i for i in range(len(self.steps)) if [s[0] for s in self.steps[i : i + len(self.anchor)]] == self.anchor and all(s[1] for s in self.steps[i : i + len(self.anchor)]))

    def closure(self, states: set[int]) -> set[int]:
        found, todo = set(states), list(states)
        while todo:
            s = todo.pop()
            if (to := self.skips.get(s)) is not None and to not in found:
                found.add(to)
                todo.append(to)
        return found

    def accepts(self, tokens: list[str], start: int) -> bool:
        """Whether the template, as a whole, begins at this word."""
        states = self.closure({0})
        for t in tokens[start : start + len(self.steps)]:
            if len(self.steps) in states:
                return True
            states = self.closure({s + 1 for s in states if s < len(self.steps) and self.steps[s][0] in (None, t)})
            if not states:
                return False
        return len(self.steps) in states

    def found(self, tokens: list[str], anchors: list[int]) -> bool:
        """anchors: words at which the longest mandatory run begins; no start lies further before it than its steps."""
        return any(self.accepts(tokens, s) for a in anchors for s in range(a, max(-1, a - self.before - 1), -1))


@cache
def automata() -> dict[str, TokenAutomaton]:
    return {k: TokenAutomaton(v) for k, v in sorted(TEMPLATES.items())}


@cache
def _patterns() -> list[tuple[bool, str, re.Pattern, int]]:
    """Phrases of the contract, and runs of mandatory words: is base, label, pattern, words."""
    phrase = lambda w: re.compile(_GAP.join(map(str.encode, w)))
    return [(True, v, phrase(k.split()), len(k.split())) for k, v in BASE.items()] + [(False, k, phrase(a.anchor), len(a.anchor)) for k, a in automata().items()]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for a, b in row_runs(offsets):
            text, at = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
            begins, ends, count = words(text, at, ALNUM)
            first = np.cumsum(count) - count
            raw = text.tobytes()
            places: dict[int, list[int]] = {}
            labels: dict[int, set[str]] = {}
            anchors: dict[tuple[int, str], list[int]] = {}
            for base, label, pattern, n in _patterns():
                for m in pattern.finditer(raw):
                    w = int(np.searchsorted(begins, m.start()))
                    if w + n > len(begins) or begins[w] != m.start() or ends[w + n - 1] != m.end():
                        continue
                    row = int(np.searchsorted(first, w, "right")) - 1
                    if w + n > first[row] + count[row]:
                        continue  # goes on in the next text
                    if base:
                        places.setdefault(row, []).append(w - int(first[row]))
                        labels.setdefault(row, set()).add(label)
                    else:
                        anchors.setdefault((row, label), []).append(w - int(first[row]))
            own: dict[int, set[str]] = {}
            for (row, label), starts in anchors.items():
                f = int(first[row])
                tokens = [raw[x:y].decode() for x, y in zip(begins[f : f + count[row]].tolist(), ends[f : f + count[row]].tolist(), strict=True)]
                if automata()[label].found(tokens, starts):
                    own.setdefault(row, set()).add(label)
            rows = range(b - a)
            join = lambda x: ",".join(sorted(x))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0)[a:b],
                    "n_words": count.astype(np.int64),
                    "n_base": pa.array([len(places.get(r, ())) for r in rows], pa.int64()),
                    "first_word": pa.array([min(places[r]) if r in places else None for r in rows], pa.int64()),
                    "last_word": pa.array([max(places[r]) if r in places else None for r in rows], pa.int64()),
                    "base_labels": pa.array([join(labels.get(r, ())) for r in rows], pa.string()),
                    "labels": pa.array([join(labels.get(r, set()) | own.get(r, set())) for r in rows], pa.string()),
                    "score": pa.array([0.5 * (r in labels) + 0.5 * (r in own) for r in rows], pa.float64()),
                }
            )


def scan(docs: DataFrame) -> DataFrame:
    """A row for each text; score: half for a base phrase, half for a template that is there as a whole."""
    return docs.select("doc_id", "text").mapInArrow(_scan, SCAN)


def sql() -> str:
    """The same in DuckDB's SQL, the templates as regular expressions over the words."""
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def regex(template: str) -> str:
        out = ""
        for t in template.split():
            out += "(?:" if t == "[" else ")?" if t == "]" else f"(?:[^ ]+ ){{1,{t[1:-1]}}}" if t[0] == "{" else t + " "
        return " " + out

    phrases = ", ".join(f"(['{chr(39).join([]) + (chr(39) + ', ' + chr(39)).join(k.split())}'], '{v}')" for k, v in BASE.items())
    own = ", ".join(f"CASE WHEN regexp_matches(s, '{regex(v)}') THEN '{k}' END" for k, v in sorted(TEMPLATES.items()))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({lower}, '{word}') AS w FROM documents),
p(p, label) AS (VALUES {phrases}),
m AS (SELECT rid, label, i FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d), p WHERE w[i:i + len(p) - 1] = p),
b AS (SELECT rid, count(*) AS n, min(i) - 1 AS f, max(i) - 1 AS l, list(DISTINCT label) AS labels FROM m GROUP BY rid),
t AS (SELECT rid, list_filter([{own}], lambda x: x IS NOT NULL) AS own FROM (SELECT rid, ' ' || array_to_string(w, ' ') || ' ' AS s FROM d))
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), own))), ','), '') AS labels,
  0.5 * (n IS NOT NULL)::INT + 0.5 * (len(own) > 0)::INT AS score
FROM d LEFT JOIN b USING (rid) JOIN t USING (rid)"""

"""License scans: exact base phrases, and fuzzy short notices.

A notice of length n may match with up to EDITS_SHARE * n edits. Split into one piece more than that, at least one
piece must stand in the text unchanged (pigeonhole), so an Aho-Corasick automaton over all pieces gives candidate
windows without losing any; the regex library's bounded-error matching then verifies each and gives its span.

Words are runs of characters that are not ASCII marks or space, of the text with A-Z lower-cased; phrases and
notices are matched in the words joined by single spaces. Exact places of a notice come first; what lies between them
is searched with edits. Every step is linear in the text, however many notices it holds.

Edge cases: columns of docs that bear a result's name are replaced; a null or empty text has no words and score 0; places that overlap are all counted for base phrases; a
text of any length is searched whole; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegauge.llm.common import appended, texts_of

#: The base phrases with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices with their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the bsd license": "bsd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nd": "cc-by-nd",
    "permission to use copy modify and or distribute this software": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
EDITS_SHARE = 0.08
#: ASCII marks and controls become spaces; A-Z become lower case.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def edits(notice: str) -> int:
    return int(EDITS_SHARE * len(notice))


def pieces(notice: str) -> list[tuple[int, str]]:
    """(offset, piece) of the edits + 1 pieces."""
    k = edits(notice) + 1
    cuts = [len(notice) * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES):
        import ahocorasick
        import regex

        self.phrases = [(f" {p} ", label) for p, label in phrases.items()]
        self.notices = list(notices.items())
        bounded = lambda n: f"(?:{regex.escape(n, literal_spaces=True)}){{e<={edits(n)}}}"
        #: Per notice: finds the next place that matches, and the best match of a short stretch.
        self.next = [regex.compile("(?e)" + bounded(n)) for n, _ in self.notices]
        self.best = [regex.compile("(?be)" + bounded(n)) for n, _ in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (n, _) in enumerate(self.notices):
            for at, piece in pieces(n):
                seeds.setdefault(piece, []).append((k, at))
        self.seeds = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.seeds.add_word(piece, (len(piece), owners))
        self.seeds.make_automaton()

    def base(self, words: str) -> tuple[list[int], set[str]]:
        """Characters at which all places of the phrases in ` w1 w2 ... ` begin, and their labels."""
        places, labels = [], set()
        for phrase, label in self.phrases:
            at = words.find(phrase)
            while at >= 0:
                places.append(at)
                labels.add(label)
                at = words.find(phrase, at + 1)
        return places, labels

    def _fuzzy(self, k: int, words: str, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, edits) of the matches of a notice in words[a:b], from left to right."""
        while m := self.next[k].search(words, a, b):
            # the first fit may begin too early, so the best one that begins inside it stands
            better = self.best[k].search(words, m.start(), min(b, m.end() + len(self.notices[k][0])))
            if better and sum(better.fuzzy_counts) < sum(m.fuzzy_counts) and better.start() < m.end():
                m = better
            yield m.start(), m.end(), sum(m.fuzzy_counts)
            a = max(m.end(), a + 1)

    def spans(self, words: str, number: Callable[[int], int]) -> list[tuple[int, int, str, float]]:
        """(first word, words, label, similarity) of each notice found in ` w1 w2 ... `; number(i) counts the spaces
        before character i."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, owners) in self.seeds.iter(words):
            for k, at in owners:
                n, slack = len(self.notices[k][0]), edits(self.notices[k][0])
                start = end - size + 1 - at
                windows.setdefault(k, []).append([max(0, start - slack), start + n + slack])
        out = []
        for k, found in windows.items():
            notice, label = self.notices[k]
            merged: list[list[int]] = []
            for a, b in sorted(found):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                hits, at = [], words.find(notice, a, b)
                while at >= 0:  # exact places first; what lies between them may still match with edits
                    hits += [*self._fuzzy(k, words, a, at), (at, at + len(notice), 0)]
                    a = at + len(notice)
                    at = words.find(notice, a, b)
                for start, end, wrong in [*hits, *self._fuzzy(k, words, a, min(b, len(words)))]:
                    if not wrong:  # letters that go on at an end are edits too
                        wrong = (words[start - 1 : start] != " ") + (words[end : end + 1] != " ")
                    if wrong > edits(notice):
                        continue
                    first = number(start + 1) - 1 + (words[start] == " ")
                    out.append((max(0, first), len(words[start:end].split()), label, 1 - wrong / len(notice)))
        return self._standing(out)

    @staticmethod
    def _standing(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
        """Of overlapping spans the most similar stand, so an exact version number beats a near one."""
        kept: list[tuple[int, int, str, float]] = []
        covered: list[list[int]] = []  # apart from each other, in order
        for _, level in groupby(sorted(set(spans), key=lambda x: -x[3]), key=lambda x: x[3]):
            free = []
            for x in level:
                i = bisect_left(covered, [x[0] + x[1]]) - 1  # the last one that begins before x ends
                if i < 0 or covered[i][1] <= x[0]:
                    free.append(x)
            kept += free
            merged: list[list[int]] = []
            for a, b in sorted([*covered, *([x[0], x[0] + x[1]] for x in free)]):
                if merged and a < merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            covered = merged
        return sorted(kept)

    def scan(self, text: bytes) -> tuple:
        folded = b" ".join(text.translate(FOLD).split())
        words = f" {folded.decode('utf-8', 'replace')} " if folded else ""
        gaps: list[int] = []

        def number(i: int) -> int:
            if not gaps:  # found once, and only in texts with a hit
                gaps.extend(m.start() for m in re.finditer(" ", words))
            return bisect_left(gaps, i)

        at, labels = self.base(words)
        places = [number(i) for i in at]
        spans = self.spans(words, number)
        every = labels | {s[2] for s in spans}
        score = 1.0 if labels else max((s[3] for s in spans), default=0.0)
        return (len(folded.split()), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, spans)


SPANS = T.ArrayType(T.StructType().add("first_word", "long").add("n_words", "long").add("label", "string").add("similarity", "double"))
RESULT = T.StructType().add("n_words", "long").add("n_base", "long").add("first_word", "long").add("last_word", "long").add("base_labels", "string").add("labels", "string").add("score", "double").add("spans", SPANS)
_scanners: dict[str, Scanner] = {}


def scan_licenses(docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """docs with the columns of RESULT; columns of the same names are replaced."""
    phrases, notices = phrases or PHRASES, notices or NOTICES
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("similarity", pa.float64())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        key = repr((phrases, notices))
        scanner = _scanners.get(key) or _scanners.setdefault(key, Scanner(phrases, notices))
        rows = [scanner.scan(t) for t in texts_of(batch.column(text))]
        columns = [list(c) for c in zip(*rows)]
        columns[-1] = [[dict(zip(("first_word", "n_words", "label", "similarity"), s)) for s in spans] for spans in columns[-1]]
        return [pa.array(c, t) for c, t in zip(columns, kinds)]

    return appended(docs, list(RESULT), make, text)

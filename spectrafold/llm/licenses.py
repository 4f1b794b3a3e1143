"""Licence scan: short notices found with a bounded number of edits.

A text becomes its lower-case words with one space between. A notice with k edits allowed is
cut into k + 1 pieces; k edits cannot touch all of them, so one piece stands exactly
(pigeonhole). The pieces of all notices are sought at once by an Aho-Corasick automaton; around
each hit the regex library matches the whole notice with its bounded-error syntax and reports
span and edits. Every hit of every piece is followed up; nothing is capped.

One pass over the texts, no shuffle; the fixed notices travel with the function.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import regex
from pyspark.sql import DataFrame

from spectrafold.llm.frames import mapped
from spectrafold.llm.words import ALNUM

# Phrases whose places are counted, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Notices sought with edits, their labels, and the edits allowed.
NOTICES = (
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("licensed under cc by sa", "cc-by-sa", 1),
    ("creative commons attribution", "creative-commons", 2),
    ("licensed under the gnu general public license", "gpl-notice", 3),
    ("gnu lesser general public license", "lgpl", 2),
    ("licensed under the apache license version 2", "apache-2.0", 3),
    ("licensed under the mozilla public license", "mpl", 3),
    ("released under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person", "mit", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
)


@dataclass(frozen=True)
class Place:
    """A notice found: words first..last, its label, the edits it took."""

    first: int
    last: int
    label: str
    edits: int
    score: float


def normal(text: str | None) -> str:
    """Lower-case words (ASCII letters and digits, and everything beyond ASCII), spaced by one."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(ALNUM)
    return b" ".join(raw.split()).decode("utf-8", "replace")


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces of nearly equal length, with their offsets."""
    n = edits + 1
    cuts = [len(notice) * k // n for k in range(n + 1)]
    return [(lo, notice[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def phrase_places(line: str, phrases: dict[str, str]) -> list[tuple[int, str]]:
    """Word index and label of each place where a phrase's words stand consecutively."""
    found = []
    spaced = f" {line} "
    for phrase, label in phrases.items():
        sought, at = f" {phrase} ", -1
        while (at := spaced.find(sought, at + 1)) >= 0:
            found.append((spaced.count(" ", 0, at), label))
    return found


class Scanner:
    """Finds notices with bounded edits."""

    def __init__(self, notices=NOTICES):
        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, _, edits) in enumerate(notices):
            for offset, piece in pieces(notice, edits):
                by_piece.setdefault(piece, []).append((k, offset))
        for piece, owners in by_piece.items():
            self.seeds.add_word(piece, (len(piece), owners))
        if by_piece:
            self.seeds.make_automaton()
        self.match = [
            regex.compile(rf"(?e)\b(?:{regex.escape(n, literal_spaces=True)}){{e<={e}}}(?!\w)")
            for n, _, e in notices
        ]

    def find(self, line: str) -> list[Place]:
        """Places in a normal line, by position. Overlapping hits of one notice count once."""
        if not len(self.seeds):
            return []
        spans: dict[int, list[list[int]]] = {}
        for end, (size, owners) in self.seeds.iter(line):
            begin = end + 1 - size
            for k, offset in owners:
                notice, _, edits = self.notices[k]
                lo = max(0, begin - offset - edits)
                hi = min(len(line), begin - offset + len(notice) + edits)
                own = spans.setdefault(k, [])
                if own and lo <= own[-1][1]:
                    own[-1] = [min(lo, own[-1][0]), max(hi, own[-1][1])]
                else:
                    own.append([lo, hi])
        out = []
        for k, own in spans.items():
            notice, label, edits = self.notices[k]
            for lo, hi in own:
                # Whole words at both ends, so that \b sees what stands beyond the span.
                lo = line.rfind(" ", 0, lo) + 1
                hi = len(line) if (cut := line.find(" ", hi)) < 0 else cut
                for m in self.match[k].finditer(line, lo, hi):
                    took = sum(m.fuzzy_counts)
                    first = line.count(" ", 0, m.start() + (m.group()[:1] == " "))
                    last = first + m.group().strip().count(" ")
                    out.append(Place(first, last, label, took, 1 - took / len(notice)))
        return sorted(out, key=lambda p: (p.first, p.last, p.label))


def scan(docs: DataFrame, text: str = "text", phrases=None, notices=NOTICES) -> DataFrame:
    """``docs`` with the licence findings of each whole text.

    Added: n_words; n_base, first_word, last_word, base_labels (places of ``phrases``); places
    (array of first, last, label, edits, score of the notices); labels (both kinds, distinct,
    sorted, comma-joined); score (1 where a phrase stands, else the best of the notices, else
    0). A null or empty text has no words, no places, null word indexes, empty labels and
    score 0. Columns with one of these names are replaced.
    """
    phrases = PHRASES if phrases is None else phrases
    added = (
        "n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "places array<struct<first:long,last:long,label:string,edits:int,score:double>>, "
        "labels string, score double"
    )
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "places", "labels", "score")

    def start():
        scanner = Scanner(notices)

        def one(value: str | None) -> tuple:
            line = normal(value)
            base = phrase_places(line, phrases)
            places = scanner.find(line)
            at = [k for k, _ in base]
            return (
                line.count(" ") + 1 if line else 0,
                len(base),
                min(at, default=None),
                max(at, default=None),
                ",".join(sorted({x for _, x in base})),
                [p.__dict__ for p in places],
                ",".join(sorted({x for _, x in base} | {p.label for p in places})),
                1.0 if base else max((p.score for p in places), default=0.0),
            )

        def compute(texts):
            rows = [one(t) for t in texts]
            return {name: [r[k] for r in rows] for k, name in enumerate(names)}

        return compute

    return mapped(docs, added, start, [text])

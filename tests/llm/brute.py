"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text, pattern=SPACED, lower=False):
    raw = (text or "").encode()
    return pattern.findall(raw.translate(LOWER) if lower else raw)


def shingles(ws, n, whole=True):
    if len(ws) >= n:
        return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
    return {tuple(ws)} if whole and ws else set()


def components(docs, n=4, num=85, den=100):
    """doc_id -> (set size, component) of (doc_id, text) rows with distinct ids."""
    sets = {d: shingles(words(t, lower=True), n) for d, t in docs}
    label = {d: d for d in sets}
    linked = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b]
        and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {d: (len(sets[d]), label[d]) for d in sets}


def substrings(docs, length=50):
    """doc_id -> (words, removed, sha256 of what is kept)."""
    cut = {d: words(t) for d, t in docs}
    first: dict[tuple, int] = {}
    for d in sorted(cut):
        for i in range(len(cut[d]) - length + 1):
            first.setdefault(tuple(cut[d][i : i + length]), d)
    out = {}
    for d, ws in cut.items():
        gone = set()
        for i in range(len(ws) - length + 1):
            if first[tuple(ws[i : i + length])] < d:
                gone.update(range(i, i + length))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        out[d] = (len(ws), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def contained(docs, items, n=5):
    """(doc_id, item_id) pairs with at least 0.8 of the item's shingles in the document."""
    own = {i: shingles(words(t, ALNUM, True), n, whole=False) for i, t in items}
    out = set()
    for d, t in docs:
        held = shingles(words(t, ALNUM, True), n, whole=False)
        for i, s in own.items():
            if s and 10 * len(s & held) >= 8 * len(s):
                out.add((d, i))
    return out


def tokens(word, pieces, byte):
    """Tokens of the best segmentation of a pre-token, by the whole recursion."""
    score, count = [0.0], [0]
    longest = max(map(len, pieces))
    for end in range(1, len(word) + 1):
        best, n = -math.inf, 0
        for begin in range(max(0, end - longest), end):
            s = pieces.get(word[begin:end])
            if s is not None and score[begin] + s > best:
                best, n = score[begin] + s, count[begin] + 1
        if best == -math.inf:
            size = len(word[end - 1].encode())
            best, n = score[end - 1] + size * byte, count[end - 1] + size
        score.append(best)
        count.append(n)
    return count[-1]


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def licences(text):
    """(words, places, first, last, labels) of the base phrases."""
    ws = [w.decode("utf-8", "replace") for w in words(text, ALNUM, True)]
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def edits(a, b):
    """Edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def auc(scores, labels):
    ranked, below = defaultdict(lambda: [0, 0]), 0
    for s, y in zip(scores, labels):
        ranked[s][y] += 1
    total = 0.0
    for s in sorted(ranked):
        neg, pos = ranked[s]
        total += pos * (below + neg / 2)
        below += neg
    return total / max(1, sum(labels)) / max(1, below)

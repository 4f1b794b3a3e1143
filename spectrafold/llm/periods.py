"""Periodic runs in texts: every stretch of words that repeats itself, by maximal pairs.

A run of period q and length L, extended as far as it goes, is a *maximal pair*: its first L - q
words stand again q words later, the words before the two places differ, and so do the words
behind them. So runs need no extension: they are read off the maximal pairs whose distance is
small against their length.

For a batch of texts:

1. Words become 64-bit hashes. Texts in which no sequence of ``SHORTEST`` words stands twice have no
   run; the others get suffix ranks by prefix doubling (an alphabet of its own for each text,
   so that no two texts share a suffix) and the common prefixes (LCP) of neighbouring suffixes.
2. The LCP-interval tree is walked bottom-up. An interval holds the places where its sequence
   stands, and lists of them by the word to the left. Where two children meet in an interval
   of length l, places with different left words at most l / (least - 1) words apart are
   maximal pairs, thus runs. The smaller side is looked up in the larger one, and stretches
   of places with the same left word are leapt over, so a text costs n log^2 n steps even if it
   repeats one word.
3. Multiples of a run's period give pairs of the same start and length; the smallest period
   is the run's.

Whole subtrees are passed over whose nearest places are too far apart. All work is within one row;
nothing is shuffled. Memory: one batch of about four million characters, or one text if it is longer.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.llm.frames import mapped
from spectrafold.llm.words import PLAIN, Words, batches, mix, sequences, split

SHORTEST = 6  # words of a run, at least
LEAST = 4  # periods of a run, at least
RUNS = "array<struct<start:long,length:long,period:long>>"


def suffix_ranks(ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array of ``ids`` (dense numbers from 0), and the ranks by the first h words for each h met.

    Ranks are places in the suffix order where groups of equal prefixes begin, so refining a
    group leaves all others as they are; only groups of several are sorted again.
    """
    n = len(ids)
    width = int(ids.max()) + 2
    at = [np.append(ids + 1, np.zeros(2, np.int64))[k : k + n] for k in range(3)]
    if width <= 2_000_000:
        _, inverse, counts = np.unique((at[0] * width + at[1]) * width + at[2], return_inverse=True, return_counts=True)
    else:
        _, inverse, counts = np.unique(np.stack(at, 1), axis=0, return_inverse=True, return_counts=True)
        inverse = inverse.ravel()
    rank = (np.cumsum(counts) - counts)[inverse]
    levels = [(1, ids.astype(np.int32)), (3, rank.astype(np.int32))]
    open_ = np.flatnonzero(counts[inverse] > 1)
    h = 3
    while len(open_):
        behind = open_ + h
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        key = (rank[open_] << 32) | second
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        group = key >> 32
        fresh = np.append(True, key[1:] != key[:-1])
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        first = np.repeat(start, np.diff(np.append(start, len(group))))  # of the old group
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(key)))
        rank = rank.copy()
        rank[open_] = group + np.repeat(begin, size) - first
        h *= 2
        levels.append((h, rank.astype(np.int32)))
        open_ = open_[np.repeat(size > 1, size)]
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Words that each suffix in ``order`` has in common with the next one (0 if fewer than 3)."""
    n = len(order)
    lcp = np.zeros(max(n - 1, 0), np.int64)
    same = levels[1][1]
    pair = np.flatnonzero(same[order[:-1]] == same[order[1:]])
    a, b = order[pair], order[pair + 1]
    length = np.zeros(len(pair), np.int64)
    for h, rank in [*reversed(levels), levels[0]]:
        i, j = a + length, b + length
        inside = np.maximum(i, j) < n
        equal = inside & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
        length += h * equal
    lcp[pair] = length
    return lcp


class _Places:
    """The places of an interval, in order, and lists of them by the word to the left."""

    __slots__ = ("all", "by_left")

    def __init__(self, place: int, left: int):
        self.all, self.by_left = [place], {left: [place]}


def _leap(places: list, own: list, k: int, o: int, step: int) -> int:
    """How many of ``places`` from k on (in direction ``step``) are those of ``own`` from o on, one by one."""
    room = min(len(places) - k, len(own) - o) if step > 0 else min(k, o) + 1
    lo, hi = 0, 1
    while hi <= room and places[k + (hi - 1) * step] == own[o + (hi - 1) * step]:
        lo, hi = hi, 2 * hi
    hi = min(hi, room + 1)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if places[k + (mid - 1) * step] == own[o + (mid - 1) * step]:
            lo = mid
        else:
            hi = mid
    return lo


def _meet(one: _Places, two: _Places, depth: int, reach: int, left: np.ndarray, found: dict) -> _Places:
    """Report the maximal pairs between two children of an interval; return what it holds after."""
    small, large = (one, two) if len(one.all) <= len(two.all) else (two, one)
    places, by_left = large.all, large.by_left
    for c, own_small in small.by_left.items():
        own = by_left.get(c, [])
        for x in own_small:
            k = bisect_left(places, x)
            for step, at in ((1, k), (-1, k - 1)):
                while 0 <= at < len(places) and abs(places[at] - x) <= reach:
                    y = places[at]
                    o = bisect_left(own, y)
                    if o < len(own) and own[o] == y:
                        at += step * _leap(places, own, at, o, step)
                        continue
                    run = (min(x, y), depth + abs(x - y))
                    found[run] = min(found.get(run, depth), abs(x - y))
                    at += step
    if 8 * len(small.all) > len(places):
        places += small.all
        places.sort()
    else:
        for x in small.all:
            insort(places, x)
    for c, own_small in small.by_left.items():
        own = by_left.get(c)
        if own is None:
            by_left[c] = own_small
        elif 8 * len(own_small) > len(own):
            own += own_small
            own.sort()
        else:
            for x in own_small:
                insort(own, x)
    return large


def maximal_pairs(places: list[int], depths: list[int], left: np.ndarray, least: int) -> dict[tuple[int, int], int]:
    """(start, length) -> smallest period, from one stretch of the suffix order.

    ``depths`` are the common prefixes between neighbours, all above 0.
    """
    found: dict[tuple[int, int], int] = {}
    stack: list[list] = []
    for place, depth in zip(places, [*depths, 0]):
        node = _Places(place, int(left[place]))
        while stack and stack[-1][0] > depth:
            inner, held = stack.pop()
            node = _meet(held, node, inner, inner // (least - 1), left, found)
        if stack and stack[-1][0] == depth:
            stack[-1][1] = _meet(stack[-1][1], node, depth, depth // (least - 1), left, found)
        elif depth:
            stack.append([depth, node])
    return found


def runs(words: Words, shortest: int = SHORTEST, least: int = LEAST) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period), in that order, of the texts that have any, by number of the text."""
    # A pair of distance p is max(shortest - p, (least - 1) p) words long, thus this many at least.
    gram = min(max(shortest - p, (least - 1) * p) for p in range(1, shortest + 1))
    if gram < 3:
        raise ValueError("runs of at least 6 words and 2 periods are found, not shorter ones")
    h = sequences(words, gram)
    if not len(h):
        return {}
    sizes = np.diff(words.first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(h))
    inside = place + gram <= words.first[1:][text[: len(h)]]
    whole = mix(h ^ mix(text[: len(h)].astype(np.uint64) + np.uint64(1)))
    key = np.sort(whole[inside])
    twice = key[1:][key[1:] == key[:-1]]
    if not len(twice):
        return {}
    spot = np.minimum(np.searchsorted(twice, whole), len(twice) - 1)
    texts = np.unique(text[: len(h)][inside & (twice[spot] == whole)])
    chosen = np.concatenate([np.arange(words.first[t], words.first[t + 1]) for t in texts.tolist()])
    owner = text[chosen]
    _, ids = np.unique(mix(words.hash[chosen] ^ mix(owner.astype(np.uint64) + np.uint64(1))), return_inverse=True)
    ids = ids.astype(np.int64)
    left = np.append(-1, ids[:-1])  # the last word of the text before is in no other text
    order, levels = suffix_ranks(ids)
    lcp = common_prefixes(order, levels)

    # Stretches of neighbours with enough in common; a stretch of k places has k - 1 depths.
    deep = np.append(np.append(False, lcp >= gram), False)
    begin, end = np.flatnonzero(~deep[:-1] & deep[1:]), np.flatnonzero(deep[:-1] & ~deep[1:])
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not len(begin):
        return out
    most = np.maximum.reduceat(np.append(lcp, 0), np.stack([begin, end], 1).ravel())[::2]
    size = end - begin + 1
    member = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    stretch = np.repeat(np.arange(len(begin)), size)
    by_place = np.lexsort((order[member], stretch))
    gap = np.diff(order[member][by_place])
    gap[stretch[1:] != stretch[:-1]] = len(order)
    nearest = np.minimum.reduceat(np.append(gap, len(order)), np.cumsum(size) - size)
    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    first = np.repeat(start, np.diff(np.append(start, len(owner))))
    for s in np.flatnonzero(nearest <= most // (least - 1)).tolist():
        lo, hi = int(begin[s]), int(end[s])
        pairs = maximal_pairs(order[lo : hi + 1].tolist(), lcp[lo:hi].tolist(), left, least)
        for (at, length), period in pairs.items():
            if length >= max(shortest, least * period):
                out.setdefault(int(owner[at]), []).append((at - int(first[at]), length, period))
    smallest: dict[int, list[tuple[int, int, int]]] = {}
    for t, found in out.items():
        best: dict[tuple[int, int], int] = {}
        for at, length, period in found:
            best[at, length] = min(best.get((at, length), period), period)
        smallest[t] = sorted((at, length, period) for (at, length), period in best.items())
    return smallest


def collapse(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """``docs`` with its runs and the text in which each run is left with its first period.

    Added: ``n_words``; ``runs``, sorted by start and period, each a stretch of at least ``shortest`` words
    and ``least`` times its smallest period that can be extended to neither side; ``collapsed``, the
    words joined by one space without those that any run contains after its first period.
    Words are divided by ASCII white space and compared as they are, by 64-bit hashes.
    Null, empty and blank texts have no words and no runs. Every row is judged alone, repeated ids and
    null ids included; other columns pass, those named like an added one are replaced.
    """

    def compute(texts):
        made = {"n_words": [], "runs": [], "collapsed": []}
        for part in batches(texts):
            words = split(texts[part], PLAIN)
            of = runs(words, shortest, least)
            for k, (lo, hi) in enumerate(words.texts()):
                made["n_words"].append(hi - lo)
                own = of.get(k, [])
                made["runs"].append([{"start": s, "length": n, "period": p} for s, n, p in own])
                kept = words.joined(lo, hi)
                if own:
                    gone = np.zeros(hi - lo + 1, np.int64)
                    for s, n, p in own:
                        gone[s + p] += 1
                        gone[s + n] -= 1
                    stay = np.cumsum(gone)[:-1] == 0
                    each = kept.split(b" ")
                    kept = b" ".join([each[i] for i in np.flatnonzero(stay).tolist()])
                made["collapsed"].append(kept.decode("utf-8", "surrogatepass"))
        return made

    return mapped(docs, f"n_words long, runs {RUNS}, collapsed string", lambda: compute, ["text"])


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``docs`` in which a tenth of the texts end in a period: a stress of known runs.

    h is the unsigned CRC-32 of the id's decimal digits and g its tenth. Where h ends in 0 and the
    text has n > 0 words, each word from a = g mod n on becomes word a + (i - a) mod p of the
    text, p = 1 + (n - a) div (3 + g mod 8). Rows without an id stay as they are.
    """
    rest = docs.columns
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    cut = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w != '')"
    return (
        docs.withColumn("_h", h)
        .withColumn("_w", F.expr(f"CASE WHEN _h % 10 = 0 THEN {cut} END"))
        .withColumn("_n", F.expr("cast(size(_w) as long)"))
        .withColumn("_a", F.expr("CASE WHEN _n > 0 THEN (_h div 10) % _n END"))
        .withColumn("_p", F.expr("1 + (_n - _a) div (3 + (_h div 10) % 8)"))
        .withColumn(
            "text",
            F.expr(
                "CASE WHEN _a IS NULL THEN text ELSE concat_ws(' ', transform(sequence(0L, _n - 1), "
                "i -> _w[cast(CASE WHEN i < _a THEN i ELSE _a + (i - _a) % _p END as int)])) END"
            ),
        )
        .select(*rest)
    )

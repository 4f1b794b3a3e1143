"""N-gram Jaccard join by partition of the universe of shingles, exact.

A set of n shingles that is similar to one not larger than itself differs from it in at most
H(n) shingles. All shingles are hashed into m segments. If m > H, a similar pair agrees on a whole
segment (pigeonhole), so the hash of each segment's subset is an index key. A segment may also
be indexed with its *one-deletion neighbourhood* (the subset, and the subset without each of its
members): then it also finds pairs that differ there in one shingle, and counts twice.

Sizes are cut into bands; a pair is sought in the band of its larger set, so a set has keys for
its own band and, if a larger partner can be there, for the next. For each band the allocation
(segments, and how many of them have neighbourhoods) is the one of least expected cost: keys
written, plus the sets whose empty segments would leave too little agreement to find.
Those sets (``short``) are found by the keys of their empty segments as well, so nothing is lost.

Documents with equal texts are one representative from the start. Keys that only one
representative has are dropped by a pre-aggregated count. Within a key, the representatives are
compared with one centre (a document that shares fewer keys than every similar pair of its must is left
out, and so are sizes too different); what is connected then needs no further comparison. Keys
that still span several components are open. A similar pair between components shares as many open
keys as it must share keys at all, so documents with fewer are left out, round by round, until
none is. Those that remain are finished exactly: pairs between components that
pass a positional prefix filter on rare shingles are compared too. So a key never makes all its
pairs. Each candidate pair is verified on the shingle sets of the whole texts.

Intermediate tables are deleted by the step that reads them last; of ``report`` only ids, set sizes and
names stay on disk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.llm.frames import discard, mapped, release, stored
from spectrafold.llm.graphs import components
from spectrafold.llm.words import LOWER, batches, mix, shingles, signed, split

WIDTH = 1.4  # ratio of a band's ends
SHORT_COST = 1e6  # what a short set costs, in keys
SPARE = 5  # keys a similar pair shares at least, where no segment has a neighbourhood


def differing(n: int, num: int, den: int) -> int:
    """Most shingles in which a set of ``n`` differs from a similar one that is not larger."""
    return 2 * n * (den - num) // (den + num)


@lru_cache(maxsize=None)
def band_start(k: int) -> int:
    """Smallest size of band ``k``."""
    return 1 if k == 0 else max(band_start(k - 1) + 1, int(band_start(k - 1) * WIDTH))


def band(n: int) -> int:
    k = 0
    while band_start(k + 1) <= n:
        k += 1
    return k


@lru_cache(maxsize=None)
def allocation(k: int, num: int, den: int) -> tuple[int, int]:
    """Segments of band ``k``, and how many of them have one-deletion neighbourhoods.

    (0, 0) if sets of the band can only be similar to equal ones.
    """
    hi = band_start(k + 1) - 1
    most = differing(hi, num, den)
    if most == 0:
        return 0, 0
    best = None
    for near in range(4):
        for m in range(max(most + 1, near), most + 2 + most // 4 + 6):
            slack = m + near - (most + 1) - (0 if near else SPARE - 1)
            if slack < 0:
                continue
            empty = m * (1 - 1 / m) ** hi  # segments expected empty in the band's largest sets
            chance = [exp(-empty) * empty**i / factorial(i) for i in range(min(slack, 60) + 1)]
            # Short: more segments empty than there is slack, or as many and one with a neighbourhood.
            short = max(0.0, 1 - sum(chance)) + chance[-1] * min(1.0, near * slack / m)
            cost = m + near * hi / m + SHORT_COST * short
            if best is None or cost < best[0]:
                best = (cost, m, near)
    return best[1], best[2]


def keys(own: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Index keys of a set of shingle hashes, keys of its empty segments, how many keys it shares with
    any similar set at least, and if it is short.

    A similar pair differs in no more segments than the larger set may differ in shingles, so
    all but so many of the segments this set has members in are keys of both.
    """
    n = len(own)
    at = band(n)
    largest = n * den // num  # size of a similar set, at most
    spread = mix(own ^ np.uint64(0x5851F42D4C957F2D))
    found, empty, spare, short = [], [], SPARE, False
    for k in (at, at + 1):
        if k > at and largest < band_start(k):
            continue  # too small for any partner there
        m, near = allocation(k, num, den)
        if not m:  # similar to equal sets only
            spare = 1
            if k == at:
                found.append(mix(spread.sum(keepdims=True) + np.uint64(k << 32)))
            continue
        segment = ((own >> np.uint64(17)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        inside = segment[order]
        start = np.flatnonzero(np.diff(inside, prepend=-1))
        held = inside[start]
        size = np.diff(np.append(start, n))
        members = spread[order]
        total = np.add.reduceat(members, start)
        name = mix(np.arange(m, dtype=np.uint64) + np.uint64(k << 32))
        found.append(mix(total + name[held]))
        weight = len(held)
        for i in np.flatnonzero((held < near) & (size > 1)).tolist():
            one = members[start[i] : start[i] + size[i]]
            found.append(mix(total[i] - one + name[held[i]]))
            weight += 1
        missing = np.setdiff1d(np.arange(m), held, assume_unique=True)
        if k == at:
            # A short set is sought among all sets that lack the same segment.
            short = weight <= differing(n, num, den)
        agreeing = len(held) - differing(min(largest, band_start(k + 1) - 1), num, den)
        spare = min(spare, max(1, agreeing if near == 0 else 1))
        empty.append(mix(name[missing] + np.uint64(1)))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return np.unique(join(found)), join(empty), spare, short


def _noded(docs: DataFrame) -> DataFrame:
    """doc_id, node (identifies the text: equal texts are one node), text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))


def described(texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Each row's number of shingles and index keys, without its text.

    Raises ValueError where the similarity is below 13/17: its bands would have to be wider.
    """
    if den * 13 > num * 17:
        raise ValueError("similarities below 13/17 need wider bands")

    def one(own: np.ndarray) -> tuple:
        if not len(own):
            return 0, [], [], 1, False
        found, empty, spare, short = keys(own, num, den)
        return len(own), signed(found), signed(empty), int(spare), bool(short)

    def compute(batch):
        rows = []
        for part in batches(batch):
            rows += [one(own) for own in shingles(split(batch[part], LOWER), words)]
        return {name: [r[k] for r in rows] for k, name in enumerate(("n_shingles", "keys", "empty", "spare", "short"))}

    added = "n_shingles long, keys array<long>, empty array<long>, spare int, short boolean"
    return mapped(texts, added, lambda: compute, ["text"], drop=["text"])


def verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for frame in frames:
            linked = []
            for part in batches((frame["text_a"] + frame["text_b"]).tolist()):
                piece = frame.iloc[part]
                seconds = shingles(split(piece["text_b"].tolist(), LOWER), words)
                for a, text, second in zip(piece["a"], piece["text_a"], seconds):
                    if known[0] != a:
                        known = (a, next(shingles(split([text], LOWER), words)))
                    first = known[1]
                    both = len(np.intersect1d(first, second, assume_unique=True))
                    linked.append(den * both >= num * (len(first) + len(second) - both))
            yield frame.loc[linked, ["a", "b"]]

    # Text joins last by ``a``, so a centre's pairs come together.
    return pairs.join(right, "b").join(left, "a").mapInPandas(run, "a long, b long")


def _stars(members: DataFrame) -> DataFrame:
    """key, doc_id and centre of the members that are not their key's centre.

    The centre is the member with the largest degree (members of all its keys): the text that
    others were copied from, rather than one of the copies.
    """
    top = members.groupBy("key").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("id"))).alias("top"))
    centres = stored(top.select("key", (-F.col("top.id")).alias("centre")), "join-centres")
    stars = members.join(centres, "key").filter("doc_id != centre").select("key", "doc_id", "centre")
    stars = stored(stars, "join-stars")
    discard(centres)
    return stars


def _sized(pairs: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow them to be similar."""
    first = sizes.withColumnsRenamed({"doc_id": "a", "n_shingles": "na"})
    second = sizes.withColumnsRenamed({"doc_id": "b", "n_shingles": "nb"})
    fits = f"{den} * least(na, nb) >= {num} * greatest(na, nb)"
    return pairs.join(first, "a").join(second, "b").filter(fits).select("a", "b")


def _unsettled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Documents that may still have a partner in another component.

    Every key that such a pair shares spans several components, and it shares ``spare`` of them at
    least. So documents with fewer open keys are settled; without them other keys may close, and so on.
    """
    held = members.join(comps, "doc_id", "left").select("key", "doc_id", "spare", F.coalesce("comp", "doc_id").alias("comp"))
    held = stored(held, "join-placed")
    before = held.count()
    while True:
        several = held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
        several = stored(several.select("key"), "join-open")
        open_ = stored(held.join(several, "key"), "join-placed")
        discard(several, held)
        enough = open_.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("spare").alias("least"))
        held = stored(open_.join(enough.filter("n >= least").select("doc_id"), "doc_id", "left_semi"), "join-placed")
        discard(open_)
        after = held.count()
        if after == before:
            still = stored(held.select("doc_id").distinct(), "join-still")
            discard(held)
            return still
        before = after


def _members(reps: DataFrame) -> DataFrame:
    """key, doc_id, degree, spare where several representatives have the key."""
    rows = reps.select(F.explode("keys").alias("key"), "doc_id")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Stored first: a join of two plain inputs is one whose hot keys Spark can split.
    sizes = stored(sizes, "join-keys")
    release(rows.sparkSession)
    rows = stored(rows.join(sizes, "key"), "join-members")
    discard(sizes)
    release(rows.sparkSession)
    facts = rows.groupBy("doc_id").agg(F.sum("n").alias("degree"), F.count(F.lit(1)).alias("held"))
    facts = facts.join(reps.select("doc_id", "spare"), "doc_id").filter(F.col("held") >= F.col("spare"))
    members = stored(rows.join(facts.select("doc_id", "degree", "spare"), "doc_id").drop("n"), "join-degrees")
    discard(rows)
    return members


def _prefixes(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, comp, n, place, h: each document's rarest shingles, as many as a similar pair must share one of.

    Rare is what few of these documents have; ties go by hash, so the order is the same for all.
    The sets are made from the texts each time rather than stored.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts, ids = frame.column("text").to_pylist(), frame.column("doc_id").to_numpy()
            for part in batches(texts):
                sets = list(shingles(split(texts[part], LOWER), words))
                own = np.repeat(ids[part], [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(signed(np.concatenate(sets)))], ["doc_id", "h"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h long")
    counts = stored(rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "rare-counts")
    release(docs.sparkSession)
    # Shingles of one document only come first of all and can be shared with nobody.
    ranked = rows.join(counts, "h").groupBy("doc_id").agg(  # a group is one document
        F.sort_array(F.collect_list(F.struct("df", "h"))).alias("ranked")
    )
    ranked = ranked.join(docs.select("doc_id", "comp", "n"), "doc_id")
    length = F.expr(f"cast(n - ({num} * n + {den - 1}) div {den} + 1 as int)")
    alone = F.col("n") - F.size("ranked")
    prefix = F.slice("ranked", F.lit(1), F.greatest(length - alone, F.lit(0)))
    rows = ranked.select("doc_id", "comp", "n", alone.alias("alone"), F.posexplode(prefix).alias("place", "r"))
    rows = rows.select("doc_id", "comp", "n", (F.col("place") + F.col("alone")).alias("place"), F.col("r.h").alias("h"))
    rows = stored(rows, "rare-prefixes")
    discard(counts)
    release(docs.sparkSession)
    return rows


def _remaining(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) between components that may still be similar: every similar one is among them.

    Of a similar pair the first shingle in common, in order of rarity, is in the larger set's
    prefix and in the smaller one's shorter prefix, and what follows it suffices for the
    intersection. A text that differs from all others in enough shingles of its own has only
    those in its prefix and meets nobody, however large its group.
    """
    prefixes = _prefixes(docs, words, num, den)
    several = prefixes.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    rows = stored(prefixes.join(several.select("h"), "h"), "rare-shared")
    discard(prefixes)
    short = F.expr(f"n - ({2 * num} * n + {num + den - 1}) div {num + den} + 1")
    left = rows.filter(F.col("place") < short).withColumnsRenamed({"doc_id": "a", "comp": "ca", "n": "na", "place": "pa"})
    right = rows.withColumnsRenamed({"doc_id": "b", "comp": "cb", "n": "nb", "place": "pb"})
    fits = (
        "ca != cb AND (na < nb OR (na = nb AND a < b)) AND "
        f"{den} * na >= {num} * nb AND {num + den} * least(na - pa, nb - pb) >= {num} * (na + nb)"
    )
    pairs = stored(left.join(right, "h").filter(fits).select("a", "b").distinct(), "rare-pairs")
    discard(rows)
    return pairs


def links(reps: DataFrame, sizes: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Components (doc_id, comp) of the representatives that have a link.

    ``reps`` as ``described`` and stored; deleted here, once its keys are read. ``sizes`` and ``texts``:
    the doc_id, and n_shingles or text, of the same rows.
    """
    members = _members(reps)
    lacking = reps.select(F.explode("empty").alias("key"), "doc_id", "short")
    short = lacking.filter("short").select("key", F.col("doc_id").alias("a"))
    extra = lacking.join(short, "key").filter("a != doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    extra = stored(extra, "join-short")
    discard(reps)
    ids = members.select("doc_id").union(extra.select("a")).union(extra.select("b")).distinct()
    ids = stored(ids, "join-ids")
    release(sizes.sparkSession)
    texts = stored(texts.join(ids, "doc_id"), "join-texts")
    discard(ids)
    release(sizes.sparkSession)

    stars = _stars(members)
    pairs = stars.select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).union(extra).distinct()
    pairs = stored(_sized(pairs, sizes, num, den), "join-pairs")
    discard(stars, extra)
    linked = stored(verified(pairs, texts, words, num, den), "join-links")
    discard(pairs)
    release(sizes.sparkSession)
    comps = components(linked)
    still = _unsettled(members, comps)
    discard(members)
    rest = still.join(sizes.select("doc_id", F.col("n_shingles").alias("n")), "doc_id")
    rest = texts.join(rest.join(comps, "doc_id", "left"), "doc_id")
    rest = rest.select("doc_id", "text", "n", F.coalesce("comp", "doc_id").alias("comp"))
    rest = stored(rest, "join-rest")
    discard(still, texts)
    release(sizes.sparkSession)
    pairs = _remaining(rest, words, num, den)
    more = stored(verified(pairs, rest, words, num, den), "join-more")
    if not more.isEmpty():
        comps = components(linked.union(more))
    discard(pairs, rest, linked, more)
    return comps


def report(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``.

    A document's set are its distinct shingles of ``words`` lower-case words (fewer words: all of
    them as one). Documents link when den * intersection >= num * union; a component is what
    links connect, named by its smallest id. Texts that are null, empty or without words have
    no set and link with nothing. Different texts of one id are judged each on its own; equal rows
    are alike. A row without an id has the component of an equal text, or none.
    """
    rows = stored(_noded(docs).select("doc_id", "node"), "join-nodes")
    least = rows.filter("doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    least = stored(least, "join-least")
    # Of equal texts the row with the smallest id; the join spreads a text that many rows share.
    texts = _noded(docs).join(least, ["node", "doc_id"], "left_semi").dropDuplicates(["node", "doc_id"])
    texts = texts.select(F.col("node").alias("doc_id"), "text")
    reps = stored(described(texts, words, num, den), "join-distinct")  # read several times
    sizes = stored(reps.select("doc_id", "n_shingles"), "join-sizes")
    release(docs.sparkSession)
    comps = links(reps, sizes, texts, words, num, den)
    placed = least.join(comps.withColumnsRenamed({"doc_id": "node"}), "node", "left")
    placed = placed.withColumn("comp", F.coalesce("comp", "node"))
    names = stored(placed.groupBy("comp").agg(F.min("doc_id").alias("name")), "join-names")
    told = placed.join(names, "comp").select("node", "name")
    told = stored(told.join(sizes.withColumnRenamed("doc_id", "node"), "node"), "join-told")
    discard(least, sizes, names)
    found = rows.join(told, "node", "left")
    if not rows.filter("doc_id IS NULL").isEmpty():
        found = _nameless(found, docs, words)
    name = F.when(F.col("n_shingles") > 0, F.col("name")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", name.alias("component_id"))


def _nameless(found: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``found`` with the set sizes of texts that only rows without an id have."""

    def compute(batch):
        sizes = []
        for part in batches(batch):
            sizes += [len(own) for own in shingles(split(batch[part], LOWER), words)]
        return {"own": sizes}

    lone = _noded(docs).filter("doc_id IS NULL").select("node", "text").dropDuplicates(["node"])
    sizes = stored(mapped(lone, "own long", lambda: compute, ["text"], drop=["text"]), "join-lone")
    return found.join(sizes, "node", "left").withColumn("n_shingles", F.coalesce("n_shingles", "own"))


def distinct_documents(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component (the smallest id) and all unlinked ones.

    Rows repeated under one id stay once; rows without an id stay unless an equal text has one.
    """
    told = report(docs, words, num, den)
    stay = told.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"))
    named = docs.join(stay.dropna().distinct(), docs["doc_id"] == F.col("__id"), "left_semi")
    named = named.dropDuplicates(["doc_id"])
    nameless = docs.filter(F.col("doc_id").isNull())
    if nameless.isEmpty():
        return named
    worded = docs.filter("doc_id IS NOT NULL").filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    named_texts = worded.select(F.xxhash64("text").alias("__node")).distinct()
    alone = nameless.join(named_texts, F.xxhash64(nameless["text"]) == F.col("__node"), "left_anti")
    return named.unionByName(alone)

"""Substring dedup: long word sequences that an earlier document already holds.

A window is ``length`` consecutive words. Every word covered by a window that also starts in a
document with a smaller id is removed. The decision is made by suffix automata of reference
shards: documents are streamed through the automaton of a shard, the matching statistic at
each word is the longest sequence ending there that the shard holds, and spans of at least
``length`` words are duplicates. Automata compare the words themselves, never hashes.

Which documents meet which shard:

1. Copies of whole documents (equal word sequences) are settled by one pre-aggregated minimum.
2. Of each document the *anchors* are kept: a ``gram``-word sequence whose hash is the smallest
   in some window (winnowing). Two equal windows have the same smallest anchor, so documents
   without a common anchor share no window. The document with the smallest id among those with
   an anchor becomes its reference; a shard is the surroundings of a reference's anchors.
3. The other documents with that anchor stream their surroundings through the shard. A shard met
   by many documents is copied (broadcast) to several tasks, each with its part of them.
4. Windows the reference lacks may still recur among the other documents. They are paired by
   window hash, the smallest document of each pair is the next reference, and its shard decides
   again. After this second round every window has met its first document.

Memory of a task is the automaton of one reference document's shared passages plus one batch.
Shuffled are the anchors, the documents with shared anchors, and their shared passages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.llm.frames import mapped, stored
from spectrafold.llm.words import PLAIN, Words, batches, intervals, sequences, signed, split

LENGTH = 50
GRAM = 20
PER_COPY = 4_000  # anchors streamed through one copy of a shard


class Automaton:
    """Suffix automaton of word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]
        self.last, self.parts = 0, 0

    def add(self, words: list[bytes]) -> None:
        """Append a sequence. A mark of its own keeps matches from running into the next one."""
        for word in words:
            self._extend(word)
        self.parts += 1
        self._extend(self.parts)

    def _extend(self, word) -> None:
        following, link, size = self.next, self.link, self.size
        state = len(following)
        following.append({})
        size.append(size[self.last] + 1)
        link.append(0)
        at = self.last
        while at >= 0 and word not in following[at]:
            following[at][word] = state
            at = link[at]
        if at >= 0:
            to = following[at][word]
            if size[at] + 1 == size[to]:
                link[state] = to
            else:
                copy = len(following)
                following.append(following[to].copy())
                size.append(size[at] + 1)
                link.append(link[to])
                while at >= 0 and following[at].get(word) == to:
                    following[at][word] = copy
                    at = link[at]
                link[to] = link[state] = copy
        self.last = state

    def statistics(self, words: list[bytes]) -> list[int]:
        """For each word the length of the longest sequence ending there that was added."""
        following, link, size = self.next, self.link, self.size
        at, length, out = 0, 0, []
        for word in words:
            while at and word not in following[at]:
                at = link[at]
                length = size[at]
            to = following[at].get(word)
            if to is None:
                length = 0
            else:
                at = to
                length += 1
            out.append(length)
        return out


def spans(statistics: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal half-open spans of words covered by matches of at least ``length``."""
    found: list[tuple[int, int]] = []
    for i, n in enumerate(statistics):
        if n >= length:
            lo = i + 1 - n
            if found and lo <= found[-1][1]:
                found[-1] = (min(lo, found[-1][0]), i + 1)
            else:
                found.append((lo, i + 1))
    return found


def _sliding(best, values: np.ndarray, width: int) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of each run of ``width`` values."""
    span = 1
    while span * 2 <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return best(values[:-rest], values[rest:]) if rest else values


def anchors(words: Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (word indexes of the batch) and hashes of the anchors of all texts."""
    width = length - gram + 1
    h = sequences(words, gram)
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.arange(len(h))
    end = np.repeat(words.first[1:], np.diff(words.first))[: len(h)]
    inside = place + gram <= end
    smallest = _sliding(np.minimum, np.where(inside, h, np.uint64(2**64 - 1)), width)
    whole = place[: len(smallest)] + length <= end[: len(smallest)]
    smallest = np.where(whole, smallest, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    best = _sliding(np.maximum, np.concatenate([pad, smallest, pad]), width)
    chosen = np.flatnonzero(inside & (best == h) & (best != 0))
    return chosen, h[chosen]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key that tells apart different texts under one id."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text")
    )


def described(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """Of each document the number of words, their digest, and its anchors."""

    def compute(texts):
        made = {"n_words": [], "digest": [], "grams": [], "places": []}
        for part in batches(texts):
            words = split(texts[part], PLAIN)
            at, h = anchors(words, length, gram)
            cut = np.searchsorted(at, words.first)
            for k, (lo, hi) in enumerate(words.texts()):
                own = slice(cut[k], cut[k + 1])
                made["n_words"].append(hi - lo)
                made["digest"].append(hashlib.sha256(words.joined(lo, hi)).hexdigest())
                made["grams"].append(signed(h[own]))
                made["places"].append((at[own] - lo).astype(np.int32))
        return made

    added = "n_words long, digest string, grams array<long>, places array<int>"
    return mapped(keyed, added, lambda: compute, ["text"], drop=["text"])


# What one document sends to shards: around each place, to the shard of its reference.
_MEETING = "struct(ref, copies, more, place)"


def _segments(held: DataFrame, before: int, after: int) -> DataFrame:
    """Passages of documents around their meetings, one row per shard copy and passage."""
    schema = "ref long, copy int, streamed boolean, more boolean, doc_id long, version long, at long, passage string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                words = row.text.encode("utf-8", "surrogatepass").translate(PLAIN).split()
                wanted: dict[tuple, list[tuple[int, int]]] = {}
                for m in row.meetings:
                    region = (max(0, m["place"] - before), min(len(words), m["place"] + after))
                    streamed = m["ref"] != row.doc_id
                    copies = [row.doc_id % m["copies"]] if streamed else range(m["copies"])
                    for copy in copies:
                        key = (m["ref"], copy, streamed, bool(m["more"]) and streamed)
                        wanted.setdefault(key, []).append(region)
                for (ref, copy, streamed, more), regions in wanted.items():
                    for lo, hi in intervals(regions):
                        passage = b" ".join(words[lo:hi]).decode("utf-8", "surrogatepass")
                        rows.append((ref, copy, streamed, more, row.doc_id, row.version, lo, passage))
            yield pd.DataFrame(rows, columns=names)

    return held.mapInPandas(run, schema)


def _matched(segments: DataFrame, length: int) -> DataFrame:
    """Stream passages through the automaton of their shard.

    Rows: spans found (lo, hi; h null), and the hashes of windows the shard lacks (lo; h) where
    more than two documents meet.
    """
    schema = "doc_id long, version long, lo long, hi long, h long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, automaton = None, Automaton()
        for frame in frames:
            found, lacking = [], []
            for row in frame.itertuples(index=False):
                if shard != (row.ref, row.copy):
                    shard, automaton = (row.ref, row.copy), Automaton()
                words = row.passage.encode("utf-8", "surrogatepass").split(b" ")
                if not row.streamed:
                    automaton.add(words)
                    continue
                statistics = automaton.statistics(words)
                for lo, hi in spans(statistics, length):
                    found.append((row.doc_id, row.version, row.at + lo, row.at + hi))
                if row.more and len(words) >= length:
                    short = np.flatnonzero(np.array(statistics[length - 1 :]) < length)
                    if len(short):
                        h = signed(sequences(split([row.passage], PLAIN), length))[short]
                        lacking.append((row.doc_id, row.version, row.at + short, h))
            made = pd.DataFrame(found, columns=names[:4]).astype("int64")
            made["h"] = pd.Series([None] * len(made), dtype="Int64")
            yield made
            if lacking:
                sizes = [len(h) for *_, h in lacking]
                yield pd.DataFrame(
                    {
                        "doc_id": np.repeat([d for d, *_ in lacking], sizes),
                        "version": np.repeat([v for _, v, *_ in lacking], sizes),
                        "lo": np.concatenate([p for _, _, p, _ in lacking]),
                        "hi": -1,
                        "h": pd.array(np.concatenate([h for *_, h in lacking]), dtype="Int64"),
                    }
                )

    spread = segments.repartition("ref", "copy").sortWithinPartitions("ref", "copy", "streamed", "doc_id")
    return spread.mapInPandas(run, schema)


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, version, h, place) whose hash is in several documents, with the shard each meets.

    The hashes are stored first: a join of two plain inputs is one whose hot keys Spark can split.
    """
    met = (
        rows.groupBy("h")
        .agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"))
        .filter("ref < most")
        .select("h", "ref", F.ceil(F.col("n") / PER_COPY).cast("int").alias("copies"), (F.col("n") > 2).alias("more"))
    )
    return rows.join(stored(met, "substring-shared"), "h")


def _collected(met: DataFrame) -> DataFrame:
    """One row per document with all its meetings (as many as it has words, at most)."""
    return met.groupBy("doc_id", "version").agg(F.collect_list(F.expr(_MEETING)).alias("meetings"))


def find(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """What the operator finds: every document, and the changed ones.

    First: doc_id, version, n_words, digest (sha256 of the words joined by one space), and
    ``copy``: it repeats all words of an earlier document and has a window at least. Second:
    doc_id, version, text, spans of the other documents with duplicate spans.
    """
    gram = min(gram, length)
    keyed = _keyed(docs)
    facts = stored(described(keyed, length, gram), "substring-facts")
    first = stored(facts.groupBy("digest").agg(F.min("doc_id").alias("first_id")), "substring-first")
    repeats = F.coalesce((F.col("n_words") >= length) & (F.col("first_id") < F.col("doc_id")), F.lit(False))
    told = facts.join(first, "digest").withColumn("copy", repeats)
    rows = (
        told.filter(~F.col("copy") & F.col("doc_id").isNotNull())
        .select("doc_id", "version", F.explode(F.arrays_zip("grams", "places")).alias("a"))
        .select("doc_id", "version", F.col("a.grams").alias("h"), F.col("a.places").cast("long").alias("place"))
    )
    met = _collected(_shared(rows))
    held = keyed.join(met, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"])
    held = stored(held, "substring-held")
    once = stored(_matched(_segments(held, length - gram, length), length), "substring-matches")
    lacking = once.filter(F.col("h").isNotNull()).select("doc_id", "version", "h", F.col("lo").alias("place"))
    again = _collected(_shared(lacking.distinct()).withColumn("more", F.lit(False)))
    texts = held.select("doc_id", "version", "text")
    twice = _matched(_segments(texts.join(again, ["doc_id", "version"]), 0, length), length)
    found = (
        once.filter(F.col("h").isNull())
        .unionByName(twice)
        .groupBy("doc_id", "version")
        .agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    )
    everything = told.select("doc_id", "version", "n_words", "digest", "copy")
    return everything, texts.join(found, ["doc_id", "version"])


def _kept(row) -> tuple[list[bytes], int]:
    words = row.text.encode("utf-8", "surrogatepass").translate(PLAIN).split()
    keep = np.ones(len(words), bool)
    for s in row.spans:
        keep[s["lo"] : s["hi"]] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()], int((~keep).sum())


def kept(changed: DataFrame) -> DataFrame:
    """doc_id, version, n_removed and the kept words joined by one space."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                words, removed = _kept(row)
                text = b" ".join(words).decode("utf-8", "surrogatepass")
                rows.append((row.doc_id, row.version, removed, text))
            yield pd.DataFrame(rows, columns=["doc_id", "version", "n_removed", "kept"])

    return changed.mapInPandas(run, "doc_id long, version long, n_removed long, kept string")


def _settled(told: DataFrame, changed: DataFrame) -> DataFrame:
    """One row for each different row of the input: doc_id, version, n_words, n_removed, kept (null: as it was)."""
    done = kept(changed)
    whole: Column = F.when(F.col("copy"), F.col("n_words"))
    return told.join(done, ["doc_id", "version"], "left").select(
        "doc_id",
        "version",
        "n_words",
        "digest",
        F.coalesce(whole, "n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of ``docs``.

    Null and empty texts have no words. Equal rows are judged alike: only a smaller id counts
    as earlier. Rows without an id are earlier than none and lose nothing.
    """
    told, changed = find(docs, length, gram)
    digest = F.when(F.col("kept").isNull(), F.col("digest")).otherwise(F.sha2("kept", 256))
    return _settled(told, changed).select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` without the duplicate words; texts that lose none stay as they are.

    A changed text is its kept words joined by one space (empty if none is left), with
    ``n_chars`` following if there is such a column. Cases as in ``report``.
    """
    told, changed = find(docs, length, gram)
    new = _settled(told, changed).filter("kept IS NOT NULL").select("doc_id", "version", "kept")
    new = new.dropDuplicates(["doc_id", "version"]).select(
        F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("kept").alias("__kept")
    )
    text = F.coalesce(docs["text"], F.lit(""))
    joined = docs.join(
        new,
        (docs["doc_id"].cast("long") == new["__id"]) & (F.xxhash64(text) == new["__version"]),
        "left",
    )
    out = joined.withColumn("text", F.coalesce("__kept", docs["text"]))
    if "n_chars" in docs.columns:
        size = F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("__kept"))
        out = out.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)

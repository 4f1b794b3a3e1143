"""Benchmark decontamination: short test items inside long documents.

Containment is asymmetric: of an item's distinct word shingles, the share that stands in the
document. Items are partitioned by size (powers of two of their shingle count). The MinHash
sketch of an item with n shingles is its ``missing(n) + 1`` smallest shingle hashes, where
``missing(n)`` is the most shingles a document may lack and still contain the item: such a
document must hold at least one hash of the sketch, so the search misses nothing. Each
partition keeps the largest hash of its sketches as a ceiling; of a document only hashes
up to that ceiling are looked up (the document's own minimum hashes, however long it is).
Candidates are verified on the exact share of shingles.

Items are the stated query side. They are cut into blocks of bounded size, each block is
broadcast, and all documents pass over it once: no shuffle and no join of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.llm.frames import mapped
from spectrafold.llm.words import ALNUM, batches, shingles, split

WORDS = 5
SHARE = 0.8
BLOCK_SHINGLES = 2_000_000  # in one broadcast; 16 bytes each


def needed(n: int, share: float) -> int:
    """Fewest of ``n`` shingles that make the share."""
    return max(1, int(np.ceil(round(share * n, 9))))


class ItemIndex:
    """Sketches and shingles of a block of items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], share: float):
        self.ids = [i for i, _ in items]
        self.sets = [s for _, s in items]
        self.least = np.array([needed(len(s), share) for s in self.sets], np.int64)
        self.partitions = []
        sizes = np.array([len(s).bit_length() for s in self.sets], np.int64)
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size).tolist()
            sketch = [self.sets[k][: len(self.sets[k]) - self.least[k] + 1] for k in own]
            hashes = np.concatenate(sketch)
            owner = np.repeat(own, [len(s) for s in sketch])
            order = np.argsort(hashes, kind="stable")
            self.partitions.append((hashes[order], owner[order]))

    def find(self, doc: np.ndarray) -> list[tuple[int, int]]:
        """Items contained in a document (its sorted shingles), with the shingles they share."""
        candidates: set[int] = set()
        for hashes, owner in self.partitions:
            low = doc[: np.searchsorted(doc, hashes[-1], side="right")]  # up to the ceiling
            lo = np.searchsorted(hashes, low, side="left")
            hi = np.searchsorted(hashes, low, side="right")
            for k in np.flatnonzero(hi > lo).tolist():
                candidates.update(owner[lo[k] : hi[k]].tolist())
        found = []
        for k in sorted(candidates):
            own = self.sets[k]
            at = np.searchsorted(doc, own)
            at[at == len(doc)] = 0
            shared = int((doc[at] == own).sum())
            if shared >= self.least[k]:
                found.append((k, shared))
        return found


def blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items with their shingles, in runs of about ``limit`` shingles."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").dropna().distinct()
    block, size = [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        own = next(shingles(split([row.text], ALNUM), WORDS, whole=False))
        if len(own):
            block.append((row.item_id, own))
            size += len(own)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def found(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block: int = BLOCK_SHINGLES) -> DataFrame:
    """``docs`` with ``items``: what each whole text contains (item_id, n_item, n_shared).

    Words are lower-case runs of ASCII letters and digits and of anything beyond ASCII. Items
    that are null or shorter than a shingle are never found, nor is anything in null or
    shorter texts. Items that repeat an id with another text are items of their own. A column
    called items is replaced.
    """
    added = "items array<struct<item_id:long,n_item:long,n_shared:long>>"
    out, several = docs, []
    for k, items in enumerate(blocks(benchmark, block)):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(items, share))

        name = f"__items{k}"

        def start(index=index, name=name):
            held = index.value

            def one(own: np.ndarray) -> list[dict]:
                if not len(own):
                    return []
                return [
                    {"item_id": held.ids[k], "n_item": len(held.sets[k]), "n_shared": shared}
                    for k, shared in held.find(own)
                ]

            def compute(texts):
                finds = []
                for part in batches(texts):
                    finds += [one(own) for own in shingles(split(texts[part], ALNUM), WORDS, whole=False)]
                return {name: finds}

            return compute

        several.append(name)
        out = mapped(out, added.replace("items", name, 1), start, ["text"])
    empty = F.array().cast(added.split(" ", 1)[1])
    return out.withColumn("items", F.concat(*several) if several else empty).drop(*several)


def contained(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_item (distinct shingles), n_shared, containment: a row for each find."""
    rows = found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, share)
    return rows.select("doc_id", F.explode("items").alias("i")).select(
        "doc_id", "i.item_id", "i.n_item", "i.n_shared", (F.col("i.n_shared") / F.col("i.n_item")).alias("containment")
    )


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """Documents that contain no item; their columns as they are."""
    own = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"c{k}") for k, c in enumerate(own)])
    rows = found(plain, benchmark, share).filter(F.size("items") == 0)
    return rows.select(*[F.col("text" if c == "text" else f"c{k}").alias(c) for k, c in enumerate(own)])

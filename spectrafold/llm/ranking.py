"""Ranked lexical search: Block-Max MaxScore over shards of an inverted index.

**Index.** Each task cuts its documents into shards of bounded size and writes one row per term of
a shard. A shard's documents are in order of their id; its postings are cut into blocks of
``BLOCK`` consecutive documents, each compressed on its own (offsets and frequencies in the
narrowest width), with the largest impact of the block kept beside it, uncompressed. All terms
of all documents are indexed. Postings are never shuffled by term, so a word that stands in every
document is one row per shard.

**Search.** Queries come in blocks; a task holds one shard's postings of one block's terms. For
each query, the terms are ordered by their *global bound* (largest score in the shard). Those
whose bounds together stay below the current 20th score are *non-essential*: a document that has
only them cannot enter. Blocks are visited by decreasing sum of block maxima and skipped where that
sum is below the threshold. In a block, only the essential lists are read to make candidates;
candidates whose score so far plus the block maxima of the other lists stays below the threshold
are rejected before those lists' blocks are decompressed. What is left is completed list by
list, largest maximum first, rejecting again after each.

The heaps (k best of a query and shard) are merged by a rank window, which keeps k per query in
each task before it shuffles. Scores are exact integers; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrafold.llm.frames import mapped, stored
from spectrafold.llm.words import ALNUM, batches, signed, split

BLOCK = 256  # documents; offsets in a block are one byte each
SHARD_DOCS = 8192
SHARD_CHARS = 16 << 20  # characters of a shard's documents (or one document that is longer)
QUERY_BLOCK = 256  # queries searched together
_WIDTHS = (np.uint8, np.uint16, np.uint32)


def _bm25(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Impact of ``tf`` occurrences in a document of length norm ``m``, in whole numbers."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _norm(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """Length norm of documents of ``n`` terms, of ``docs`` with ``words`` terms together."""
    return 75 + (25 * n * docs) // words


class Block:
    """Postings of one term in one block of documents: compressed, with their largest impact."""

    __slots__ = ("data", "most", "read")

    def __init__(self, data: bytes, most: int):
        self.data, self.most, self.read = data, most, None

    @staticmethod
    def pack(offsets: np.ndarray, tf: np.ndarray) -> bytes:
        width = 0 if tf.max() < 1 << 8 else 1 if tf.max() < 1 << 16 else 2
        return bytes([width]) + offsets.astype(np.uint8).tobytes() + tf.astype(_WIDTHS[width]).tobytes()

    def postings(self, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and impacts; kept, since the queries of a block share terms."""
        if self.read is None:
            kind = _WIDTHS[self.data[0]]
            n = (len(self.data) - 1) // (1 + kind().itemsize)
            offsets = np.frombuffer(self.data, np.uint8, n, 1).astype(np.int64)
            tf = np.frombuffer(self.data, kind, n, 1 + n).astype(np.int64)
            self.read = offsets, _bm25(tf, norms[offsets])
        return self.read


def _term_counts(words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for lo, hi in words.texts():
        yield np.unique(words.hash[lo:hi], return_counts=True)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id and its number of terms."""

    def compute(texts):
        n = []
        for part in batches(texts):
            n += np.diff(split(texts[part], ALNUM).first).tolist()
        return {"n_terms": n}

    return mapped(docs.select("doc_id", "text"), "n_terms long", lambda: compute, ["text"], drop=["text"])


INDEX = "shard string, term long, df long, block array<int>, most array<int>, postings array<binary>, ids array<long>, norms array<long>"


def _shard_rows(name: str, ids: list, sizes: list, terms: list, counts: list, total: tuple[int, int]) -> list[dict]:
    """The index rows of one shard: its documents (the row with ``ids``), and its terms."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    norms = _norm(np.array(sizes, np.int64)[order], *total)
    doc = np.repeat(place, [len(t) for t in terms])
    term, tf = np.concatenate(terms), np.concatenate(counts).astype(np.int64)
    by = np.lexsort((doc, term))
    doc, term, tf = doc[by], term[by], tf[by]
    impact = _bm25(tf, norms[doc])
    block = doc // BLOCK
    fresh = np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))
    start = np.flatnonzero(fresh)
    most = np.maximum.reduceat(impact, start).tolist()
    number, owner, stop = block[start].tolist(), term[start], np.append(start[1:], len(doc)).tolist()
    offset = doc % BLOCK
    packed = [Block.pack(offset[a:b], tf[a:b]) for a, b in zip(start.tolist(), stop)]
    begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])).tolist()
    keys, df = signed(owner).tolist(), np.diff(np.append(start, len(doc)))
    rows = [{"shard": name, "term": 0, "df": 0, "ids": [ids[k] for k in order], "norms": norms.tolist()}]
    for a, b in zip(begin, [*begin[1:], len(owner)]):
        rows.append(
            {
                "shard": name, "term": keys[a], "df": int(df[a:b].sum()),
                "block": number[a:b], "most": most[a:b], "postings": packed[a:b],
            }
        )
    return rows


def build(docs: DataFrame, total: tuple[int, int], shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index rows of all documents that have a term; store them before use.

    ``total``: how many such documents there are, and their terms together.
    """
    names = ["shard", "term", "df", "block", "most", "postings", "ids", "norms"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary())]
    schema = pa.schema(list(zip(names, [*types, pa.list_(pa.int64()), pa.list_(pa.int64())])))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        made, chars = 0, 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                _shard_rows(f"{TaskContext.get().partitionId()}-{made}", *held, total), schema
            )

        for frame in frames:
            ids, texts = frame.column("doc_id").to_pylist(), frame.column("text").to_pylist()
            for part in batches(texts):
                words = split(texts[part], ALNUM)
                for doc, text, (lo, hi), (term, tf) in zip(ids[part], texts[part], words.texts(), _term_counts(words)):
                    if hi == lo:
                        continue
                    for column, value in zip(held, (doc, hi - lo, term, tf)):
                        column.append(value)
                    chars += len(text)
                    if chars >= SHARD_CHARS or len(held[0]) >= shard_docs:
                        yield rows()
                        held, chars, made = [[], [], [], []], 0, made + 1
        if held[0]:
            yield rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


class _Best:
    """The k best of a query so far: by falling score, then rising id; a null id comes last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1  # scores above 0 only
        self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, doc: np.ndarray, score: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        top = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[top], doc[top]
        if len(top) == self.k:
            self.least = max(1, int(self.score[-1]))


def search_shard(
    lists: dict[int, dict[int, Block]], norms: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int
) -> tuple[_Best, int, int]:
    """The k best documents (numbers in the shard) for one query; blocks it decompressed, and blocks there are."""
    held = [(int(w), lists[t]) for t, w in zip(terms.tolist(), weights.tolist()) if t in lists and w > 0]
    best = _Best(k)
    if not held:
        return best, 0, 0
    blocks = -(-len(norms) // BLOCK)
    most = np.zeros((len(held), blocks), np.int64)
    for i, (w, own) in enumerate(held):
        for b, block in own.items():
            most[i, b] = w * block.most
    rise = np.argsort(most.max(1), kind="stable")  # by global bound
    most, held = most[rise], [held[i] for i in rise.tolist()]
    reach = np.cumsum(most.max(1))  # what the lists up to here can give together
    whole, seen = most.sum(0), 0
    for b in np.argsort(-whole, kind="stable").tolist():
        if whole[b] < best.least:
            break
        norm = norms[b * BLOCK : (b + 1) * BLOCK]
        first = int(np.searchsorted(reach, best.least))  # the first essential list
        here = np.flatnonzero(most[:, b])
        essential, rest = here[here >= first], here[here < first]
        score = np.zeros(len(norm), np.int64)
        for i in essential.tolist():
            offsets, impact = held[i][1][b].postings(norm)
            score[offsets] += held[i][0] * impact
        seen += len(essential)
        left = int(most[rest, b].sum())
        candidates = np.flatnonzero((score > 0) & (score + left >= best.least))
        for i in rest[np.argsort(-most[rest, b], kind="stable")].tolist():
            if not len(candidates):
                break
            offsets, impact = held[i][1][b].postings(norm)
            score[offsets] += held[i][0] * impact
            seen += 1
            left -= int(most[i, b])
            candidates = candidates[score[candidates] + left >= best.least]
        if len(candidates):
            best.offer(b * BLOCK + candidates, score[candidates])
    return best, seen, sum(len(own) for _, own in held)


_HITS = "item_id long, doc_id long, score long"


def _search(key: tuple, index: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    own = index["ids"].notna()
    docs = index[own].iloc[0]
    ids, norms = docs["ids"], np.asarray(docs["norms"], np.int64)
    lists = {
        int(t): {b: Block(data, m) for b, m, data in zip(block.tolist(), most.tolist(), postings)}
        for t, block, most, postings in index.loc[~own, ["term", "block", "most", "postings"]].itertuples(index=False)
    }
    made = []
    for q in queries.itertuples(index=False):
        best, _, _ = search_shard(lists, norms, np.asarray(q.terms, np.int64), np.asarray(q.weights, np.int64), k)
        made.append(pd.DataFrame({"item_id": q.item_id, "doc_id": [ids[d] for d in best.doc.tolist()], "score": best.score}))
    out = pd.concat(made) if made else pd.DataFrame({c.split()[0]: [] for c in _HITS.split(", ")})
    return out.astype({"item_id": "Int64", "doc_id": "Int64", "score": "int64"})


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times: the terms of each item with repeats."""

    def compute(texts):
        made = {"terms": [], "times": []}
        for part in batches(texts):
            for term, times in _term_counts(split(texts[part], ALNUM)):
                made["terms"].append(signed(term))
                made["times"].append(times)
        return made

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    rows = mapped(rows, "terms array<long>, times array<long>", lambda: compute, ["text"], drop=["text"])
    pairs = rows.select("item_id", F.explode(F.arrays_zip("terms", "times")).alias("t"))
    return pairs.groupBy("item_id", F.col("t.terms").alias("term")).agg(F.sum("t.times").alias("times"))


def top(docs: DataFrame, items: DataFrame, k: int = 20, shard_docs: int = SHARD_DOCS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents of highest score above 0 for each item.

    A score sums, over the item's terms with repeats, weight * impact: weight
    floor(1000 ln((2N+2)/(2df+1))), impact (10^9 tf) div (1000 tf + 12 m), length norm m =
    75 + 25 n N div L (N documents with a term, L their terms, n those of this one).
    Equal scores go by rising doc_id, a null id last. Each row of ``docs`` is a document of its own,
    repeated ids included; null and wordless texts have no terms and are not counted. Equal
    rows of ``items`` are one; different texts of one item_id are one query together. Items
    without a term in any document, null ones included, have no rows; empty tables give no rows.
    """
    size = sized(docs).agg(F.count_if(F.col("n_terms") > 0).alias("n"), F.sum("n_terms").alias("l")).first()
    total = (int(size["n"]), max(1, int(size["l"] or 0)))
    index = stored(build(docs, total, shard_docs), "ranking-index")

    asked = stored(query_terms(items), "ranking-queries")
    known = index.filter("ids IS NULL").join(asked.select("term").distinct(), "term", "left_semi")
    df = known.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.expr(f"cast(floor(1000 * ln((2 * {total[0]} + 2D) / (2 * df + 1))) as long)")
    weighted = asked.join(df, "term").withColumn("weight", F.col("times") * weight)
    queries = weighted.groupBy("item_id").agg(
        F.collect_list(F.struct("term", "weight")).alias("w")  # a group is one item's distinct terms
    )
    blocks = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / query_block)).cast("int")
    n_blocks = queries.agg(blocks).first()[0]
    queries = stored(
        queries.select(
            F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).cast("int").alias("part"),
            "item_id", F.col("w.term").alias("terms"), F.col("w.weight").alias("weights"),
        ),
        "ranking-blocks",
    )

    # A shard meets every block of queries: its documents, and its postings of the block's terms.
    shards = index.filter("ids IS NOT NULL").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    wanted = queries.select("part", F.explode("terms").alias("term")).distinct()
    postings = index.filter("ids IS NULL").join(wanted, "term").select(*shards.columns)
    met = shards.select(F.col("shard").alias("at"), F.col("part").alias("asked"))
    asking = met.join(queries.withColumnRenamed("part", "asked"), "asked")
    hits = (
        shards.unionByName(postings)
        .groupBy("shard", "part")
        .cogroup(asking.groupBy("at", "asked"))
        .applyInPandas(lambda key, a, b: _search(key, a, b, k), _HITS)
    )
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score"
    )

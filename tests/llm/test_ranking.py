"""Ranked search against a plain scorer."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np

from spectrafold.llm import ranking
from spectrafold.llm.ranking import Block
from tests.llm import brute, data


def plain(docs, items, k):
    terms = [(d, brute.words(t, brute.ALNUM, lower=True)) for d, t in docs]
    n_docs, n_words = sum(bool(ws) for _, ws in terms), sum(len(ws) for _, ws in terms)
    df = Counter(w for _, ws in terms for w in set(ws))
    asked: dict = {}
    for i, t in dict.fromkeys(items):
        if i is not None:
            asked.setdefault(i, []).extend(brute.words(t, brute.ALNUM, lower=True))
    out = []
    for i, query in asked.items():
        hits = []
        for d, ws in terms:
            if not ws:
                continue
            m = 75 + 25 * len(ws) * n_docs // n_words
            tf = Counter(ws)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 12 * m))
                for w in query if tf[w]
            )
            if score > 0:
                hits.append((-score, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(hits)[:k], 1)]
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_plain_scorer(spark):
    docs = data.docs()
    docs += [docs[5], (None, docs[6][1]), (10**12, "É é日本 x-y_z 3D"), (-4, "日本 日本")]
    rng = random.Random(3)
    texts = [t for _, t in docs if t and len(t) > 20]
    items = [(k, " ".join(rng.choice(texts).split()[:12])) for k in range(25)]
    items += [items[0], (1, "another text of one id"), (90, None), (91, ""), (92, "nowhere"), (93, "same same again"), (94, "日本")]
    frame = data.frame(spark, docs).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for k, shard_docs, query_block in ((20, 8192, 256), (3, 40, 4), (500, 100, 1)):
        got = ranking.top(frame, asked, k, shard_docs, query_block)
        assert rows(got) == sorted(plain(docs, items, k), key=str)


def test_ties_by_id_over_shards(spark):
    docs = spark.createDataFrame([(d, "apple pie") for d in range(60, 0, -1)] + [(99, "pear")], "doc_id long, text string")
    got = ranking.top(docs.repartition(4), spark.createDataFrame([(1, "APPLE")], "item_id long, text string"), 5, 7)
    assert [r.doc_id for r in got.orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_empty_tables(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    some, ask = spark.createDataFrame([(1, "a b")], docs), spark.createDataFrame([(1, "a")], items)
    for left, right in ((spark.createDataFrame([], docs), ask), (some, spark.createDataFrame([], items))):
        assert ranking.top(left, right).collect() == []
    assert ranking.top(spark.createDataFrame([(1, None), (2, " ")], docs), ask).collect() == []


def test_blocks_are_packed_and_read():
    rng = np.random.default_rng(1)
    for high in (3, 300, 10**6):
        offsets = np.sort(rng.choice(256, 40, replace=False))
        tf = rng.integers(1, high, 40)
        norms = rng.integers(75, 400, 256)
        at, impact = Block(Block.pack(offsets, tf), 0).postings(norms)
        assert (at == offsets).all() and (impact == ranking._bm25(tf, norms[offsets])).all()


def test_most_blocks_stay_compressed():
    """A rare word in one block: the frequent words' other blocks are never read."""
    rng = np.random.default_rng(2)
    norms = rng.integers(90, 110, 100 * ranking.BLOCK)

    def postings(docs, tf):
        impact = ranking._bm25(tf, norms[docs])
        own = {}
        for b in np.unique(docs // ranking.BLOCK).tolist():
            here = docs // ranking.BLOCK == b
            own[b] = Block(Block.pack(docs[here] % ranking.BLOCK, tf[here]), int(impact[here].max()))
        return own

    rare = np.arange(30) + 512
    common = np.flatnonzero(rng.random(len(norms)) < 0.6)
    lists = {1: postings(rare, np.full(30, 5)), 2: postings(common, rng.integers(1, 3, len(common)))}
    best, seen, there = ranking.search_shard(lists, norms, np.array([1, 2]), np.array([8000, 500]), 20)
    assert there == 101 and seen <= 3
    score = np.zeros(len(norms), np.int64)
    for t, w in ((1, 8000), (2, 500)):
        for b, block in lists[t].items():
            at, impact = block.postings(norms[b * ranking.BLOCK : (b + 1) * ranking.BLOCK])
            score[b * ranking.BLOCK + at] += w * impact
    order = np.lexsort((np.arange(len(norms)), -score))[:20]
    assert best.doc.tolist() == order.tolist() and best.score.tolist() == score[order].tolist()

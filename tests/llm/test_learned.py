"""Learned operators on labels made for the purpose, and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.llm import mixing, toxicity
from spectrafold.llm.frames import prepare, stored
from tests.llm import brute, data

LABELS = "doc_id long, quality int, toxic int"
INSULTS = "grubworm nitwit dunderhead".split()


def labelled(n=400, seed=6):
    """Texts, a fifth of them with insults (some disguised) and marked toxic; shouting ones of low quality."""
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        ws = data.prose(rng, rng.choice((30, 80, 200)))
        toxic, low = rng.random() < 0.2, rng.random() < 0.3
        for _ in range(3 * toxic):
            ws.insert(rng.randrange(len(ws)), rng.choice(INSULTS))
        text = " ".join(ws)
        rows.append((k, text.upper() + "!!!" if low else text))
        labels.append((k, int(not low), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    prepare(spark)
    rows, labels = labelled()
    docs = data.frame(spark, rows)
    return rows, labels, docs, toxicity.fit(docs, spark.createDataFrame(labels, LABELS))


def test_toxicity_on_held_out_rows(model):
    rows, labels, docs, fitted = model
    got = {r.doc_id: r for r in toxicity.score(docs, fitted).collect()}
    assert set(got) == {d for d, _ in rows} and all(0 <= r.score <= 1 for r in got.values())
    held = [(d, y) for d, _, y in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert brute.auc([got[d].score for d, _ in held], [y for _, y in held]) > 0.95
    wrong = sum(got[d].predicted != y for d, y in held)
    assert wrong <= 0.05 * len(held)
    assert {w.encode() for w in INSULTS} <= set(fitted.lexicon)


def test_held_out_labels_do_not_matter(spark, model):
    rows, labels, docs, fitted = model
    other = [(d, q, 1 - y if zlib.crc32(str(d).encode()) % 3 == 1 else y) for d, q, y in labels]
    again = toxicity.fit(docs, spark.createDataFrame(other, LABELS))
    a = {r.doc_id: r.score for r in toxicity.score(docs, fitted).collect()}
    assert {r.doc_id: r.score for r in toxicity.score(docs, again).collect()} == a


def test_toxicity_odd_rows(spark, model):
    fitted = model[3]
    odd = [(1, None), (2, ""), (3, "x" * 200_000), (None, "grubworm nitwit"), (2**60 + 1, "g.r.u.b.w.o.r.m you n1tw1t")]
    df = data.frame(spark, odd).withColumnsRenamed({"lang": "score", "source": "prediction"}).withColumn("vector", F.lit(1))
    got = toxicity.score(df, fitted, keep=True)
    assert got.columns == ["doc_id", "text", "prediction", "n_chars", "vector", "score", "predicted"]
    assert {r.doc_id for r in got.collect()} == {1, 2, 3, None, 2**60 + 1}
    assert toxicity.score(df.limit(0), fitted).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, None), (3, 0, 0)], [(1, 1, 1), (999, 0, 0)]])
def test_toxicity_without_two_classes(spark, labels):
    docs = data.frame(spark, [(1, "a b"), (3, "c d"), (4, None)])
    fitted = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
    assert fitted.trees is None
    assert toxicity.score(docs, fitted).count() == 3


def test_hidden_words():
    lexicon = {b"idiot": 3.0}
    names = toxicity.FEATURES
    value = lambda t: dict(zip(names, toxicity.features(t, lexicon)))
    assert value("you IDIOT there")["hits"] == 1 and value("you idiot")["near"] > 0
    assert value("what an 1d1ot i.d.i.o.t i d i o t")["hidden_hits"] >= 1
    assert value("id!ot")["hidden_hits"] == 1
    assert all(v == 0 for v in value(None).values())


def test_mixing_meets_targets(spark):
    prepare(spark)
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.5, 0.5, 0.5], 500)
    t = rng.integers(0, 300, 500)
    rows = spark.createDataFrame([(k, int(t[k]), p[k].tolist()) for k in range(500)], "doc_id long, n_tokens long, posterior array<double>")
    for targets in ({"high": 0.7, "low": 0.25, "toxic": 0.05}, {"high": 0.4, "low": 0.3, "toxic": 0.3}):
        got = mixing.rates(stored(rows.repartition(4), "t"), targets).orderBy("doc_id").collect()
        rate = np.array([r.rate for r in got])
        assert (rate >= 0).all()
        reached = (rate * t) @ p
        assert np.allclose(reached / t.sum(), list(targets.values()), atol=2e-3)
        copies = np.array([r.copies for r in got])
        assert (np.abs(copies - rate) < 1).all() and abs(copies.mean() - rate.mean()) < 0.15


def test_mixing_out_of_reach(spark):
    """No posterior is pure enough: rates stay non-negative and the best that can be is reached."""
    rows = spark.createDataFrame([(k, 10, [0.6, 0.4, 0.0]) for k in range(20)] + [(50, 10, [0.3, 0.7, 0.0]), (51, 0, [1.0, 0.0, 0.0])], "doc_id long, n_tokens long, posterior array<double>")
    got = mixing.rates(stored(rows, "t"), {"high": 0.9, "low": 0.1, "toxic": 0.0}).collect()
    assert all(r.rate >= 0 for r in got)
    assert next(r.rate for r in got if r.doc_id == 50) < min(r.rate for r in got if r.doc_id < 20)


def test_mixing_whole(spark):
    rows, labels = labelled(300)
    docs = data.frame(spark, rows + [(5000, None), (5001, ""), (None, "a b c"), (0, rows[0][1])])
    got = mixing.mix(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 304
    for r in got:
        assert abs(sum(r.posterior) - 1) < 1e-9 and r.rate >= 0 and r.copies >= 0
    low = {d for d, q, x in labels if not q and not x}
    share = {r.doc_id: r.posterior[1] for r in got}
    assert np.mean([share[d] for d in low]) > 0.8
    t = np.array([r.n_tokens for r in got], float)
    reached = (np.array([r.rate for r in got]) * t) @ np.array([r.posterior for r in got])
    assert np.allclose(reached / t.sum(), [0.7, 0.25, 0.05], atol=0.01)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (3, None, None)], [(77, 1, 0)]])
def test_mixing_without_classes(spark, labels):
    docs = data.frame(spark, [(1, "a b"), (3, "c d"), (4, None)])
    got = mixing.mix(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 3 and all(abs(sum(r.posterior) - 1) < 1e-9 for r in got)
    assert mixing.mix(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_pipeline(spark, tmp_path):
    """Stage by stage against plain versions: what each removes is what it should."""
    import corpus_pipeline

    rows, labels = labelled(240, seed=12)
    rng = random.Random(1)
    passage = data.prose(rng, 60)
    item = " ".join(data.prose(rng, 25))
    clean = [" ".join(data.prose(rng, 120)) for _ in range(8)]
    extra = [(1000 + k, t) for k, t in enumerate(clean)]
    extra += [(1100, clean[0]), (1101, clean[1].replace(clean[1].split()[5], "zz", 1))]
    extra += [(1200 + k, " ".join(data.prose(rng, 40) + passage + data.prose(rng, 40))) for k in range(3)]
    extra += [(1300, " ".join(data.prose(rng, 100)) + " " + item.upper() + " end"), (1400, None), (1401, "")]
    folder = str(tmp_path)
    data.frame(spark, rows + extra).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, folder), f"t-{name}")
        if name != "mixing":
            assert out.columns == docs.columns
        seen[name] = {r.doc_id: r for r in out.collect()}
        assert len(seen[name]) == out.count()
        docs = out
    toxic = {d for d, _, y in labels if y}
    gone = {d for d, _ in rows + extra} - set(seen["toxicity"])
    assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 2 and not any(d >= 1000 for d in gone)
    before = [(d, r.text) for d, r in seen["toxicity"].items()]
    want = {d for d, (_, c) in brute.components(before, 5, 80, 100).items() if c == d}
    assert set(seen["ngram_join"]) == want and {1100, 1101}.isdisjoint(want) and {1000, 1001} <= want
    before = [(d, r.text) for d, r in seen["ngram_join"].items()]
    left = brute.substrings(before)
    assert set(seen["substring_dedup"]) == set(left)
    for d, r in seen["substring_dedup"].items():
        assert len(brute.words(r.text)) == left[d][0] - left[d][1]
    assert left[1201][1] == left[1202][1] == 60 and left[1200][1] == 0
    before = [(d, r.text) for d, r in seen["substring_dedup"].items()]
    dirty = {d for d, _ in brute.contained(before, [(1, item)])}
    assert dirty == {1300} and set(seen["decontamination"]) == {d for d, _ in before} - dirty
    assert set(seen["mixing"]) == set(seen["decontamination"])
    assert corpus_pipeline.run(spark, folder).count() == len(seen["mixing"])

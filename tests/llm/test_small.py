"""Archives, url filter, licence scan, token counts, neighbours."""

from __future__ import annotations

import gzip
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.llm import licenses, neighbours, tokens, urls, warc
from spectrafold.llm.frames import prepare
from tests.llm import brute, data

PAGES = "page_id long, url string, html string"


def pages():
    rng = random.Random(3)
    long = ["<p>" + " ".join(data.prose(rng, 60)) + "</p>é" for _ in range(6)]
    rows = [(k, f"http://h{k}.org/a b\r\nX: y", long[k % 6]) for k in range(20, 0, -1)]
    rows += [(30, None, "short"), (31, "u", "short"), (32, "u", None), (33, "u", ""), (2**60, "u", long[0])]
    rows += [(None, "u", long[0]), (None, "v", "alone " * 50), (34, "日本", "x" * 700_000), (20, "again", long[2])]
    return rows


def test_archives_round_trip(spark):
    prepare(spark)
    rows = pages()
    manifest = warc.write(spark.createDataFrame(rows, PAGES).repartition(3))
    got = warc.read(manifest, payloads=True).collect()
    assert len(got) == len(rows) and all(r.digest_ok and r.error is None for r in got)
    assert sum(r.records for r in manifest.collect()) == len(rows)
    first = {}
    for k, _, html in rows:
        if len((html or "").encode()) >= 100 and k is not None:
            first[html] = min(k, first.get(html, k))
    want = sorted(
        (str(k), len(p), hashlib.sha256(p).hexdigest(), str(first[html] if html in first and first[html] != k else None))
        for k, _, html in rows
        for p in [(html or "").encode()]
    )
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, str(r.refers_to)) for r in got) == want
    for r in got:
        assert r.record_type == ("response" if r.refers_to is None else "revisit")
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest


def test_no_pages(spark):
    manifest = warc.write(spark.createDataFrame([], PAGES))
    assert manifest.count() == 0 and warc.read(manifest).count() == 0


class Row:
    page_id, url, payload, payload_bytes, refers_to = 5, "http://x.org/", b"hello world" * 40, 440, None
    payload_digest = hashlib.sha256(payload).hexdigest()


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_sequential_reader(chunk):
    one = warc.record(Row)
    rows = list(warc.members(io.BytesIO(one * 3), True, chunk))
    assert [r["payload"] for r in rows] == [Row.payload] * 3 and all(r["digest_ok"] for r in rows)
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\n")
    cut = list(warc.members(io.BytesIO(one + one[:-9]), False, chunk))
    assert cut[0]["digest_ok"] and not cut[1]["digest_ok"] and cut[1]["error"]
    plain = gzip.decompress(one)
    wrong = gzip.compress(plain.replace(b"hello world", b"jello world", 1))
    assert [r["digest_ok"] for r in warc.members(io.BytesIO(wrong + one), False, chunk)] == [False, True]
    short = gzip.compress(plain.replace(b"Content-Length: ", b"Content-Length: 9", 1))
    assert list(warc.members(io.BytesIO(short), False, chunk))[0]["error"]


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("Example.ORG", "/es/", "allow")]


def judged(url, rules):
    host, path = urls.parts(url)
    best = None
    for h, p, v in rules:
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or len(h + p) > len(best[0]) or (len(h + p) == len(best[0]) and v == "block"):
                best = (h + p, v)
    return (host, path, best and best[0], best[1] if best else "allow")


def test_url_filter(spark):
    prepare(spark)
    given = [None, "", "nothing", "http://", "http://ORG/", "http://a.org", "http://a.org/x", "https://www.Example.org/es/1?x#y", "http://example.org/en/123", "http://example.org/en/2", "http://notexample.org/es/", "ftp://b.com/de/#f", "b://c.com?/fr/", "x://com/fr/://org/", "http://" + "a." * 5000 + "org/q", "http://é.com/fr/日"]
    rows = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(given)], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(rows, rules).collect()}
    assert got == {k: judged(u, RULES) for k, u in enumerate(given)}
    none = urls.judge(rows, rules.limit(0)).collect()
    assert {r.verdict for r in none} == {"allow"} and {r.rule for r in none} == {None}
    assert urls.judge(rows.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        urls.judge(rows, rules, max_rules=3)


def test_digests_that_collide(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda key: len(key))
    path = str(tmp_path / "list")
    urls.DigestArray.write(path, {"aa": "allow", "bb": "block", "c": "block"}, [0], 1)
    assert urls.DigestArray(path).find(["bb", "aa", "zz", "c", "d"]) == ["block", "allow", None, "block", None]


def test_licences(spark):
    prepare(spark)
    texts = ["", None, "CC BY cc-by, Cc bY", "All rights reserved. all RIGHTS  reserved", "GNU general\npublic license", "cc byx", "Licensed under the Apache Licence, Version 2.0", "released undr the MIT license", "x " * 90_000 + "cc by", "licensed under cc by nc licensed under cc by nc", "Permission is hereby granted, free of charge, to any persn"]
    got = {r.doc_id: r for r in licenses.scan(data.frame(spark, list(enumerate(texts))).withColumn("score", F.lit("mine"))).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licences(t), t
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert "apache-2.0" in got[6].labels and "mit" in got[7].labels and got[7].places[0].edits == 1
    assert len([p for p in got[9].places if p.label == "cc-by-nc"]) == 2 and "mit" in got[10].labels
    assert got[0].score == 0 and got[0].labels == ""


def test_notices_with_few_edits_are_found():
    """Whatever the edits and their places: pieces and matching together miss none."""
    rng = random.Random(8)
    scanner = licenses.Scanner()
    for notice, label, most in licenses.NOTICES:
        for _ in range(25):
            text = list(notice)
            for _ in range(rng.randrange(most + 1)):
                at = rng.randrange(1, len(text) - 1)
                kind = rng.randrange(3)
                text[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice("xyz")]
            text = "".join(text)
            if brute.edits(text, notice) <= most and "  " not in text:
                line = licenses.normal(f"before {text} after")
                assert any(p.label == label for p in scanner.find(line)), (text, notice)


def test_token_counts(spark):
    prepare(spark)
    model = "/opt/tokenizers/piece_bpe_32k.model"
    pieces = tokens.vocabulary(model)
    rows = [(d, t) for d, t in data.docs(4) if t is None or len(t) < 40_000] + [(9000, "日本語 naïve 🙂🙂 a" + "b" * 200)]
    want = {}
    for d, t in rows:
        ws = [w.decode() for w in brute.words(t)]
        want[d] = (len(ws), sum(brute.tokens(tokens.MARK + w, pieces, tokens.zipf(len(pieces))) for w in ws if len(w) < 1000) )
    for limit in (tokens.MAX_NODES, 20):
        got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokens.count_tokens(data.frame(spark, rows), model, max_nodes=limit).collect()}
        for d, t in rows:
            if not any(len(w) >= 1000 for w in (t or "").split()):
                assert got[d] == want[d], t


def test_shared_prefixes_are_computed_once():
    pieces = {"a": -1.0, "ab": -1.5, "b": -2.0}
    trie, steps = tokens.Trie(pieces), []
    step = trie.step
    trie.step = lambda word, i, *rest: steps.append(word[: i + 1]) or step(word, i, *rest)
    assert [trie.count(w) for w in ("ab", "abab", "abb", "b")] == [1, 2, 2, 1]
    assert sorted(steps) == sorted(set(steps)) and len(steps) == 6


def vectors(n=600, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [(int(k), [float(x) for x in centres[k % 12] + 0.3 * rng.normal(size=dim)]) for k in range(n)]
    rows += [(k, rows[7][1]) for k in range(n, n + 300)]  # one very common vector
    odd = [(2000, None), (2020, []), (2040, [0.0] * dim), (2060, [float("nan")] + [1.0] * (dim - 1)), (2080, [None] + [1.0] * (dim - 1)), (2100, [float("inf")] * dim), (2120, [1.0]), (None, rows[0][1])]
    return rows + odd + rows[:3]


@pytest.mark.parametrize("block", [neighbours.BLOCK, 64])
def test_neighbours(spark, block, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "LEAST_VISITED", 60)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int" if False else "vec_id long, embedding array<float>")
    got = neighbours.search(df, df.filter("vec_id % 20 = 0"), k=10).collect()
    known = {k: np.array(v, np.float32).astype(float) for k, v in rows if k is not None and k < 2000}
    ids = np.array(sorted(known))
    whole = np.array([known[k] for k in ids])
    hits = total = 0
    asked = [k for k in known if k % 20 == 0]
    assert {r.query_id for r in got} == set(asked)
    for q in asked:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        score = (whole * known[q]).sum(1)
        score[ids == q] = -np.inf
        order = np.lexsort((ids, -score))[:10]
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(abs(r.score - score[ids == r.vec_id][0]) < 1e-12 for r in own)
        least = score[order[-1]]
        hits += sum(r.score >= least - 1e-12 for r in own)
        total += 10
    assert hits / total >= 0.9


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "vec_id long, embedding array<float>")
    got = neighbours.search(df, df.filter("vec_id = 0"), k=20).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 2, 3.0), (2, 1, 2.0)]
    assert neighbours.search(df.limit(0), df, k=20).count() == 0
    assert neighbours.search(df, df.limit(0), k=20).count() == 0


def test_traversal_is_ordered():
    rng = np.random.default_rng(1)
    first, second, query = rng.normal(size=(5, 3)), rng.normal(size=(4, 3)), rng.normal(size=6)
    count = rng.integers(0, 3, 20)
    sums = ((first @ query[:3])[:, None] + (second @ query[3:])[None, :]).ravel()
    want = [c for c in np.argsort(-sums, kind="stable") if count[c]]
    assert neighbours.visit_order(query, first, second, count, 10**9) == want
    some = neighbours.visit_order(query, first, second, count, 5)
    assert some == want[: len(some)] and count[some].sum() >= 5 > count[some[:-1]].sum()

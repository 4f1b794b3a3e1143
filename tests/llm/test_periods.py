"""Periodic runs against a plain search for every period."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectrafold.llm import periods, queries
from spectrafold.llm.words import PLAIN, split
from tests.llm import brute, data


def brute_runs(ws, shortest=6, least=4):
    found = {}
    for q in range(1, len(ws) // least + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, least * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in found.items())


def brute_row(doc_id, text):
    ws = brute.words(text)
    n = len(ws)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(ws)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()),
        sha(b" ".join(w for i, w in enumerate(ws) if i not in gone)),
    )


words = st.lists(st.sampled_from("ab"), max_size=40) | st.lists(st.sampled_from("abcdef"), max_size=60)
periodic = st.builds(lambda head, part, k, tail: head + part * k + tail, words, words, st.integers(1, 9), words)


@settings(max_examples=300, deadline=None)
@given(st.lists(periodic, min_size=1, max_size=4))
def test_all_runs_and_no_others(texts):
    got = periods.runs(split([" ".join(t) for t in texts], PLAIN))
    assert [got.get(k, []) for k in range(len(texts))] == [brute_runs(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(periodic, st.integers(6, 9), st.integers(2, 5))
def test_other_limits(text, shortest, least):
    got = periods.runs(split([" ".join(text)], PLAIN), shortest, least)
    assert got.get(0, []) == brute_runs(text, shortest, least)


def test_one_word_many_times():
    assert periods.runs(split(["same " * 40_000], PLAIN)) == {0: [(0, 40_000, 1)]}


def test_frequent_line_is_no_run():
    rng = random.Random(2)
    text = " ".join(f"{rng.randrange(10**9)} a b c d e f" for _ in range(20_000))
    assert periods.runs(split([text], PLAIN)) == {}


def test_query_equals_plain_version(spark, tmp_path):
    rows = data.docs()
    rows += [rows[0], (rows[0][0], "other text"), (None, "a b " * 9), (10**12, "q " * 7 + "r s t")]
    data.frame(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted((brute_row(*r) for r in rows), key=key)
    tails = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0]
    assert any(r.n_runs for r in tails)


def test_empty_and_clashing_columns(spark):
    schema = "doc_id long, text string, runs int, Collapsed int, other string"
    assert periods.collapse(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "x y " * 4, 5, 6, "kept"), (2, None, 5, 6, None), (3, " \t", 5, 6, "")], schema)
    got = {r.doc_id: r for r in periods.collapse(df).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 8, 2)] and got[1].collapsed == "x y" and got[1].other == "kept"
    assert got[2].n_words == got[3].n_words == 0 and got[2].collapsed == got[3].collapsed == ""


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_whole_table(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, folder).collect()}
    short = [r for r in rows if len(r.text or "") < 6000]
    assert len(got) == len(rows) and len(short) > 100
    assert all(got[r.doc_id] == brute_row(r.doc_id, r.text) for r in short)

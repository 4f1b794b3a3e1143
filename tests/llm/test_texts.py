"""Joins, dedup and decontamination against brute force."""

from __future__ import annotations

import random
import uuid

import pytest

from spectrafold.llm import decontaminate, frames, graphs, ngram_join, substrings
from spectrafold.llm.frames import prepare
from tests.llm import brute, data


@pytest.fixture(scope="module")
def rows():
    return data.docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    prepare(spark)
    return data.frame(spark, rows).repartition(5).cache()


@pytest.mark.parametrize("n, num, den", [(4, 85, 100), (5, 80, 100)])
def test_ngram_join(docs, rows, n, num, den):
    got = {r[0]: (r[1], r[2]) for r in ngram_join.report(docs, n, num, den).collect()}
    assert got == brute.components(rows, n, num, den)


def test_groups_of_many_near_copies(spark):
    """Copies of one text with more or fewer edits: some link with it, some only with each other."""
    rng = random.Random(7)
    base = data.prose(rng, 200)
    rows = []
    for k in range(90):
        edits = rng.choice((0, 1, 2, 4, 5, 6, 8, 12))
        copy = list(base)
        for at in rng.sample(range(200), edits):
            copy[at] = f"e{k}x{at}"
        rows.append((k, " ".join(copy)))
        if k % 9 == 0:
            rows.append((1000 + k, " ".join(copy[:-1])))
    got = {r[0]: (r[1], r[2]) for r in ngram_join.report(data.frame(spark, rows)).collect()}
    want = brute.components(rows)
    assert got == want and len({c for _, c in want.values()}) > 5


def test_short_sets_are_found(spark, monkeypatch):
    """With hardly any slack, sets with empty segments still find their partners."""
    monkeypatch.setattr(ngram_join, "allocation", lambda k, num, den: (
        (most + 1, 0) if (most := ngram_join.differing(ngram_join.band_start(k + 1) - 1, num, den)) else (0, 0)
    ))
    rng = random.Random(5)
    rows = []
    for k in range(60):
        ws = data.prose(rng, rng.choice((11, 12, 14, 18, 25)))
        rows += [(4 * k, " ".join(ws)), (4 * k + 1, " ".join(ws[:-1])), (4 * k + 2, " ".join([*ws, "z"]))]
    got = {r[0]: (r[1], r[2]) for r in ngram_join.report(data.frame(spark, rows)).collect()}
    assert got == brute.components(rows)


def test_allocation_leaves_room():
    for num in (80, 85, 95):
        for k in range(30):
            m, near = ngram_join.allocation(k, num, 100)
            most = ngram_join.differing(ngram_join.band_start(k + 1) - 1, num, 100)
            assert (m == 0) == (most == 0) and (m == 0 or m > most)


def test_index_goes_when_it_is_read(docs, rows, tmp_path, monkeypatch):
    """Keys, texts and prefixes are not kept beside the next step's, nor after the last."""
    there = {}

    def folder(_spark, name):
        there[name] = {p.name.rpartition(".")[0] for p in tmp_path.iterdir()}
        return str(tmp_path / f"{name}.{uuid.uuid4().hex}")

    monkeypatch.setattr(frames, "shared_folder", folder)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.report(docs).collect()}
    assert got == brute.components(rows)
    assert "join-distinct" in there["join-members"] and "join-distinct" not in there["join-texts"]
    assert "join-texts" in there["join-links"]
    assert there["rare-counts"].isdisjoint({"join-texts", "join-degrees", "join-placed", "join-stars"})
    assert {p.name.rpartition(".")[0] for p in tmp_path.iterdir()} == {"join-nodes", "join-told", "links", "labels"}
    with pytest.raises(KeyError):
        frames.discard(docs)


def test_distinct_documents(spark, rows):
    repeated = data.frame(spark, rows + rows[:5] + [(None, "nobody"), (None, rows[0][1])]).repartition(3)
    got = ngram_join.distinct_documents(repeated)
    want = {d for d, (_, c) in brute.components(rows, 5, 80, 100).items() if c == d}
    ids = [r[0] for r in got.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert got.columns == repeated.columns


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(graphs.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100}


@pytest.mark.parametrize("length, gram", [(50, 20), (12, 5), (3, 3), (1, 1)])
def test_substrings(spark, rows, length, gram):
    few = [(d, t) for d, t in rows if t is None or len(t) < 20_000] if length < 12 else rows
    got = substrings.report(data.frame(spark, few).repartition(4), length, gram)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == brute.substrings(few, length)


def test_substrings_in_several_copies(spark, rows, monkeypatch):
    monkeypatch.setattr(substrings, "PER_COPY", 3)
    got = substrings.report(data.frame(spark, rows))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == brute.substrings(rows)


def test_later_documents_share_what_the_first_lacks(spark):
    """The second round: two documents agree on a window beside an anchor of a third."""
    rng = random.Random(9)
    core, left, right = data.prose(rng, 60), data.prose(rng, 60), data.prose(rng, 60)
    rows = [(1, " ".join(core)), (2, " ".join(left + core + right)), (3, " ".join(left + core + right[:30])), (4, " ".join(left[30:] + core))]
    got = {r[0]: tuple(r[1:]) for r in substrings.report(data.frame(spark, rows)).collect()}
    assert got == brute.substrings(rows)
    assert got[3][1] == 150


def test_automaton_statistics():
    rng = random.Random(2)
    for _ in range(60):
        parts = [[rng.choice("ab").encode() for _ in range(rng.randrange(9))] for _ in range(3)]
        query = [rng.choice("abc").encode() for _ in range(12)]
        automaton = substrings.Automaton()
        for p in parts:
            automaton.add(p)
        inside = {tuple(p[i:j]) for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        want = [max((n for n in range(1, k + 1) if tuple(query[k - n : k]) in inside), default=0) for k in range(1, 13)]
        assert automaton.statistics(query) == want


def test_dedup_keeps_other_columns(spark, rows):
    docs = data.frame(spark, rows + rows[:3] + [(None, rows[0][1])]).withColumnRenamed("lang", "kept")
    got = substrings.dedup(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    want = brute.substrings(rows)
    given = dict(rows)
    for r in got.collect():
        if r.doc_id is None or want[r.doc_id][1] == 0:
            assert r.text == given.get(r.doc_id, rows[0][1])
        else:
            assert len(brute.words(r.text)) == want[r.doc_id][0] - want[r.doc_id][1]
            assert r.n_chars == len(r.text)


ITEMS = "item_id long, text string"


def items(rows):
    rng = random.Random(4)
    long = [t for _, t in rows if t and len(t.split()) > 100]
    out = [(k, " ".join(t.split()[10 : 10 + 5 * (k % 9 + 1)]).upper()) for k, t in enumerate(long)]
    out += [(900, None), (901, ""), (902, "too short here"), (903, " ".join(data.prose(rng, 30))), (903, out[0][1])]
    return [*out, out[1]]


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_contained(spark, docs, rows, block, monkeypatch):
    monkeypatch.setattr(decontaminate.found, "__defaults__", (decontaminate.SHARE, block))
    own = items(rows)
    got = decontaminate.contained(docs, spark.createDataFrame(own, ITEMS))
    assert {(r[0], r[1]) for r in got.collect()} == brute.contained(rows, own[:-2] + [own[-2]]) | brute.contained(
        rows, [i for i in own if i[0] == 903][:1]
    )


def test_clean(spark, docs, rows):
    own = [i for i in items(rows) if i[0] < 900]
    dirty = {d for d, _ in brute.contained(rows, own)}
    got = decontaminate.clean(docs.withColumnRenamed("lang", "items"), spark.createDataFrame(own, ITEMS))
    assert got.columns == ["doc_id", "text", "items", "source", "n_chars"]
    assert {r.doc_id for r in got.collect()} == {d for d, _ in rows} - dirty


def test_empty_tables(spark):
    none = spark.createDataFrame([], data.DOCS)
    assert ngram_join.report(none).count() == 0
    assert ngram_join.distinct_documents(none).count() == 0
    assert substrings.report(none).count() == 0
    assert substrings.dedup(none).count() == 0
    assert decontaminate.contained(none, spark.createDataFrame([], ITEMS)).count() == 0
    some = data.frame(spark, [(1, "a b c d e f"), (2, None)])
    assert decontaminate.clean(some, spark.createDataFrame([], ITEMS)).count() == 2

"""HyperMinHash near-duplicates: the registers, the estimate, and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from spectrafold.llm import hyperminhash as h
from tests.llm import brute, data


def hashes(rng, n):
    return rng.integers(0, 2**64, n, dtype=np.uint64)


def test_registers_hold_leading_zeros_and_mantissa():
    rng = np.random.default_rng(1)
    values = [int(v) >> int(s) for v, s in zip(hashes(rng, 500), rng.integers(0, 50, 500))] + [2**64 - 1, 2**63, 2**53 - 1]
    for v, got in zip(values, h.compressed(np.array(values, np.uint64)).tolist()):
        top = v >> 11
        if top:
            bits = bin(top)[3:].ljust(h.MANTISSA, "0")[: h.MANTISSA]
            assert got == (53 - top.bit_length()) << h.MANTISSA | int(bits, 2)


def test_chance_of_accidental_agreement():
    rng = np.random.default_rng(2)
    for n, m in ((5, 5), (40, 50), (900, 1000)):
        pairs = [(h.sketch(hashes(rng, n)), h.sketch(hashes(rng, m))) for _ in range(1500)]
        seen = np.mean([(a == b).mean() for a, b in pairs])
        assert seen == pytest.approx(float(h.accidental(n, m)), rel=0.25, abs=2e-5)


@pytest.mark.parametrize("size", [10, 300, 6000])
def test_estimate(size):
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8):
        got = []
        for _ in range(60):
            both = hashes(rng, round(size * share))
            a = np.concatenate([both, hashes(rng, (size - len(both)) // 2)])
            b = np.concatenate([both, hashes(rng, (size - len(both)) // 2)])
            real = len(both) / (len(a) + len(b) - len(both))
            equal = (h.sketch(a) == h.sketch(b)).sum()
            got.append(float(h.similarity(equal, len(a), len(b))) - real)
        assert abs(np.mean(got)) < 0.02 and np.std(got) < 0.06


def family(seed, n, length=60, changes=(3, 12)):
    """Copies of one text with some of their words replaced: similar to some of the others only."""
    rng = random.Random(seed)
    base = data.prose(rng, length)
    out = []
    for _ in range(n):
        ws = list(base)
        for i in rng.sample(range(length), rng.randint(*changes)):
            ws[i] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(ws))
    return out


def check(spark, rows, **limits):
    got = h.report(data.frame(spark, rows).repartition(3), **limits).collect()
    expected = brute.components(rows, limits.get("words", 4), limits.get("num", 80), limits.get("den", 100))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert len(got) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_equals_brute_force(spark):
    check(spark, data.docs())
    check(spark, data.docs(2), words=5, num=80, den=100)


def test_open_keys_are_finished(spark, monkeypatch):
    """Small limits, so that every way of finishing an open key has work."""
    monkeypatch.setattr(h, "COMPARED", 400)
    monkeypatch.setattr(h, "BLOCK", 20)
    rows = list(enumerate(family(5, 150, changes=(1, 3)) + family(6, 120, changes=(2, 6)) + family(7, 60, 200, (4, 9))))
    check(spark, rows)


def test_templates_below_the_threshold(spark):
    """Many texts of the same long passage and words of their own: one key each way, no link."""
    rng = random.Random(8)
    passage = data.prose(rng, 60)
    rows = [(d, " ".join(passage + [f"own{d}w{k}" for k in range(25)])) for d in range(3000)]
    got = h.report(data.frame(spark, rows)).filter("component_id != doc_id")
    assert got.isEmpty()


def test_repeated_ids_nulls_and_empty(spark):
    a, b = family(9, 1)[0], family(10, 1)[0]
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " x"), (8, a), (8, a), (None, b), (None, "alone here"), (9, None), (10, "")]
    got = sorted(((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in h.report(data.frame(spark, rows)).collect()), key=str)
    n = 57
    assert got == sorted(
        [(5, 5, True, n)] * 2 + [(6, 5, False, n + 1), (7, 5, False, n + 1)] + [(8, 5, False, n)] * 2
        + [(None, 5, False, n), (None, None, True, 1), (9, 9, True, 0), (10, 10, True, 0)], key=str,
    )
    assert h.report(spark.createDataFrame([], data.DOCS)).collect() == []
    clash = spark.createDataFrame([(1, a, 3, "r")], "doc_id int, text string, set int, registers string")
    assert [tuple(r) for r in h.report(clash).collect()] == [(1, n, 1, True)]


def test_lowest_shingles_decide():
    rng = np.random.default_rng(11)
    for size in (8, 300, 512, 4000):
        for share in (0.5, 0.7, 0.79, 0.81, 0.9):
            both = hashes(rng, round(size * share))
            a = np.sort(np.concatenate([both, hashes(rng, (size - len(both)) // 2)]))
            b = np.sort(np.concatenate([both, hashes(rng, (size - len(both)) // 2)]))
            similar = 100 * len(both) >= 80 * (len(a) + len(b) - len(both))
            got = h.possible(h.lowest(a), h.lowest(b), len(a), len(b), 80, 100)
            assert got == similar if max(len(a), len(b)) <= h.LOWEST else got >= similar
            assert not (got and share <= 0.5)


def test_pairs_with_one_large_key_in_common(spark, monkeypatch):
    """Each pair shares one key only, and every open key is large: none may be left out."""
    monkeypatch.setattr(h, "_BAND", h._BAND[:1])
    rng = random.Random(12)
    passage, rows = data.prose(rng, 80), []
    for d in range(0, 400, 2):
        own = [f"own{d}w{k}" for k in range(14)]
        rows += [(d, " ".join(passage + own)), (d + 1, " ".join(passage + own[:-1]))]
    linked = {}
    for limit in (0, 10**12):
        monkeypatch.setattr(h, "COMPARED", limit)
        got = h.report(data.frame(spark, rows)).filter("component_id != doc_id").collect()
        linked[limit] = {(r.doc_id, r.component_id) for r in got}
    assert linked[0] == linked[10**12] and len(linked[0]) > 20

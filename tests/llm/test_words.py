from __future__ import annotations

from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spectrafold.llm import words as W
from tests.llm import brute

TEXTS = st.lists(
    st.one_of(st.none(), st.text(alphabet="aAbZ09 .-\t\n\x0b\x0céß日", max_size=60)), max_size=6
)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_sequences(texts):
    for how, pattern, lower in ((W.PLAIN, brute.SPACED, False), (W.LOWER, brute.SPACED, True), (W.ALNUM, brute.ALNUM, True)):
        got = W.split(texts, how)
        seen = {}
        for (lo, hi), text in zip(got.texts(), texts):
            want = brute.words(text, pattern, lower)
            assert [got.data[s:e] for s, e in zip(got.start[lo:hi], got.end[lo:hi])] == want
            for w, h in zip(want, got.hash[lo:hi].tolist()):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)
        for n in (1, 2, 3):
            found = defaultdict(set)
            for own, text in zip(W.shingles(got, n), texts):
                want = brute.shingles(brute.words(text, pattern, lower), n)
                assert len(own) == len(want) and (np.diff(own.astype(object)) > 0).all()
                found[frozenset(want)].add(own.tobytes())
            assert all(len(v) == 1 for v in found.values())


def test_blocks_do_not_matter(monkeypatch):
    texts = [" ".join(str(k * 7919) for k in range(500)), "x" * 5000 + " y " + "z" * 3000]
    want = W.split(texts, W.PLAIN).hash.copy()
    monkeypatch.setattr(W, "_BLOCK", 64)
    assert (W.split(texts, W.PLAIN).hash == want).all()


def test_batches_cover_all():
    texts = ["a" * 5, None, "b" * 100, "", "c"]
    assert [texts[s] for s in W.batches(texts, 10)] == [["a" * 5, None, "b" * 100], ["", "c"]]

"""Small made-up texts with the awkward cases every operator has to take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(n)]


def docs(seed=1):
    """Rows (doc_id, text): copies, near copies, shared passages, short, long, odd and null texts."""
    rng = random.Random(seed)
    out, base = [], [prose(rng, rng.choice((8, 20, 60, 150, 400))) for _ in range(30)]
    passage = prose(rng, 70)
    for ws in base:
        out.append(" ".join(ws))
        out.append(" ".join(ws).replace(" ", "\n", 1))
        for rate in (0.01, 0.03, 0.05, 0.1):
            copy = [w if rng.random() > rate else "x" + w for w in ws]
            out.append(" ".join(copy))
        out.append(" ".join(ws[: len(ws) // 2] + passage + ws[len(ws) // 2 :]))
    out += [" ".join(passage[k : k + 55]) for k in range(0, 16, 3)]
    out += ["", None, "   \t\n", "one", "one", "one two", "ONE two", "a b c", "é ü ñ 日本 語", "x" * 30_000]
    out += [" ".join(["same"] * 300), " ".join(["same"] * 500), " ".join(["same", "again"] * 200)]
    out += [" ".join(prose(rng, 20_000)), "tab\tvt\x0bff\x0ccr\rnl\nend"]
    rng.shuffle(out)
    return list(enumerate(out, start=3))


def frame(spark, rows):
    return spark.createDataFrame(
        [(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], DOCS
    )

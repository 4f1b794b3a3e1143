"""Mixing documents to target weights of domains that are known only softly.

A classifier learned from the labelled table gives every document a posterior over domains, so
a document belongs to several in part. Document d with t_d tokens and posterior p_d gets a
rate r_d >= 0 such that the expected tokens of each domain meet its target:

    minimise  sum_k (sum_d r_d t_d p_dk - T_k)^2   over  r >= 0

by projected gradient, the squares weighted by the inverse of the small matrix
G = sum_d t_d p_d p_d' over the documents whose rate is above 0, so that domains of little mass
move as fast. In the metric that counts a document by its tokens the gradient for r_d is
<p_d, G^-1 residual>; the step size is 1, halved while the residual would grow. One iteration
is one aggregate over the compact table (tokens, posteriors): a task folds the residuals so far into its documents'
rates, projects after each, and sends back one number per domain. The driver sees only those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.llm.frames import bounded_rows, mapped, stored
from spectrafold.llm.words import ALNUM, batches, split

# Domains of the labelled table and the share of tokens each should have.
TARGETS = {"high": 0.70, "low": 0.25, "toxic": 0.05}
MAX_ROWS = 20_000
BUCKETS = 64
ITERATIONS = 40
TOLERANCE = 1e-6


def domain(quality: Column, toxic: Column) -> Column:
    """Index in TARGETS of a labelled row."""
    return F.when(toxic == 1, 2).when(quality == 1, 0).when(quality == 0, 1)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and a dense description of each whole text.

    Shares of hashed words (signed, BUCKETS of them), and rates of capitals, digits, marks,
    repetition and word length. A null or empty text is all zeros.
    """
    def one(text: str, own: np.ndarray) -> np.ndarray:
        row = np.zeros(BUCKETS + 6)
        if n := len(own):
            sign = np.where(own >> np.uint64(63), 1.0, -1.0)
            raw = text.encode("utf-8", "surrogatepass")
            codes = np.frombuffer(raw, np.uint8)
            row[:BUCKETS] = np.bincount((own % np.uint64(BUCKETS)).astype(np.int64), sign, BUCKETS) / n
            row[BUCKETS:] = (
                ((codes >= 65) & (codes <= 90)).mean(),
                ((codes >= 48) & (codes <= 57)).mean(),
                np.isin(codes, (33, 63, 124)).mean(),
                len(np.unique(own)) / n,
                len(raw) / n / 10,
                np.log1p(n) / 10,
            )
        return row

    def compute(texts):
        counts, rows = [], []
        for part in batches(texts):
            words = split(texts[part], ALNUM)
            for text, (lo, hi) in zip(texts[part], words.texts()):
                counts.append(hi - lo)
                rows.append(one(text, words.hash[lo:hi]))
        return {"n_tokens": counts, "features": rows}

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(text, "n_tokens long, features array<double>", lambda: compute, ["text"], drop=["text"])


def fit(rows: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> LogisticRegressionModel | int | None:
    """A classifier of domains from at most ``max_rows`` labelled rows, chosen by hash.

    With one domain only, its index; without labelled rows, None.
    """
    known = (
        labels.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("domain"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("domain").alias("domain"))
    )
    sample = rows.join(F.broadcast(bounded_rows(known, "doc_id", max_rows)), "doc_id")
    sample = stored(sample.withColumn("vector", array_to_vector("features")).coalesce(8), "mix-sample")
    seen = [r.domain for r in sample.select("domain").distinct().collect()]
    if len(seen) < 2:
        return seen[0] if seen else None
    return LogisticRegression(
        featuresCol="vector", labelCol="domain", family="multinomial", regParam=1e-3, maxIter=40
    ).fit(sample)


def posteriors(rows: DataFrame, model: LogisticRegressionModel | int | None) -> DataFrame:
    """doc_id, n_tokens, posterior (one share per domain of TARGETS, summing to 1)."""
    k = len(TARGETS)
    if isinstance(model, LogisticRegressionModel):
        share = vector_to_array("probability")
        # A model that never saw the last domains has shorter vectors.
        missing = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(k) - F.size(share)))
        rows = model.transform(rows.withColumn("vector", array_to_vector("features")))
        made = F.concat(share, missing)
    elif model is None:
        made = F.array(*[F.lit(1.0 / k)] * k)
    else:
        made = F.array(*[F.lit(float(j == model)) for j in range(k)])
    return rows.select("doc_id", "n_tokens", made.alias("posterior"))


def _fold(shares: np.ndarray, start: float, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the given steps, projected after each."""
    rate = np.full(len(shares), start)
    for step in steps:
        rate = np.maximum(0.0, rate - shares @ step)
    return rate


def _shares(frame: pd.DataFrame) -> np.ndarray:
    return np.array(frame["posterior"].tolist(), float).reshape(len(frame), len(TARGETS))


def totals(rows: DataFrame, start: float, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain at the rates after ``steps``, and sum of t p p' where rates are above 0."""
    k = len(TARGETS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mass, gram = np.zeros(k), np.zeros((k, k))
        for frame in frames:
            p, t = _shares(frame), frame["n_tokens"].to_numpy(float)
            rate = _fold(p, start, steps)
            mass += (t * rate) @ p
            gram += (p * (t * (rate > 0))[:, None]).T @ p
        yield pd.DataFrame({"at": np.arange(k + k * k), "value": np.concatenate([mass, gram.ravel()])})

    sums = (
        rows.mapInPandas(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    )
    found = np.zeros(k + k * k)
    for row in sums.collect():  # k + k * k numbers
        found[row.at] = row.value
    return found[:k], found[k:].reshape(k, k)


def rates(
    rows: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None,
    iterations: int = ITERATIONS,
) -> DataFrame:
    """doc_id, n_tokens, posterior, rate, copies.

    Targets are shares of ``budget`` tokens (default: all tokens there are). ``copies`` turns
    the rate into a count: its whole part, and one more with the probability of the rest,
    decided by a hash of the id. A domain without any posterior mass cannot be met; the
    others are then met as well as they can be.
    """
    weights = np.array(list((targets or TARGETS).values()), float)
    start = 1.0
    mass, gram = totals(rows, start, [])
    goal = weights / weights.sum() * (budget if budget is not None else mass.sum())
    steps: list[np.ndarray] = []
    if mass.sum() > 0:
        start = float(goal.sum() / mass.sum())
        mass = mass * start
        step = None
        for _ in range(iterations):
            left = np.linalg.norm(mass - goal)
            if step is None:
                if left <= TOLERANCE * goal.sum():
                    break
                step = np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ (mass - goal)
            after, active = totals(rows, start, [*steps, step])
            gain = left - np.linalg.norm(after - goal)
            if gain < 0:
                step = step / 2
                continue
            steps.append(step)
            mass, gram, step = after, active, None
            if gain <= TOLERANCE * goal.sum():
                break
    final = list(steps)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(rate=_fold(_shares(frame), start, final))

    schema = "doc_id long, n_tokens long, posterior array<double>, rate double"
    chance = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return rows.mapInPandas(run, schema).withColumn(
        "copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    )


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Rates of all documents, one row for each row of ``docs`` (columns as in ``rates``).

    Texts that are null or empty have no tokens and change nothing; they get a rate like any
    other. Labels that are null, or of documents that are absent, are ignored.
    """
    rows = stored(described(docs), "mix-described")
    model = fit(rows, labels, max_rows)
    return rates(stored(posteriors(rows, model), "mix-posteriors"), targets)

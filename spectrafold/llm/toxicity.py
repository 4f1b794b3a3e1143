"""Toxicity: gradient-boosted trees over a few dense features, with isotonic calibration.

The lexicon is learned from labelled texts: words that stand in many toxic ones and hardly in
others. Features are rates over the whole text: lexicon density (plain and behind obfuscated
spellings), hits near a second-person word, capitals, punctuation, obfuscation. The trees and
the calibration are Spark's own learners, fitted on a bounded sample of labelled rows
(``max_rows``, chosen by hash, so alike on any layout); scoring is one pass over the texts
followed by expressions, with no shuffle.

The lexicon that serves a training row comes from the other half of the sample, so the trees
never see a density that was fitted to the row itself.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.llm.frames import bounded_rows, mapped, stored
from spectrafold.llm.words import ALNUM

MAX_ROWS = 20_000
MAX_LEXICON = 500
THRESHOLD = 0.7
SEED = 17

# Second-person words of four languages.
SECOND_PERSON = (
    "you your yours yourself u ur thou thy du dich dir dein deine euch ihr sie "
    "tu te toi ton ta tes vous votre vos tú ti usted ustedes tus vosotros"
)
# Letters that digits and signs stand for.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

NEAR = 6  # words between a hit and a second-person word
_PERSON = frozenset(w.encode() for w in SECOND_PERSON.split())
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!?"
_PUNCT = bytes(c for c in range(33, 127) if not bytes([c]).isalnum())
# Possessive, and begun only where a run begins: linear in very long words too.
_SIGNS = re.compile(rb"(?<![a-z])[a-z]++(?:[0-9@$!|*._-]++[a-z]++)++")
_SPACED = re.compile(rb"(?<![a-z])(?:[a-z][ .*_-]){3,}[a-z](?![a-z])")
_LEET = bytes.maketrans("".join(LEET).encode(), "".join(LEET.values()).encode())
FEATURES = (
    "words", "hits", "density", "distinct", "weight", "strongest", "near", "hidden_hits",
    "hidden", "capitals", "shouted", "marks", "punctuation", "digits",
)


def features(text: str | None, lexicon: dict[bytes, float]) -> list[float]:
    """The values of FEATURES for a whole text; all 0 for a null or empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(ALNUM).split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    hits = [k for k, w in enumerate(words) if w in lexicon]
    near = sum(not _PERSON.isdisjoint(words[max(0, k - NEAR) : k + NEAR + 1]) for k in hits)
    low = raw.lower()
    hidden = _SIGNS.findall(low) + _SPACED.findall(low)
    plain = (h.translate(_LEET, b" *._-") for h in hidden)
    found = [h for h in plain if h in lexicon]
    weights = [lexicon[words[k]] for k in hits] + [lexicon[h] for h in found]
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    count = lambda kind: len(raw) - len(raw.translate(None, kind))
    shouted = sum(w.isupper() for w in raw.split()) if upper > 0.2 * letters else 0
    return [
        math.log1p(n),
        float(len(hits)),
        len(hits) / n,
        float(len({words[k] for k in hits} | set(found))),
        sum(weights) / n,
        max(weights, default=0.0),
        near / n,
        float(len(found)),
        len(hidden) / n,
        upper / max(1, letters),
        shouted / n,
        count(_MARKS) / n,
        count(_PUNCT) / len(raw),
        count(_DIGITS) / len(raw),
    ]


def featured(df: DataFrame, lexicon: dict[bytes, float], text: str = "text", keep: bool = False) -> DataFrame:
    """``df`` with an array of the features, in place of the text unless that is kept."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)  # at most MAX_LEXICON words

    def start():
        return lambda texts: {"features": [features(t, shared.value) for t in texts]}

    return mapped(df, "features array<double>", start, [text], drop=() if keep else (text,))


def learn_lexicon(sample: DataFrame, limit: int = MAX_LEXICON) -> dict[bytes, float]:
    """Words and their log odds of standing in toxic texts; at most ``limit``, the surest."""
    totals = sample.agg(
        F.count(F.when(F.col("toxic") == 1, 1)).alias("a"), F.count(F.when(F.col("toxic") == 0, 1)).alias("b")
    ).first()
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (totals.a + 1 - a)) - F.log(b / (totals.b + 1 - b))
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_distinct(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    rows = (
        sample.select("toxic", F.explode(words).alias("word"))
        .filter(F.length("word").between(2, 40))
        .groupBy("word")
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        .filter((F.col("a") >= 3) & (F.col("a") >= 4 * F.col("b")))
        .select("word", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))
        .filter(F.col("z") >= 2.5)
        .orderBy(F.desc("z"), "word")
        .limit(limit)
        .collect()
    )
    return {r.word.encode("utf-8", "surrogatepass"): float(r.odds) for r in rows}


@dataclass
class Model:
    """What scoring needs. Without ``trees`` every text has the score ``prior``."""

    lexicon: dict[bytes, float]
    prior: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def _both(df: DataFrame) -> bool:
    return df.select("toxic").distinct().count() == 2


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Learn from at most ``max_rows`` labelled documents that are not held out.

    Labels that are null are ignored; of several labels of one document the largest counts.
    Without labelled documents, or with one class only, the model is that class's share.
    """
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .dropna()
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    chosen = bounded_rows(known, "doc_id", max_rows)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = stored(text.join(F.broadcast(chosen), "doc_id"), "toxicity-sample")
    prior = sample.agg(F.avg("toxic")).first()[0]
    if prior is None or prior in (0.0, 1.0):
        return Model({}, float(prior or 0.0))
    half = F.crc32(F.concat_ws(":", F.lit("half"), F.col("doc_id"))) % 2
    parts = [sample.filter(half == k) for k in (0, 1)]
    words = [learn_lexicon(p) for p in parts]
    rows = featured(parts[0], words[1]).unionByName(featured(parts[1], words[0]))
    rows = rows.withColumn("part", F.crc32(F.concat_ws(":", F.lit("part"), F.col("doc_id"))) % 3)
    rows = stored(rows.coalesce(8), "toxicity-rows").withColumn("vector", array_to_vector("features"))
    grown, kept = rows.filter("part > 0"), rows.filter("part = 0")
    if not (_both(grown) and _both(kept)):
        grown = kept = rows
    trees = GBTClassifier(
        featuresCol="vector", labelCol="toxic", maxIter=20, maxDepth=3, stepSize=0.3, seed=SEED
    ).fit(grown)
    margin = trees.transform(kept).select("toxic", _margin())
    calibration = IsotonicRegression(featuresCol="margin", labelCol="toxic").fit(margin)
    return Model(learn_lexicon(sample), float(prior), trees, calibration)


def _margin() -> Column:
    return vector_to_array("rawPrediction")[1].alias("margin")


def score(docs: DataFrame, model: Model, text: str = "text", keep: bool = False) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from THRESHOLD on), and its text if kept.

    Only the text enters the score; null and empty texts are scored like any other. Columns
    that are already called score or predicted are replaced, others keep their names.
    """
    left = [c for c in docs.columns if c.lower() not in ("score", "predicted") and (keep or c != text)]
    plain = {c: f"c{k}" for k, c in enumerate(dict.fromkeys([*left, text]))}  # no name clashes with the learners'
    rows = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in plain.items()])
    if model.trees is None:
        rows = rows.withColumn("score", F.lit(model.prior))
    else:
        rows = featured(rows, model.lexicon, plain[text], keep).withColumn("vector", array_to_vector("features"))
        held = [plain[c] for c in left]
        rows = model.trees.transform(rows).select(*held, _margin())
        rows = model.calibration.transform(rows).select(
            *held, F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)).alias("score")
        )
    return rows.select(
        *[F.col(plain[c]).alias(c) for c in left], "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )

"""The documents of a folder made ready for training, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spectrafold.llm import decontaminate, mixing, ngram_join, substrings, toxicity
from spectrafold.llm.frames import prepare, stored, table

# Not expressible: learned scores, and posteriors fitted iteratively. Tested against brute force.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=True)
    return scored.filter("predicted = 0").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles connect at 0.8 or more."""
    prepare(spark)
    return ngram_join.distinct_documents(docs, words=5, num=80, den=100).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that earlier documents hold."""
    prepare(spark)
    return substrings.dedup(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    prepare(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its posterior over domains, rate and number of copies."""
    prepare(spark)
    rows = mixing.mix(docs, table(spark, sf_dir, "labels"))
    return rows.select(
        "doc_id", "n_tokens", *[rows["posterior"][k].alias(f"share_{d}") for k, d in enumerate(mixing.TARGETS)],
        "rate", "copies",
    )


STAGES = [
    ("toxicity", toxic),
    ("ngram_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_items),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

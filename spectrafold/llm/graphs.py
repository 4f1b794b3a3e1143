"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.llm.frames import stored


def components(links: DataFrame) -> DataFrame:
    """doc_id, comp (smallest id reachable) of every document in ``links`` (a, b).

    Labels start as the ids. Each round takes the smallest label among the neighbours, then
    the label of that label (pointer jumping), until none changes; rounds grow with the
    logarithm of the longest chain. All work is joins and pre-aggregated minima; each round's
    labels are written to the shared folder.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    both = stored(both.filter("a != b").distinct(), "links")
    labels = stored(
        both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels"
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        )
        lower = labels.join(near, labels["doc_id"] == near["a"]).select(
            "doc_id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")
        )
        jump = labels.select(F.col("doc_id").alias("comp"), F.col("comp").alias("jumped"))
        after = stored(
            lower.join(jump, "comp", "left").select(
                "doc_id", "old", F.least("comp", F.coalesce("jumped", "comp")).alias("comp")
            ),
            "labels",
        )
        labels = after.select("doc_id", "comp")
        if after.filter("comp != old").isEmpty():
            return labels

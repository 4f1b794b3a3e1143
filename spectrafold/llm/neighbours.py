"""Nearest neighbours by inner product with an inverted multi-index.

Vectors are cut in two halves, each quantised by its own k-means; a pair of centroids is a cell,
so 2 k centroids make k * k cells. A query visits cells in the order of the summed inner products
of its halves with the two centroids. The order comes from a heap over the two sorted lists of
centroids (the pairs are never all sorted), until the cells visited hold enough vectors. Those
are ranked by the exact inner product of the original vectors.

Centroids are trained on a bounded sample (``SAMPLE`` vectors, chosen by hash); every vector is
indexed. How much has to be visited depends on the data, so it is measured: on the sample,
queries are compared with brute force and the smallest share of vectors that reaches
``recall`` is used. Vectors without structure need a large share, clustered ones a small one.

Cells are packed into blocks of about ``BLOCK`` vectors; a larger cell is split over several. A
query is sent to the blocks that hold its cells, a task keeps one block and streams queries
past it, and a window keeps the best of each query's few results per block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrafold.llm.frames import bounded_rows, stored

SAMPLE = 20_000
TRIALS = 200
BLOCK = 8_192
PER_COPY = 200_000  # queries that stream past one copy of a block
PER_CELL = 50
MOST_CENTROIDS = 256
LEAST_VISITED = 400
SHARES = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
SEED = 11


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and vector of the rows that take part.

    Left out: null ids, vectors null, empty, all zero or with a null or non-finite component, and
    those of another length than most. Of several vectors under one id the smallest counts.
    """
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (
        vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
        .filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .filter(finite & F.exists(v, lambda x: x != 0))
    )
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is not None:
        rows = rows.filter(F.size("vector") == length.n)
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


@dataclass
class Index:
    """Centroids of both halves, vectors per cell, and where cells lie."""

    first: np.ndarray
    second: np.ndarray
    count: np.ndarray  # vectors of each cell
    block: np.ndarray  # first block of each cell
    pieces: np.ndarray  # blocks it is split over
    visit: int  # vectors to visit for a query

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        half = self.first.shape[1]
        return nearest(vectors[:, :half], self.first) * len(self.second) + nearest(vectors[:, half:], self.second)

    def route(self, query: np.ndarray) -> list[int]:
        """Cells to visit, best first."""
        return visit_order(query, self.first, self.second, self.count, self.visit)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the closest centroid."""
    return ((centroids**2).sum(1) - 2 * vectors @ centroids.T).argmin(1)


def visit_order(
    query: np.ndarray, first: np.ndarray, second: np.ndarray, count: np.ndarray, enough: int
) -> list[int]:
    """Non-empty cells by falling summed inner product until they hold ``enough`` vectors.

    Multi-sequence traversal: pair (i, j) of the sorted lists enters the heap when (i - 1, j) and
    (i, j - 1) have left it.
    """
    half = first.shape[1]
    a, b = first @ query[:half], second @ query[half:]
    order_a, order_b = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    a, b = np.sort(a)[::-1].tolist(), np.sort(b)[::-1].tolist()
    width = len(b)
    heap = [(-(a[0] + b[0]), 0, 0)]
    gone = [-1] * len(a)  # last j that left in row i
    out, held = [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        gone[i] = j
        cell = order_a[i] * width + order_b[j]
        if count[cell]:
            out.append(cell)
            held += int(count[cell])
        if j + 1 < width and (i == 0 or gone[i - 1] > j):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if i + 1 < len(a) and gone[i + 1] == j - 1:
            heapq.heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))
    return out


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), float)


def _calibrated(sample: np.ndarray, index: Index, k: int, recall: float) -> float:
    """Smallest share of SHARES that reaches ``recall`` on the sample."""
    cells = index.cells(sample)
    count = np.bincount(cells, minlength=len(index.count))
    trials = sample[:: max(1, len(sample) // TRIALS)]
    scores = trials @ sample.T
    top = np.argsort(-scores, axis=1)[:, 1 : k + 1]
    needed = []  # share of the sample visited before each true neighbour's cell
    for query, best in zip(trials, top):
        order = visit_order(query, index.first, index.second, count, len(sample))
        place = np.full(len(count), len(sample))
        place[order] = np.concatenate([[0], np.cumsum(count[order])[:-1]])
        needed.append(place[cells[best]] / len(sample))
    needed = np.concatenate(needed) if needed else np.zeros(0)
    for share in SHARES:
        if not len(needed) or (needed < share).mean() >= recall:
            return share
    return 1.0


def fit(rows: DataFrame, k: int, recall: float) -> Index | None:
    """Train and calibrate on the bounded sample; None without vectors."""
    n = rows.count()
    if n == 0:
        return None
    chosen = bounded_rows(rows.select("vec_id"), "vec_id", SAMPLE)
    sample = stored(rows.join(F.broadcast(chosen), "vec_id").coalesce(8), "index-sample")
    local = _matrix(sample.orderBy("vec_id").toPandas()["vector"])  # at most SAMPLE rows
    half = (local.shape[1] + 1) // 2
    wanted = int(np.clip(round((n / PER_CELL) ** 0.5), 1, MOST_CENTROIDS))
    books = []
    for lo, hi in ((0, half), (half, local.shape[1])):
        distinct = len(np.unique(local[:, lo:hi], axis=0)) if hi > lo else 1
        if min(wanted, distinct) < 2:
            books.append(local[:, lo:hi].mean(0, keepdims=True))
            continue
        part = sample.select(array_to_vector(F.slice("vector", lo + 1, hi - lo)).alias("v"))
        model = KMeans(featuresCol="v", k=min(wanted, distinct), maxIter=12, seed=SEED).fit(part)
        books.append(np.array(model.clusterCenters()))
    size = len(books[0]) * len(books[1])
    empty = np.zeros(size, np.int64)
    index = Index(books[0], books[1], empty, empty, empty, 0)
    share = _calibrated(local, index, k, recall)
    index.visit = max(LEAST_VISITED, int(np.ceil(share * n)))
    return index


def indexed(rows: DataFrame, index: Index) -> DataFrame:
    """vec_id, vector, cell of every vector; fills in how cells lie in blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(cell=index.cells(_matrix(frame["vector"])).astype(np.int32))

    out = stored(rows.mapInPandas(run, "vec_id long, vector array<double>, cell int"), "index-cells")
    count = np.zeros(len(index.count), np.int64)
    for row in out.groupBy("cell").count().collect():  # at most MOST_CENTROIDS ** 2 rows
        count[row["cell"]] = row["count"]
    pieces = np.maximum(1, -(-count // BLOCK))
    block, at, held = np.zeros(len(count), np.int64), 0, 0
    for cell in np.flatnonzero(count).tolist():
        if pieces[cell] > 1 or held + count[cell] > BLOCK:
            at, held = at + (held > 0), 0
        block[cell] = at
        if pieces[cell] > 1:
            at += int(pieces[cell])
        else:
            held += int(count[cell])
    index.count, index.block, index.pieces = count, block, pieces
    return out


def _best(scores: np.ndarray, query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """The k best of one query; ties go to smaller ids. Equal vectors get equal scores."""
    allowed = np.flatnonzero(scores > -np.inf)
    if len(allowed) > k:
        near = scores[allowed]
        least = np.partition(near, len(near) - k)[len(near) - k]
        allowed = allowed[near >= least - 1e-9 * max(1.0, abs(least))]
    exact = (vectors[allowed] * query).sum(1)
    order = np.lexsort((ids[allowed], -exact))[:k]
    return ids[allowed][order], exact[order]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95, key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest vectors found for each query.

    Candidates are all usable vectors but those with the query's own id. Score is the inner product
    in double precision; ties go to the smaller id. Unusable queries give no rows. With
    fewer candidates than ``k`` all of them are returned.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = stored(usable(vectors, key, vector), "index-vectors")
    index = fit(rows, k, recall)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cells = indexed(rows, index)
    asked = usable(queries, key, vector).withColumnsRenamed({"vec_id": "query_id"})
    asked = stored(asked.filter(F.size("vector") == index.first.shape[1] + index.second.shape[1]), "index-queries")
    copies = max(1, -(-asked.count() // PER_COPY))
    shared = spark.sparkContext.broadcast(index)  # at most MOST_CENTROIDS ** 2 cells

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for frame in frames:
            cell = frame["cell"].to_numpy()
            piece = frame["vec_id"].to_numpy() % held.pieces[cell]
            yield pd.DataFrame(
                {
                    "block": held.block[cell] + piece, "vec_id": frame["vec_id"], "query_id": -1,
                    "is_query": False, "cells": [[c] for c in cell], "vector": frame["vector"],
                }
            )

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for frame in frames:
            out = []
            for query_id, query in zip(frame["query_id"], frame["vector"]):
                wanted: dict[int, list[int]] = {}
                for cell in held.route(np.asarray(query)):
                    for piece in range(held.pieces[cell]):
                        wanted.setdefault(int(held.block[cell]) + piece, []).append(cell)
                out += [(b, -1, query_id, True, c, query) for b, c in wanted.items()]
            yield pd.DataFrame(out, columns=["block", "vec_id", "query_id", "is_query", "cells", "vector"])

    row = "block long, vec_id long, query_id long, is_query boolean, cells array<int>, vector array<double>"
    stream = asked.mapInPandas(route, row).withColumn("copy", F.pmod("query_id", F.lit(copies)))
    blocks = cells.mapInPandas(place, row).withColumn(
        "copy", F.explode(F.array(*[F.lit(c).cast("long") for c in range(copies)]))
    )
    together = (
        blocks.unionByName(stream)
        .repartition("block", "copy")
        .sortWithinPartitions("block", "copy", "is_query", "vec_id")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, matrix = None, [], None
        for frame in frames:
            for where, rows_ in frame.groupby(["block", "copy"], sort=False):
                if where != at:
                    at, parts, matrix = where, [], None
                own = rows_[~rows_["is_query"]]
                if len(own):
                    parts.append(own)
                asking = rows_[rows_["is_query"]]
                if not len(asking) or not parts:
                    continue
                if matrix is None:
                    whole = pd.concat(parts)
                    ids, matrix = whole["vec_id"].to_numpy(), _matrix(whole["vector"])
                    cell = np.array([c[0] for c in whole["cells"]])
                    names, local = np.unique(cell, return_inverse=True)
                points = _matrix(asking["vector"])
                scores = points @ matrix.T
                found = []
                for i, (query_id, wanted) in enumerate(zip(asking["query_id"], asking["cells"])):
                    visited = np.isin(names, np.asarray(wanted))[local]
                    line = np.where(visited & (ids != query_id), scores[i], -np.inf)
                    near, exact = _best(line, points[i], matrix, ids, k)
                    found.append(pd.DataFrame({"query_id": query_id, "vec_id": near, "score": exact}))
                yield pd.concat(found)

    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        together.mapInPandas(run, schema)
        .withColumn("rank", F.row_number().over(near))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

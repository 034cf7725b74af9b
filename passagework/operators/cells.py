"""Approximate nearest passages by cosine similarity: an inverted file of cells around centroids.

Centroids and the number of cells that a search looks into are fitted on a bounded sample; every passage is indexed, in
the cell of its nearest centroid. A search scores only the passages of the cells nearest to its query, by their exact
cosine; `dense.dense_search` is the exact way beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import dot
from .lexical import in_blocks, ranked

#: Rows that the centroids are fitted on at most; sample rows that try out how many cells to look into; cells at most.
SAMPLE, TRIALS, MOST_CELLS = 20_000, 200, 4_096
STEPS, SEED = 12, 5


@dataclass(frozen=True)
class Cells:
    """Unit centroids, and how many cells a search looks into."""

    centroids: np.ndarray
    probes: int


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def fit(corpus: DataFrame, cells: int | None = None, recall: float = 0.97, top_k: int = 10) -> Cells:
    """Spherical k-means on a sample by the hash of id; then the fewest cells that find `recall` of the sample's own
    nearest rows for rows of the sample."""
    rows = corpus.where("embedding is not null")
    n = rows.count()
    one_in = max(1, n // (SAMPLE // 2))
    taken = rows.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(one_in)) == 0).select("id", "embedding").limit(SAMPLE).toPandas().sort_values("id")
    if not taken["embedding"].map(any).any():  # nothing has a direction
        return Cells(np.zeros((1, 1)), 1)
    points = _unit(np.array(taken["embedding"].tolist(), dtype=np.float64))
    points = points[np.linalg.norm(points, axis=1) > 0]
    k = max(1, min(len(points) // 8 or 1, MOST_CELLS, cells or round(n**0.5)))
    random = np.random.default_rng(SEED)
    centroids = points[random.choice(len(points), k, replace=False)]
    for _ in range(STEPS):
        nearest = (points @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        alone = np.bincount(nearest, minlength=k) == 0
        sums[alone] = centroids[alone]
        centroids = _unit(sums)
    nearest = (points @ centroids.T).argmax(1)
    asked = points[random.choice(len(points), min(TRIALS, len(points)), replace=False)]
    best = np.argsort(-(asked @ points.T), axis=1, kind="stable")[:, :top_k]
    order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(k)[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, nearest[best], axis=1).ravel())
    return Cells(centroids, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1)


def with_cell(rows: DataFrame, model: Cells, vector: str, out: str, probes: int | None = None) -> DataFrame:
    """Adds the nearest cell of a vector, or the `probes` nearest as an array. Zero vectors and nulls have none."""
    sent = rows.sparkSession.sparkContext.broadcast(model.centroids)

    @F.pandas_udf("array<int>")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        centroids = sent.value
        for vectors in batches:
            found = []
            for at in range(0, len(vectors), 4096):
                part = vectors[at : at + 4096]
                there = [v is not None and len(v) == centroids.shape[1] and np.any(v) for v in part]
                given = np.array([v for v, ok in zip(part, there) if ok], dtype=np.float64).reshape(-1, centroids.shape[1])
                order = iter(np.argsort(-(given @ centroids.T), axis=1, kind="stable")[:, : probes or 1])
                found.extend(next(order) if ok else [] for ok in there)
            yield pd.Series(found)

    cells = near(F.col(vector))
    return rows.withColumn(out, cells if probes else F.get(cells, 0))


def write_cells(corpus: DataFrame, model: Cells, path: str) -> DataFrame:
    """Index every passage (id, ord, source, embedding), a folder a cell; the index as it stands. Large cells are split."""
    rows = with_cell(corpus.select("id", "ord", "source", "embedding"), model, "embedding", "cell").where("cell is not null")
    rows.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    return corpus.sparkSession.read.parquet(path)


def cell_search(index: DataFrame, model: Cells, queries: DataFrame, top_k: int, sources: list[str] | None = None) -> DataFrame:
    """qid, id, ord, source, score, rank, as dense_search has them, from the model.probes nearest cells of every query."""
    pool = index.where(F.col("source").isin(sources)) if sources else index

    def search(block: DataFrame) -> DataFrame:
        asked = with_cell(block.select("qid", "vector"), model, "vector", "_cells", model.probes)
        asked = asked.select("qid", "vector", F.sqrt(dot(F.col("vector"), F.col("vector"))).alias("_qnorm"), F.explode("_cells").alias("cell"))
        norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
        pairs = pool.withColumn("_norm", norm).join(asked, "cell")
        score = F.round(dot(F.col("embedding"), F.col("vector")) / (F.col("_norm") * F.col("_qnorm")), 9)
        return ranked(pairs.select("qid", "id", "ord", "source", score.alias("score")), top_k)

    return in_blocks(queries, search)

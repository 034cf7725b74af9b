"""The approximate search's recall against the exact one."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework import queries
from passagework.operators import cells
from passagework.operators.dense import dense_search


def test_recall(spark, tmp_path):
    d = "/root/testdata/sf0.1"
    pool = queries.corpus(spark, d).where("embedding is not null").select("id", "ord", "source", "embedding")
    model = cells.fit(pool)
    index = cells.write_cells(pool, model, str(tmp_path / "cells"))
    assert index.count() == pool.count()
    asked = pool.where("ord % 50 = 0").select(F.col("ord").alias("qid"), F.col("embedding").alias("vector"))
    exact = dense_search(pool, asked, 10).select("qid", "id")
    found = cells.cell_search(index, model, asked, 10).select("qid", "id")
    n = exact.count()
    assert n >= 100 and found.join(exact, ["qid", "id"]).count() / n >= 0.9
    assert model.probes <= len(model.centroids)


def test_all_cells_are_the_exact_search(spark):
    d = "/root/testdata/sf0.001"
    pool = queries.corpus(spark, d).where("embedding is not null").select("id", "ord", "source", "embedding")
    model = cells.fit(pool, 5)
    every = cells.Cells(model.centroids, len(model.centroids))
    indexed = cells.with_cell(pool, model, "embedding", "cell")
    asked = queries.pointed(spark, d)
    rows = lambda df: sorted(tuple(r) for r in df.select(queries.HITS).collect())
    for sources in (None, [], ["src1"]):
        assert rows(cells.cell_search(indexed, every, asked, 7, sources)) == rows(dense_search(pool, asked, 7, sources))


def test_odd_vectors(spark):
    rows = [("a", 1, "s", [0.0, 0.0]), ("b", 2, "s", None), ("c", 3, "s", [1.0, 0.0]), ("d", 4, "s", [0.0, 2.0])]
    pool = spark.createDataFrame(rows, "id string, ord long, source string, embedding array<float>")
    model = cells.fit(pool)
    indexed = cells.with_cell(pool, model, "embedding", "cell").where("cell is not null")
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, None)], "qid int, vector array<float>")
    assert [(r.qid, r.id) for r in cells.cell_search(indexed, cells.Cells(model.centroids, 9), asked, 1).collect()] == [(1, "c")]
    assert cells.fit(pool.limit(0)).probes == 1

"""Offsets of documents of any length."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.operators import chunk


def test_offsets_pass_the_largest_int(spark):
    blocks = spark.range(2200).select(F.lit("s").alias("source"), F.col("id").cast("int").alias("block_no"), F.repeat(F.lit("x"), F.lit(1_000_000)).alias("text"))
    last = chunk.with_offsets(blocks).agg(F.max("start").alias("start"), F.max("stop").alias("stop")).first()
    assert (last.start, last.stop) == (2199 * 1_000_002, 2199 * 1_000_002 + 1_000_000)


def test_runs_add_up(spark, monkeypatch):
    monkeypatch.setattr(chunk, "BUCKET", 3)
    rows = [(s, i, "y" * (i % 5)) for s in ("a", "b", None) for i in range(-4, 20, 2)]
    found = chunk.with_offsets(spark.createDataFrame(rows, "source string, block_no int, text string")).collect()
    want = {(s, i): sum(len(t) + 2 for o, j, t in rows if o == s and j < i) for s, i, _ in rows}
    assert {(r.source, r.block_no): r.start for r in found} == want and all(r.stop == r.start + len(r.text) for r in found)

"""Searches for more queries than a block takes, and by stored postings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from passagework import queries
from passagework.operators import lexical
from passagework.operators.dense import dense_search
from passagework.sources.postings import PostingsIndex, kept_index

SF = "/root/testdata/sf0.001"


def every(spark):
    vectors = queries.vectors(spark, SF).withColumnRenamed("embedding", "vector")
    return queries.items(spark, SF).where("qid < 20").join(vectors, F.col("qid") == F.col("vec_id"), "left").drop("vec_id")


def rows(df):
    return sorted(tuple(r) for r in df.select("qid", "ord", "score", "rank").collect())


def test_blocks_find_what_one_go_finds(spark, monkeypatch):
    corpus, asked = queries.corpus(spark, SF), every(spark)
    search = {"bm25": lambda: lexical.bm25_search(corpus, asked, 5), "dense": lambda: dense_search(corpus.where("embedding is not null"), asked.where("vector is not null"), 5)}
    whole = {name: rows(f()) for name, f in search.items()}
    monkeypatch.setattr(lexical, "MAX_QUERIES", 8)
    assert {name: rows(f()) for name, f in search.items()} == whole and all(len({r[0] for r in x}) == 20 for x in whole.values())


def test_the_lexical_query_set_needs_no_vector(spark):
    whole = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").where("item_id % 50 = 0").count()
    assert queries.asked(spark, "/root/testdata/sf0.1").count() == whole > 1


def test_stored_postings_find_what_texts_find(spark, tmp_path, monkeypatch):
    corpus, asked = queries.passages(spark, SF), every(spark)
    index = PostingsIndex.write(corpus, str(tmp_path / "index"))
    found = lexical.bm25_search(corpus, asked, 7, ["src1", "src2"], index)
    assert rows(found) == rows(lexical.bm25_search(corpus, asked, 7, ["src1", "src2"]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all(lower(text" not in plan
    monkeypatch.setattr("passagework.sources.postings.MOST_LITERALS", 0)
    assert rows(lexical.bm25_search(corpus, asked, 7, ["src1", "src2"], index)) == rows(found)


def test_other_files_are_another_index(spark, tmp_path):
    at = str(tmp_path / "documents.parquet")
    write = lambda text: spark.createDataFrame([("1", 1, "s", text)], "id string, ord long, source string, text string").write.mode("overwrite").parquet(at)
    for text in ("one two two", "three"):
        write(text)
        corpus = spark.read.parquet(at)
        assert {(r.term, r.tf) for r in kept_index(spark, at, corpus).postings.collect()} == {(w, text.split().count(w)) for w in text.split()}


def test_equal_places_go_by_id(spark):
    """Passages that share score and ord rank by id, run after run."""
    corpus = spark.createDataFrame([(f"f{i}::0", 7, "s", "same words") for i in range(40)], "id string, ord long, source string, text string").repartition(7)
    asked = spark.createDataFrame([(1, "words"), (2, "nothing")], "qid int, query string")
    want = sorted(f"f{i}::0" for i in range(40))[:5]
    for _ in range(2):
        found = lexical.bm25_search(corpus, asked, 5).orderBy("qid", "rank").collect()
        assert [r.id for r in found] == want + want


@pytest.mark.parametrize("span, first, k", [(4, 1, 3), (16, 2, 5), (2048, 8, 10)])
def test_pruned_searches_find_what_all_postings_give(spark, tmp_path, monkeypatch, span, first, k):
    """Ranges of few places and of many, ties and rare words included; null texts and sources have their place."""
    r = random.Random(span)
    words = ["common"] * 6 + ["often"] * 3 + ["now"] + [f"rare{i}" for i in range(30)]
    rows = [(str(i), i * 3 - 50, r.choice(["a", "b", None]), " ".join(r.choice(words) for _ in range(r.randint(0, 12))) if i % 17 else None) for i in range(150)]
    corpus = spark.createDataFrame(rows, "id string, ord long, source string, text string")
    queries = spark.createDataFrame([(1, "common often"), (2, "rare3 now now"), (3, "nothing"), (4, "often rare5 rare6 common"), (5, ""), (6, "rare9")], "qid int, query string")
    monkeypatch.setattr("passagework.sources.postings.RANGE", span)
    monkeypatch.setattr("passagework.operators.lexical.FIRST", first)
    index = PostingsIndex.write(corpus, str(tmp_path / f"i{span}"))
    for sources in (None, ["a"], []):
        want = {tuple(x) for x in lexical.bm25_search(corpus, queries, k, sources, PostingsIndex(index.postings, index.lengths)).collect()}
        assert {tuple(x) for x in lexical.bm25_search(corpus, queries, k, sources, index, prune=True).collect()} == want
    assert {x.term: x.df for x in index.impacts.groupBy("term").agg({"n": "sum"}).withColumnRenamed("sum(n)", "df").collect()} == {x.term: x.df for x in lexical.term_df(corpus).collect()}


def test_searches_of_texts_shuffle_no_pairs(spark):
    """Pairs of a query and a passage aren't grouped, which shuffled them; passages are scored in the scan."""
    corpus, asked = queries.corpus(spark, SF), every(spark)
    plan = lexical.bm25_search(corpus, asked, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate [qid" not in plan


def test_hybrid_of_all_items_reads_texts(spark, monkeypatch):
    """No postings are built for a search that would meet nearly all of them."""
    monkeypatch.setattr(queries, "kept_index", lambda *_: pytest.fail("postings"))
    assert queries.hybrid_all_items(spark, SF).count() > 0


@pytest.mark.parametrize("cells", [1, 40, 250_000])
def test_scans_give_what_postings_give(spark, tmp_path, monkeypatch, cells):
    """A few passages at a time or many; ties, empty texts, null sources, a filter."""
    r = random.Random(cells)
    rows_ = [(str(i), i, r.choice(["a", "b", None]), " ".join(r.choice("x y z w v".split()) for _ in range(r.randint(0, 6)))) for i in range(80)]
    corpus = spark.createDataFrame(rows_, "id string, ord long, source string, text string")
    asked = spark.createDataFrame([(1, "x y"), (2, "z z"), (3, "nothing"), (4, "v")], "qid int, query string")
    monkeypatch.setattr("passagework.operators.in_rows.CELLS", cells)
    index = PostingsIndex.write(corpus, str(tmp_path / "i"))
    for sources in (None, ["a"]):
        assert rows(lexical.bm25_search(corpus, asked, 4, sources)) == rows(lexical.bm25_search(corpus, asked, 4, sources, index, prune=False))


def test_pruned_searches_shuffle_no_pairs(spark, tmp_path):
    """What ranges leave is scored in the scan, by the ranges' thresholds."""
    corpus, asked = queries.passages(spark, SF), every(spark).where("qid < 3")
    index = PostingsIndex.write(corpus, str(tmp_path / "i"))
    plan = lexical.bm25_search(corpus, asked, 5, index=index, prune=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate [qid" not in plan

"""Reciprocal rank fusion of any number of rankings, and the hybrid of dense and lexical search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import rrf_term
from ..schema import RRF_K
from ..sources.postings import PostingsIndex
from .dense import dense_search
from .lexical import bm25_search


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """From rankings (qid, id, rank): qid, id, score, and rank_0, rank_1, ...: the best rank in each."""
    named = [r.select("qid", "id", "rank", F.lit(i).alias("_ranking")) for i, r in enumerate(rankings)]
    every = reduce(DataFrame.unionByName, named)
    ranks = [F.min(F.when(F.col("_ranking") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(rankings))]
    return every.groupBy("qid", "id").agg(F.round(F.sum(rrf_term(F.col("rank"), k)), 12).alias("score"), *ranks)


def fused_top(rankings: list[DataFrame], top_n: int, k: int = RRF_K) -> DataFrame:
    """The best of the fusion, with rank; ties in the order in which the rankings list them first."""
    fused = reciprocal_rank_fusion(rankings, k)
    ties = [F.asc_nulls_last(f"rank_{i}") for i in range(len(rankings))]
    order = Window.partitionBy("qid").orderBy(F.desc("score"), *ties)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def candidate_depth(top_n: int) -> int:
    """How deep either ranking goes for a hybrid of top_n."""
    return max(4 * top_n, 20)


def hybrid_search(corpus: DataFrame, queries: DataFrame, top_n: int, sources: list[str] | None = None, index: PostingsIndex | None = None) -> DataFrame:
    """qid, id, score, rank from corpus (id, ord, source, text, embedding) and queries (qid, query, vector)."""
    depth = candidate_depth(top_n)
    rankings = [dense_search(corpus, queries, depth, sources), bm25_search(corpus, queries, depth, sources, index)]
    return fused_top(rankings, top_n).select("qid", "id", "score", "rank")

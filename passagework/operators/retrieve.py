"""The retrieval dispatcher: mode, depth, filter and rerank for a block of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..schema import RERANK_K
from ..sources.postings import PostingsIndex
from .dense import dense_search
from .fuse import hybrid_search
from .lexical import bm25_search
from .rerank import rerank

MODES = ("dense", "bm25", "hybrid")
LABELS = {"dense": "Similarity", "bm25": "BM25", "hybrid": "RRF", "rerank": "Rerank"}


@dataclass(frozen=True)
class Options:
    top_n: int = 3
    mode: str = "hybrid"
    rerank: bool = False
    rerank_k: int = RERANK_K
    sources: list[str] | None = None

    def __post_init__(self) -> None:
        if self.top_n < 1 or self.rerank_k < 1:
            raise ValueError("top_n and rerank_k are at least 1")

    @property
    def depth(self) -> int:
        """How many passages the first stage fetches."""
        return max(self.rerank_k, self.top_n) if self.rerank else self.top_n


def first_stage(corpus: DataFrame, queries: DataFrame, options: Options, index: PostingsIndex | None = None) -> DataFrame:
    """qid, id, score, rank. Any mode but dense and bm25 is the hybrid."""
    if options.mode == "dense":
        found = dense_search(corpus, queries, options.depth, options.sources)
    else:
        found = (bm25_search if options.mode == "bm25" else hybrid_search)(corpus, queries, options.depth, options.sources, index)
    return found.select("qid", "id", "score", "rank")


def retrieve(corpus: DataFrame, queries: DataFrame, options: Options = Options(), scorer: Column | None = None, index: PostingsIndex | None = None) -> DataFrame:
    """qid, rank, id, text, score, source, pages, score_kind from queries (qid, query, vector); blank queries find nothing.

    The ranked ids are joined to the corpus for their text; the planner broadcasts them where they are few. The rank
    filter stands below the scorer, so that a model sees `depth` passages a query at most. `scorer` is a column over
    query and text. With an index the lexical search reads stored postings.
    """
    asked = queries.where(~is_blank(F.col("query")))
    hits = first_stage(corpus, asked, options, index)
    rows = corpus.select("id", "text", "source", "pages").join(hits, "id").join(asked.select("qid", "query"), "qid")
    if options.rerank:
        rows = rerank(rows, options.top_n, scorer)
    else:
        rows = rows.where(F.col("rank") <= options.top_n).withColumn("score_kind", F.lit(options.mode if options.mode in MODES else "hybrid"))
    return rows.select("qid", "rank", "id", "text", "score", "source", "pages", "score_kind")

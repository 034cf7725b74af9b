"""Exact nearest passages by cosine similarity, for many query vectors at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import dot
from .lexical import in_blocks, ranked


def dense_search(corpus: DataFrame, queries: DataFrame, top_k: int, sources: list[str] | None = None) -> DataFrame:
    """qid, id, ord, source, score, rank from corpus (id, ord, source, embedding) and queries (qid, vector).

    Queries, a block at a time, are broadcast to the corpus: every partition keeps its own best top_k a query
    before the shuffle (a partial window limit). The filter comes before scoring; an empty list is no filter. Zero
    vectors have no direction and are left out. Norms are computed once a row.
    """
    pool = corpus.where(F.col("source").isin(sources)) if sources else corpus
    pool = pool.select("id", "ord", "source", "embedding", F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("_norm"))

    def search(block: DataFrame) -> DataFrame:
        asked = block.select("qid", "vector", F.sqrt(dot(F.col("vector"), F.col("vector"))).alias("_qnorm"))
        pairs = pool.where("_norm > 0").crossJoin(F.broadcast(asked.where("_qnorm > 0")))
        score = F.round(dot(F.col("embedding"), F.col("vector")) / (F.col("_norm") * F.col("_qnorm")), 9)
        return ranked(pairs.select("qid", "id", "ord", "source", score.alias("score")), top_k)

    return in_blocks(queries, search)

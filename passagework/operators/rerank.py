"""A second opinion on the first passages: a pair scorer over (query, text)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..models import PairScorer

#: Pairs that a scorer gets at a time.
BATCH = 8

_loaded: dict[str, PairScorer | None] = {}


def load_once(name: str, load: Callable[[], PairScorer]) -> PairScorer | None:
    """A worker's scorer. Success and failure are both remembered: a model that is missing is not sought again."""
    if name not in _loaded:
        try:
            _loaded[name] = load()
        except Exception:
            _loaded[name] = None
    return _loaded[name]


def pair_scores(name: str, load: Callable[[], PairScorer], query: Column, text: Column) -> Column:
    """The scorer's score of each pair, null where it can't be loaded. Loaded once a worker, asked BATCH at a time."""

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = load_once(name, load)
        for queries, texts in batches:
            found: list[float | None] = []
            for at in range(0, len(texts), BATCH):
                some = list(zip(queries[at : at + BATCH], texts[at : at + BATCH]))
                found.extend(scorer.scores(some) if scorer else [None] * len(some))
            yield pd.Series(found, dtype="float64")

    return F.pandas_udf(score, DoubleType())(query, text)


def rerank(candidates: DataFrame, top_n: int, scorer: Column | None) -> DataFrame:
    """From candidates (qid, id, query, text, score, rank): the best top_n by the scorer, ties in first-stage order.

    Without a scorer, or where it has no score for a query, the first stage's order and scores stay. score_kind says
    which of the two a score is.
    """
    rows = candidates.withColumn("_second", scorer if scorer is not None else F.lit(None).cast("double"))
    whole = F.min(F.col("_second").isNotNull()).over(Window.partitionBy("qid"))
    rows = rows.withColumn("_scored", whole)
    order = Window.partitionBy("qid").orderBy(F.desc(F.when(F.col("_scored"), F.col("_second"))), F.asc("rank"))
    final = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top_n)
    score = F.when(F.col("_scored"), F.col("_second")).otherwise(F.col("score"))
    kind = F.when(F.col("_scored"), "rerank").otherwise("first_stage")
    return final.withColumn("score", score).withColumn("rank", F.col("_rank")).withColumn("score_kind", kind).drop("_second", "_scored", "_rank")

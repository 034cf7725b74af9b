"""BM25 in the scan: every passage is scored for all queries where its text is read, so no (query, passage) pair is shuffled.

A search of many words meets most postings, and each of them once a query: pairs outgrow the texts many times. Here a task
counts the wanted words of some passages, multiplies them by the queries' weights, and hands on what reaches the best top_k
scores that it has seen for a query, or a threshold that is known from elsewhere. The block of queries (`in_blocks`) is
broadcast; what a task holds is bounded by CELLS scores, PARTS products and the top_k best scores of each query.

Nulls: a null text has no words. A query's null sources are no filter; empty ones let nothing pass. Ties aren't cut here: all
that is within ROUNDING of the last of the best goes on. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokens

#: Scores, and products of a word's impact and its weight in a query, that are computed at a time.
CELLS, PARTS = 250_000, 2_000_000
#: What a score may lack by the rounding of scores.
ROUNDING = 1e-8


class Block:
    """A block of queries: its words, and where each word's queries and weights begin."""

    def __init__(self, rows: list[tuple[str, int, float]], queries: int, avgdl: float, sources: list[list[str] | None], least: list[float]) -> None:
        rows.sort()
        self.words = sorted({r[0] for r in rows})
        place = {w: i for i, w in enumerate(self.words)}
        self.starts = np.append(0, np.cumsum(np.bincount([place[r[0]] for r in rows], minlength=len(self.words)))).astype(np.int64)
        self.query, self.weight = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
        self.queries, self.avgdl, self.least = queries, avgdl, np.array(least)
        kinds: dict[tuple[str, ...] | None, list[int]] = {}
        for i, names in enumerate(sources):
            kinds.setdefault(None if names is None else tuple(sorted(x for x in names if x is not None)), []).append(i)
        self.filters = [(list(names), np.array(those)) for names, those in kinds.items() if names is not None]
        self.step = max(1, min(CELLS // max(1, queries), PARTS // max(1, len(rows))))

    def scores(self, words: pa.Array, rows: np.ndarray, dl: np.ndarray, k1: float, b: float) -> np.ndarray:
        """Scores by row and query, from words and the rows that they stand in."""
        found = pc.fill_null(pc.index_in(words, pa.array(self.words, words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        seen = found >= 0
        cell, tf = np.unique(rows[seen] * len(self.words) + found[seen], return_counts=True)
        row, word = cell // max(1, len(self.words)), cell % max(1, len(self.words))
        impact = tf / (tf + k1 * (1 - b + b * dl[row] / self.avgdl))
        many = self.starts[word + 1] - self.starts[word]
        each = np.repeat(np.arange(len(word)), many)
        at = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + self.starts[word][each]
        sums = np.bincount(row[each] * self.queries + self.query[at], self.weight[at] * impact[each], len(dl) * self.queries)
        return sums.reshape(len(dl), self.queries).astype(float)  # sums of no products are integers


def best_in_rows(corpus: DataFrame, weights: DataFrame, top_k: int, k1: float, b: float, limits: DataFrame | None = None) -> DataFrame:
    """qid, id, ord, source, score of passages (id, ord, source, text) that may be among a query's top_k best.

    From weights (qid, term, weight, avgdl) of a block of queries; `limits` (qid, sources, least) gives a query's sources and a
    score that the best are known to reach, each may be null."""
    corpus = corpus.select("id", "ord", "source", "text")
    kind = to_arrow_type(weights.schema["qid"].dataType)
    out = f"qid {weights.schema['qid'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in corpus.dtypes if n != "text") + ", score double"
    held = weights.where("weight is not null").select("qid", "term", "weight", "avgdl").collect()
    qids = list({r.qid: None for r in held})
    number = {q: i for i, q in enumerate(qids)}
    known = {} if limits is None else {r.qid: r for r in limits.select("qid", "sources", "least").collect()}
    of = lambda q, name, other: other if q not in known or known[q][name] is None else known[q][name]
    block = Block([(r.term, number[r.qid], r.weight) for r in held], len(qids), held[0].avgdl if held else 1.0, [of(q, "sources", None) for q in qids], [of(q, "least", 0.0) for q in qids])
    sent = corpus.sparkSession.sparkContext.broadcast((block, qids))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, qids = sent.value
        best = np.zeros((top_k, block.queries))
        for whole in batches:
            for start in range(0, whole.num_rows, block.step):
                batch = whole.slice(start, block.step)
                held, sources = batch.column(3), batch.column(2)
                dl = pc.list_value_length(held).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                rows = np.repeat(np.arange(batch.num_rows), dl)
                scores = block.scores(held.flatten(), rows, dl, k1, b)
                for names, those in block.filters:
                    passing = pc.fill_null(pc.is_in(sources, pa.array(names, sources.type)), False).to_numpy(zero_copy_only=False)
                    scores[np.ix_(~passing, those)] = 0.0
                best = np.partition(np.vstack([best, scores]), -top_k, axis=0)[-top_k:]
                least = np.maximum(best[0], block.least) - ROUNDING
                row, query = np.nonzero((scores > 0) & (scores >= least))
                take = pa.array(row)
                asked = pa.array(qids, kind).take(pa.array(query))
                yield pa.RecordBatch.from_arrays([asked, *(batch.column(i).take(take) for i in range(3)), pa.array(scores[row, query])], ["qid", "id", "ord", "source", "score"])

    if not held:
        return corpus.sparkSession.createDataFrame([], out)
    found = corpus.select("id", "ord", "source", tokens(F.col("text")).alias("_tokens")).mapInArrow(search, out)
    return found.withColumn("score", F.round("score", 9))

"""BM25 over a corpus: statistics, postings, and top passages for many queries at once.

Postings are counted once and stored (`sources.postings`); a search of few words by them reads no text. Without them, and
where queries meet too many postings, passages are scored where their texts are read (`in_rows`).

Scores are the Lucene form: idf = ln(1 + (N - df + 0.5) / (df + 0.5)), term weight tf / (tf + k1 * (1 - b + b * dl /
avgdl)), summed over a query's words with repeats. N, df and avgdl are the whole corpus's, whatever the source filter.
Passages without a query word score 0 and still rank, in store order.

With stored impacts a search prunes, without changing its result. The FIRST ranges of passages whose words' bounds add up to
most are scored by their postings; the k-th best score there is the query's threshold. Ranges whose bounds stay below it for
all queries are left out; the passages of the others are scored in the scan, and only what reaches a threshold goes on.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..sources.work import work_table
from .in_rows import ROUNDING, best_in_rows

if TYPE_CHECKING:
    from ..sources.postings import PostingsIndex

K1, B = 1.5, 0.75
#: Queries that go in one block, about.
MAX_QUERIES = 10_000
#: Ranges that are scored for a query's threshold.
FIRST = 8
#: From so many (query, posting) rows on a search scans the texts; with fewer the postings cost less.
PRUNE_FROM = 20_000_000
#: Bytes of stored postings below which that isn't counted.
PRUNE_BYTES = 64 << 20


def postings_of(corpus: DataFrame) -> DataFrame:
    """term, id, ord, source, dl, tf of every passage's words, counted within the row: no shuffle."""
    words = corpus.select("id", "ord", "source", tokens(F.col("text")).alias("_tokens"))
    counted = words.select("id", "ord", "source", F.size("_tokens").alias("dl"), F.array_sort("_tokens").alias("_sorted"))
    # a word's first place in the sorted list, and the next word's: what lies between is how often it occurs
    firsts = F.filter(F.transform("_sorted", lambda t, i: F.struct(t.alias("term"), i.alias("at"), (i == 0) | (t != F.get("_sorted", i - 1)))), lambda x: x["col3"])
    counted = counted.withColumn("_firsts", firsts)
    after = lambda i: F.coalesce(F.get("_firsts", i + 1)["at"], F.col("dl"))
    each = F.explode(F.transform("_firsts", lambda x, i: F.struct(x["term"].alias("term"), (after(i) - x["at"]).cast("long").alias("tf")))).alias("_")
    return counted.select("id", "ord", "source", "dl", each).select("_.term", "id", "ord", "source", "dl", "_.tf")


def term_df(corpus: DataFrame) -> DataFrame:
    """term, df: in how many passages a term occurs. Repeats go inside the row, so only one count a term is shuffled."""
    return corpus.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return corpus.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col("text")))).alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """From queries (qid, query): qid, term, qtf."""
    return queries.select("qid", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def in_blocks(queries: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The search of all queries: in one go, or in blocks by the hash of qid, of half of MAX_QUERIES on average."""
    n = queries.count()
    if n <= MAX_QUERIES:
        return search(queries)
    blocks = math.ceil(2 * n / MAX_QUERIES)
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    return reduce(DataFrame.unionByName, (search(queries.where(block == i)) for i in range(blocks)))


def matches(index: PostingsIndex, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """qid, id, ord, source, score of all passages with a query word, by the stored postings.

    The queries' words meet the postings in a join below any shuffle, so that only postings of those words are shuffled; but
    each as often as queries have its word, so this is for few of them.
    """
    wanted = query_terms(queries)
    return score_postings(index.of(wanted.select("term").distinct()), index.stats(), wanted, k1, b)


def weights_of(wanted: DataFrame, dfs: DataFrame, stats: DataFrame) -> DataFrame:
    """qid, term, weight, avgdl of the queries' words, from their document frequencies (term, df) and stats (n, avgdl)."""
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return dfs.crossJoin(F.broadcast(stats)).join(wanted, "term").select("term", "qid", (F.col("qtf") * idf).alias("weight"), "avgdl")


def corpus_weights(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """The same by a scan of the texts, in which only counts of the queries' words are shuffled."""
    wanted = query_terms(queries)
    words = corpus.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    dfs = words.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return weights_of(wanted, dfs, corpus_stats(corpus))


def index_weights(index: PostingsIndex, queries: DataFrame) -> DataFrame:
    """The same by what is stored with the postings."""
    wanted = query_terms(queries)
    vocabulary = wanted.select("term").distinct()
    dfs = index.narrowed(index.impacts, vocabulary).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    return weights_of(wanted, dfs, index.stats())


def scanned_matches(corpus: DataFrame, queries: DataFrame, top_k: int, weights: DataFrame) -> DataFrame:
    """qid, id, ord, source, score of the passages that may be among the top_k of a query, by a scan of the texts. Queries
    (qid) may have `sources` of their own."""
    limits = queries.select("qid", "sources", F.lit(None).cast("double").alias("least")) if "sources" in queries.columns else None
    return best_in_rows(corpus, weights, top_k, K1, B, limits)


def score_postings(postings: DataFrame, stats: DataFrame, wanted: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """qid, id, ord, source, score from postings (term, id, ord, source, dl, tf) of the wanted terms."""
    # counted from tf, so that both uses of the postings ask for the same columns and share one scan and one shuffle
    dfs = postings.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = dfs.crossJoin(F.broadcast(stats)).join(wanted, "term").select("term", "qid", "qtf", idf.alias("idf"), "avgdl")
    length = 1 - b + b * F.col("dl") / F.col("avgdl")
    part = F.col("qtf") * F.col("idf") * F.col("tf") / (F.col("tf") + k1 * length)
    scored = postings.join(weights, "term").groupBy("qid", "id", "ord", "source").agg(F.sum(part).alias("score"))
    return scored.withColumn("score", F.round("score", 9))


def ranked(scored: DataFrame, top_k: int, *ties: Column) -> DataFrame:
    """Adds rank, from 1, and keeps top_k a query; ties by the given columns, else in store order."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), *(ties or (F.asc("ord"), F.asc("id"))))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def allowed(df: DataFrame, sources: list[str] | None) -> DataFrame:
    """Rows of the sources; None: all, an empty list: none."""
    if sources is None:
        return df
    return df.where(F.col("source").isin(sources)) if sources else df.where(F.lit(False))


def bm25_search(
    corpus: DataFrame, queries: DataFrame, top_k: int, sources: list[str] | None = None, index: PostingsIndex | None = None, prune: bool | None = None
) -> DataFrame:
    """qid, id, ord, source, score, rank: the best passages of every query, those without a match filling up.

    A query with fewer matches than top_k is filled from the first passages in store order. It has fewer than top_k
    matches, so the first 2 * top_k passages are enough to fill it: no query meets all passages. `prune`: whether ranges that
    can't be among the best are left out; by default the number of postings decides between them and a scan of the texts.
    """
    return in_blocks(queries, lambda block: _bm25_block(corpus, block, top_k, sources, index, prune))


def meets_many(index: PostingsIndex, queries: DataFrame) -> bool:
    """By the planner's size of the stored postings, which costs no job, and then by how many of them the queries meet."""
    if int(str(index.postings._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < PRUNE_BYTES:
        return False
    wanted = query_terms(queries)
    vocabulary = wanted.select("term").distinct()
    met = index.narrowed(index.impacts, vocabulary).join(wanted, "term").agg(F.sum("n")).first()[0]
    return (met or 0) >= PRUNE_FROM


def pruned_matches(corpus: DataFrame, index: PostingsIndex, queries: DataFrame, top_k: int, sources: list[str] | None) -> DataFrame:
    """qid, id, ord, source, score of the passages with a query word that may be among the top_k of a query."""
    from ..sources.postings import block_of

    wanted = query_terms(queries)
    vocabulary = wanted.select("term").distinct()
    impacts = index.narrowed(index.impacts, vocabulary)
    weights = index_weights(index, queries)
    weights = work_table(weights, "weights")

    bound = F.col("weight") * F.col("impact") * F.greatest(F.lit(1.0), F.col("avgdl") / F.col("at_avgdl"))
    bounds = allowed(impacts, sources).join(weights, "term").select("qid", "term", F.coalesce("source", F.lit("")).alias("_source"), F.col("block").alias("_block"), bound.alias("most"))
    by_range = bounds.groupBy("qid", "_source", "_block").agg(F.sum("most").alias("most"))
    order = Window.partitionBy("qid").orderBy(F.desc("most"), "_source", "_block")
    ranges = work_table(by_range.withColumn("place", F.row_number().over(order)), "ranges")

    length = 1 - B + B * F.col("dl") / F.col("avgdl")
    part = F.sum(F.col("weight") * F.col("tf") / (F.col("tf") + K1 * length))
    postings = allowed(index.of(vocabulary), sources).withColumn("_source", F.coalesce("source", F.lit(""))).withColumn("_block", block_of(F.col("ord")))
    key, passage = ["term", "_source", "_block"], ["qid", "id", "ord", "source"]

    needed = ranges.where(F.col("place") <= FIRST).select("qid", "_source", "_block").join(weights, "qid")
    first = postings.join(needed, key).groupBy(*passage).agg(part.alias("score"))
    least = ranked(first.withColumn("score", F.round("score", 9)), top_k).where(F.col("rank") == top_k).select("qid", (F.col("score") - ROUNDING).alias("_least"))
    least = work_table(least, "thresholds")

    # no threshold: all of a query's ranges are looked at
    live = ranges.join(least, "qid", "left").where(F.col("_least").isNull() | (F.col("most") >= F.col("_least"))).select("_source", "_block").distinct()
    near = allowed(corpus, sources).withColumn("_source", F.coalesce("source", F.lit(""))).withColumn("_block", block_of(F.col("ord"))).join(live, ["_source", "_block"], "left_semi")
    return best_in_rows(near, weights, top_k, K1, B, least.select("qid", F.lit(None).cast("array<string>").alias("sources"), F.col("_least").alias("least")))


def _bm25_block(corpus: DataFrame, queries: DataFrame, top_k: int, sources: list[str] | None, index: PostingsIndex | None, prune: bool | None) -> DataFrame:
    able = index is not None and index.impacts is not None and sources != []
    if able and prune:
        found = pruned_matches(corpus, index, queries, top_k, sources)
    elif index is None or (able and prune is None and meets_many(index, queries)):
        weights = corpus_weights(corpus, queries) if index is None else index_weights(index, queries)
        found = scanned_matches(allowed(corpus, sources), queries, top_k, weights)
    else:
        found = allowed(matches(index, queries), sources)
    top = ranked(found, top_k)
    pool = allowed(corpus, sources).select("id", "ord", "source").orderBy("ord", "id").limit(2 * top_k)
    full = top.where(F.col("rank") == top_k).select("qid")
    short = queries.select("qid").join(full, "qid", "left_anti")
    zeros = short.crossJoin(pool).join(top.select("qid", "id"), ["qid", "id"], "left_anti").withColumn("score", F.lit(0.0))
    columns = ["qid", "id", "ord", "source", "score"]
    return ranked(top.select(columns).unionByName(zeros.select(columns)), top_k)

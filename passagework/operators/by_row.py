"""Options that differ by question: every row has its own mode, depth, rerank flag and sources, and one plan serves them all.

Settings are read from lines by column functions; a line that isn't valid changes nothing, and of valid lines for one
setting the last counts. Names of sources are valid if all of them are known, which a join decides.

Nulls: null sources are no filter; an empty array is none for dense search, and lets nothing pass in lexical search. A null
line, or one without a slash, is no command. Blank questions find nothing. Questions without a vector have no dense ranking.
Ties are broken as in the searches for one set of options. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import dot, rrf_term
from ..functions.text import is_blank
from ..plans.settings import FALSY, MODES, TRUTHY, Settings
from ..sources.postings import PostingsIndex
from .lexical import corpus_weights, in_blocks, index_weights, matches, meets_many, ranked, scanned_matches

DEFAULT = Settings()


def options_of(lines: DataFrame, known: DataFrame) -> DataFrame:
    """From lines (qid, lines array<string>) and known sources (source): qid, top_n, temperature, mode, rerank, rerank_k,
    sources, of every row."""
    each = lines.select("qid", F.posexplode("lines").alias("at", "line")).withColumn("line", F.trim("line")).where(F.col("line").startswith("/"))
    name = F.lower(F.trim(F.substring_index(F.substring("line", F.lit(2), F.length("line")), "=", 1)))
    value = F.when(F.instr("line", "=") > 0, F.trim(F.substring("line", F.instr("line", "=") + 1, F.length("line")))).otherwise("")
    each = each.select("qid", "at", name.alias("name"), value.alias("value"))
    number = F.when(F.rlike("value", F.lit(r"^[+-]?[0-9]{1,9}$")), F.try_to_number("value", F.lit("S999999999")).cast("int"))
    real = F.when(F.rlike("value", F.lit(r"^[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]{1,3})?$")), F.col("value").cast("double"))
    lower = F.lower("value")
    names = F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x)), lambda x: x != "")
    wanted = each.where("name = 'sources'").withColumn("names", names).withColumn("every", lower == "all")
    strange = wanted.where("not every").select("qid", "at", F.explode("names").alias("source")).join(known.select("source").distinct(), "source", "left_anti")
    chosen = wanted.where("every or size(names) > 0").join(strange.select("qid", "at").distinct(), ["qid", "at"], "left_anti")
    chosen = chosen.groupBy("qid").agg(F.max_by(F.struct(F.when(~F.col("every"), F.col("names")).alias("names")), "at").alias("_sources"))

    def last(setting: str, valid: Column) -> Column:
        return F.max_by(valid, F.when((F.col("name") == setting) & valid.isNotNull(), F.col("at"))).alias(f"_{setting}")

    positive = F.when(number >= 1, number)
    found = each.groupBy("qid").agg(
        last("top_n", positive), last("rerank_k", positive), last("temperature", real), last("mode", F.when(lower.isin(*MODES), lower)),
        last("rerank", F.when(lower.isin(*TRUTHY), F.lit(True)).when(lower.isin(*FALSY), F.lit(False))),
    )
    rows = lines.select("qid").join(found, "qid", "left").join(chosen, "qid", "left")
    default = lambda setting: F.coalesce(f"_{setting}", F.lit(getattr(DEFAULT, setting))).alias(setting)
    return rows.select("qid", *(default(s) for s in ("top_n", "temperature", "mode", "rerank", "rerank_k")), F.col("_sources.names").alias("sources"))


def first_stages(corpus: DataFrame, questions: DataFrame, options: DataFrame, index: PostingsIndex | None = None) -> DataFrame:
    """qid, id, ord, source, score, rank of every question's first stage, by its own options.

    From corpus (id, ord, source, text, embedding), questions (qid, query, vector) and options (qid, top_n, mode, rerank,
    rerank_k, sources). Ranks go to the depth that the row asks for; the deepest row bounds what a window keeps."""
    depth = F.when(F.col("rerank"), F.greatest("rerank_k", "top_n")).otherwise(F.col("top_n"))
    asked = questions.where(~is_blank(F.col("query"))).join(options.select("qid", "mode", "sources", depth.alias("depth")), "qid")
    hybrid = ~F.col("mode").isin("dense", "bm25")
    asked = asked.withColumn("reach", F.when(hybrid, F.greatest(4 * F.col("depth"), F.lit(20))).otherwise(F.col("depth")))
    return in_blocks(asked, lambda block: _first_stages(corpus, block, index))


def _first_stages(corpus: DataFrame, asked: DataFrame, index: PostingsIndex | None) -> DataFrame:
    most = asked.agg(F.max("reach")).first()[0] or 1
    columns = ["qid", "id", "ord", "source", "score"]
    rows = asked.select("qid", "sources", "reach")

    def passing(found: DataFrame, empty_passes: bool) -> DataFrame:
        free = F.col("sources").isNull() | ((F.size("sources") == 0) if empty_passes else F.lit(False))
        return found.where(free | F.array_contains("sources", F.col("source")))

    pool = corpus.select("id", "ord", "source", "embedding", F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("_norm")).where("_norm > 0")
    pointed = asked.where("mode <> 'bm25' and vector is not null").withColumn("_qnorm", F.sqrt(dot(F.col("vector"), F.col("vector")))).where("_qnorm > 0")
    pairs = passing(pool.crossJoin(F.broadcast(pointed.select("qid", "sources", "vector", "_qnorm"))), True)  # a block of questions, of checked size
    cosine = F.round(dot(F.col("embedding"), F.col("vector")) / (F.col("_norm") * F.col("_qnorm")), 9)
    dense = ranked(pairs.select("qid", "id", "ord", "source", cosine.alias("score")), most)

    worded = asked.where("mode <> 'dense'").select("qid", "query", "sources")
    able = index is not None and index.impacts is not None
    if index is None or (able and meets_many(index, worded)):
        found = scanned_matches(corpus, worded, most, index_weights(index, worded) if able else corpus_weights(corpus, worded))
    else:
        found = passing(matches(index, worded).join(F.broadcast(worded.select("qid", "sources")), "qid"), False)
    top = ranked(found.select(columns), most)
    # passages without a match fill up, in store order: the first of each source are enough
    order = Window.partitionBy("source").orderBy("ord", "id")
    firsts = corpus.select("id", "ord", "source").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= 2 * most).drop("_n")
    short = worded.select("qid", "sources").join(top.where(F.col("rank") == most).select("qid"), "qid", "left_anti")
    zeros = passing(firsts.crossJoin(F.broadcast(short)), False).join(top.select("qid", "id"), ["qid", "id"], "left_anti").withColumn("score", F.lit(0.0))
    lexical = ranked(top.select(columns).unionByName(zeros.select(columns)), most)

    both = dense.withColumn("_ranking", F.lit(0)).unionByName(lexical.withColumn("_ranking", F.lit(1)))
    both = both.join(F.broadcast(rows.select("qid", "reach")), "qid").where("rank <= reach").join(F.broadcast(asked.select("qid", "mode", "depth")), "qid")
    single = both.where("mode in ('dense', 'bm25')").select(*columns, "rank")
    places = [F.min(F.when(F.col("_ranking") == i, F.col("rank"))).alias(f"_rank_{i}") for i in (0, 1)]
    mixed = both.where("mode not in ('dense', 'bm25')").groupBy("qid", "id", "ord", "source", "depth").agg(F.round(F.sum(rrf_term(F.col("rank"))), 12).alias("score"), *places)
    fused = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("_rank_0"), F.asc_nulls_last("_rank_1"))
    mixed = mixed.withColumn("rank", F.row_number().over(fused)).where("rank <= depth").select(*columns, "rank")
    return single.unionByName(mixed)

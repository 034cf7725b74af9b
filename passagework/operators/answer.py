"""From retrieved passages to evidence, prompts, answers, citation statistics and event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import citations, collapse_ws, fixed3, truncated
from ..schema import MAX_EVIDENCE_CHARS

#: Fixed texts that users of the engine see; fixed values.
NO_CONTEXT = "Không tìm thấy ngữ cảnh phù hợp trong tài liệu."
NO_EVIDENCE = "_Không có đoạn tài liệu nào được truy xuất._"
INSTRUCTION = (
    "You are a helpful chatbot.\nUse only the following pieces of context to answer the question. If there is no information about the question, say that there is no information. "
    "Cite your sources inline right after the relevant statement using the matching bracket number, e.g. write [1] or [2][3] — using the actual number of the source, never the literal "
    'text "[n]". Don\'t make up any new information and don\'t use markdown formatting:\n\n'
)


def evidence(hits: DataFrame) -> DataFrame:
    """qid, rank, text, score, source, pages, citation; a missing source or page is named as such."""
    source, pages = F.coalesce("source", F.lit("unknown")), F.coalesce("pages", F.lit("?"))
    citation = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), source, F.lit(", p. "), pages)
    return hits.select("qid", "rank", "text", F.col("score").cast("double").alias("score"), source.alias("source"), pages.alias("pages"), citation.alias("citation"))


def _joined(rows: DataFrame, piece: Column, between: str, name: str) -> DataFrame:
    """qid and its pieces in rank order. A query has top_n of them."""
    listed = F.array_sort(F.collect_list(F.struct("rank", piece.alias("piece"))))
    return rows.groupBy("qid").agg(F.array_join(F.transform(listed, lambda x: x["piece"]), between).alias(name))


def prompts(hits: DataFrame) -> DataFrame:
    """qid, prompt: the instruction and numbered passages."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (Source: "), F.col("source"), F.lit(", pages "), F.col("pages"), F.lit(")\n"), F.col("text"))
    return _joined(hits, head, "\n\n", "prompt").withColumn("prompt", F.concat(F.lit(INSTRUCTION), "prompt"))


def evidence_markdown(found: DataFrame, queries: DataFrame, most: int = MAX_EVIDENCE_CHARS) -> DataFrame:
    """qid, markdown for every query; one without evidence gets a fixed text."""
    text = truncated(collapse_ws(F.col("text")), most)
    piece = F.concat(F.lit("**"), F.col("citation"), F.lit("** — score `"), fixed3(F.col("score")), F.lit("`\n\n"), text)
    joined = queries.select("qid").join(_joined(found, piece, "\n\n---\n\n", "markdown"), "qid", "left")
    return joined.withColumn("markdown", F.coalesce("markdown", F.lit(NO_EVIDENCE)))


def answers(queries: DataFrame, generated: DataFrame) -> DataFrame:
    """qid, answer: the generated one (qid, answer), or that there is no context."""
    return queries.select("qid").join(generated.select("qid", "answer"), "qid", "left").withColumn("answer", F.coalesce("answer", F.lit(NO_CONTEXT)))


def citation_stats(generated: DataFrame, found: DataFrame) -> DataFrame:
    """qid, cited, size: how many different numbers an answer cites, any number, and how much evidence it had."""
    sizes = found.groupBy("qid").agg(F.count("*").alias("size"))
    cited = F.size(F.array_distinct(citations(F.col("answer"))))
    return generated.select("qid", cited.cast("long").alias("cited")).join(sizes, "qid", "left").withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))


def cited_notes(generated: DataFrame, found: DataFrame) -> DataFrame:
    """Evidence with first_at, the order of its first citation in the answer (null: uncited), and position: cited notes
    in that order, then the others by rank."""
    from pyspark.sql.window import Window

    marks = generated.select("qid", F.posexplode(citations(F.col("answer"))).alias("at", "rank"))
    first = marks.groupBy("qid", "rank").agg(F.min("at").alias("first_at"))
    order = Window.partitionBy("qid").orderBy(F.asc_nulls_last("first_at"), "rank")
    return found.join(first, ["qid", "rank"], "left").withColumn("position", F.row_number().over(order))


def display_lines(found: DataFrame, label: str) -> DataFrame:
    """qid, rank, line: retrieved passages as a console shows them."""
    where = F.concat("source", F.lit(", p. "), "pages")
    line = F.concat(F.lit(" - ["), F.col("rank").cast("string"), F.lit(f"] ({label}: "), fixed3(F.col("score")), F.lit(") ["), where, F.lit("]\n"), F.col("text"))
    return found.select("qid", "rank", line.alias("line"))

"""Chunking, ranking, fusion, rerank and answers against plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.models import OverlapScorer
from passagework.operators import answer, chunk, dense, diagnose, fuse, lexical, rerank, retrieve
from passagework.schema import OFFSETS

TWO_BLOCKS = [(0, 5, [1]), (7, 11, [2])]


@pytest.mark.parametrize(
    "piece, text, offsets, pages",
    [
        ("hello", "hello\n\nmore", TWO_BLOCKS, [1]), ("more", "hello\n\nmore", TWO_BLOCKS, [2]), ("lo\n\nmo", "hello\n\nmore", TWO_BLOCKS, [1, 2]), ("absent", "hello\n\nmore", TWO_BLOCKS, []),
        ("hello", "hello", [(0, 5, [3, 4])], [3, 4]), ("\n\n", "hello\n\nmore", TWO_BLOCKS, []), ("b", "a\n\nb\n\nb", [(0, 1, [1]), (3, 4, [2]), (6, 7, [3])], [2]),
    ],
)
def test_find_pages(spark, piece, text, offsets, pages):
    rows = spark.createDataFrame([(piece, text, offsets)], f"piece string, text string, offsets {OFFSETS.simpleString()}")
    assert rows.select(chunk.find_pages(F.col("piece"), F.col("text"), F.col("offsets"))).first()[0] == pages


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab é\n "), max_size=400), st.integers(8, 40), st.integers(0, 7))
def test_splitting(text, size, overlap):
    found = chunk.split_text(text, size, overlap)
    assert all(0 < len(c) <= size and c in text and c == c.strip() for c in found)
    assert bool(found) == bool(text.strip())
    assert Counter(re.findall(r"\S", text)) - Counter(re.findall(r"\S", "".join(found))) == Counter()


def test_splitting_prefers_coarse_separators():
    assert chunk.split_text("one two\n\nthree four", 12, 0) == ["one two", "three four"]
    assert chunk.split_text("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    assert chunk.split_text("aa bb cc dd", 8, 3) == ["aa bb cc", "cc dd"]


def test_documents_and_chunks(spark):
    blocks = spark.createDataFrame([("d", 2, [3], "third " * 5), ("d", 0, [1], "first"), ("d", 1, [2], "   "), ("e", 0, [1], "x")], "source string, block_no int, pages array<int>, text string")
    rows = {r.source: r for r in chunk.documents_of(blocks).collect()}
    assert rows["d"].text == "first\n\n" + "third " * 5 and [(o.s, o.e, o.pages) for o in rows["d"].offsets] == [(0, 5, [1]), (7, 37, [3])]
    got = {r.id: (r.text, r.pages) for r in chunk.chunks_of(chunk.documents_of(blocks)).collect()}
    assert got == {"d::0": ("first\n\n" + ("third " * 5).strip(), "1, 3"), "e::0": ("x", "1")}


@pytest.mark.parametrize("short, legacy, mode", [(0.2, 0.0, "regions"), (0.19, 0.0, "none"), (0.8, 0.5, "full"), (0.0, 0.01, "full_legacy"), (0.3, 0.02, "full_legacy")])
def test_ocr_modes(spark, short, legacy, mode):
    assert spark.range(1).select(diagnose.ocr_mode(F.lit(short), F.lit(legacy))).first()[0] == mode


def test_layers(spark):
    pages = spark.createDataFrame([("a", "x" * 100), ("a", "þ" * 4), ("b", None)], "source string, text string")
    rows = {r.source: r for r in diagnose.layer_stats(pages).collect()}
    assert (rows["a"].image_only_ratio, rows["a"].legacy_ratio) == (0.5, pytest.approx(4 / 104)) and (rows["b"].image_only_ratio, rows["b"].legacy_ratio) == (1.0, 0.0)


def test_ocr_engines():
    assert diagnose.ocr_engine({"vie", "eng", "fra"}, False) == "tesseract" and diagnose.ocr_engine({"eng"}, True) == "easyocr"
    with pytest.raises(RuntimeError):
        diagnose.ocr_engine(set(), False)


TEXTS = ["the cat sat", "the dog sat on the cat", "a bird", "", "cat cat cat", "unrelated words here"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"p{i}", i, f"s{i % 2}", t, str(i), [math.cos(i), math.sin(i)]) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, ("zero", 99, "s1", "zero vector", "1", [0.0, 0.0])], "id string, ord long, source string, text string, pages string, embedding array<float>")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(0, "cat sat", [1.0, 0.0]), (1, "the the bird", [0.0, 1.0]), (2, "nothing matches", [-1.0, 0.0]), (3, "  ", [1.0, 1.0])], "qid int, query string, vector array<float>")


def bm25(query, texts, k1=1.5, b=0.75):
    docs = [re.findall(r"\w+", t.lower()) for t in texts]
    avgdl = sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    scores = []
    for d in docs:
        tf, total = Counter(d), 0.0
        for w in re.findall(r"\w+", query.lower()):
            if tf[w]:
                total += math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (tf[w] + k1 * (1 - b + b * len(d) / avgdl))
        scores.append(total)
    return scores


def test_bm25_ranks_all_passages(corpus, queries):
    texts = [*TEXTS, "zero vector"]
    names = [*(f"p{i}" for i in range(len(TEXTS))), "zero"]
    rows = lexical.bm25_search(corpus, queries, 7).collect()
    for qid, query in enumerate(["cat sat", "the the bird", "nothing matches", "  "]):
        scores = bm25(query, texts)
        want = sorted(range(len(texts)), key=lambda i: (-round(scores[i], 9), i))
        got = sorted((r for r in rows if r.qid == qid), key=lambda r: r.rank)
        assert [r.id for r in got] == [names[i] for i in want]
        assert [r.score for r in got] == pytest.approx([scores[i] for i in want], abs=1e-8)


def test_bm25_filters_after_scoring(corpus, queries):
    every = {(r.qid, r.id): r.score for r in lexical.bm25_search(corpus, queries, 7).collect()}
    some = lexical.bm25_search(corpus, queries, 7, ["s1"]).collect()
    assert {r.source for r in some} == {"s1"} and all(r.score == every[r.qid, r.id] for r in some)
    assert lexical.bm25_search(corpus, queries, 7, []).count() == 0


def test_dense(corpus, queries):
    rows = dense.dense_search(corpus, queries, 3).where("qid = 0").orderBy("rank").collect()
    want = sorted(range(6), key=lambda i: -math.cos(i))[:3]
    assert [r.id for r in rows] == [f"p{i}" for i in want] and [r.score for r in rows] == pytest.approx([math.cos(i) for i in want], abs=1e-6)
    assert dense.dense_search(corpus, queries, 3, []).count() == 12  # an empty list is no filter
    assert {r.source for r in dense.dense_search(corpus, queries, 9, ["s0"]).collect()} == {"s0"}
    assert dense.dense_search(corpus.limit(0), queries, 3).count() == 0


def ranking(spark, ids):
    return spark.createDataFrame([(0, i, n) for n, i in enumerate(ids, 1)], "qid int, id string, rank int")


def test_fusion(spark):
    scores = {r.id: r.score for r in fuse.reciprocal_rank_fusion([ranking(spark, ["a", "b"]), ranking(spark, ["b", "c"])]).collect()}
    assert scores == pytest.approx({"a": 1 / 61, "b": 1 / 62 + 1 / 61, "c": 1 / 62})
    assert fuse.reciprocal_rank_fusion([ranking(spark, ["a"]), ranking(spark, ["a"])]).first().score == pytest.approx(2 / 61)
    assert fuse.reciprocal_rank_fusion([ranking(spark, []), ranking(spark, [])]).count() == 0
    # ties: in the order in which the rankings list them
    assert [r.id for r in fuse.fused_top([ranking(spark, ["a", "b"]), ranking(spark, ["c", "d"])], 4).orderBy("rank").collect()] == ["a", "c", "b", "d"]


def test_depths():
    assert fuse.candidate_depth(3) == 20 and fuse.candidate_depth(30) == 120
    assert retrieve.Options(top_n=3, rerank=True).depth == 30 and retrieve.Options(top_n=50, rerank=True).depth == 50 and retrieve.Options(top_n=3).depth == 3
    with pytest.raises(ValueError):
        retrieve.Options(top_n=0)


def candidates(spark):
    return spark.createDataFrame([(0, "a", "cat", "a dog", 0.9, 1), (0, "b", "cat", "the cat", 0.5, 2), (0, "c", "cat", "cat", 0.4, 3)], "qid int, id string, query string, text string, score double, rank int")


def test_rerank(spark):
    score = rerank.pair_scores("overlap", OverlapScorer, F.col("query"), F.col("text"))
    rows = rerank.rerank(candidates(spark), 2, score).orderBy("rank").collect()
    assert [(r.id, r.rank, r.score_kind) for r in rows] == [("b", 1, "rerank"), ("c", 2, "rerank")] and rows[0].score > 0.8


def test_rerank_without_a_model(spark):
    def broken():
        raise OSError("no model")

    for scorer in (None, rerank.pair_scores("broken", broken, F.col("query"), F.col("text"))):
        rows = rerank.rerank(candidates(spark), 2, scorer).orderBy("rank").collect()
        assert [(r.id, r.score, r.score_kind) for r in rows] == [("a", 0.9, "first_stage"), ("b", 0.5, "first_stage")]


def test_retrieve(corpus, queries):
    found = retrieve.retrieve(corpus, queries, retrieve.Options(top_n=2, mode="bm25")).collect()
    assert {r.qid for r in found} == {0, 1, 2}  # a blank query finds nothing
    assert {r.score_kind for r in retrieve.retrieve(corpus, queries, retrieve.Options(mode="semantic")).collect()} == {"hybrid"}
    reranked = retrieve.retrieve(corpus, queries, retrieve.Options(top_n=1, rerank=True, mode="dense"), rerank.pair_scores("overlap", OverlapScorer, F.col("query"), F.col("text"))).collect()
    assert {r.qid: r.id for r in reranked}[0] == "p0"


def hits(spark):
    return spark.createDataFrame([(0, 2, "b\n text", 0.5, None, None), (0, 1, "x" * 800, 0.0625, "f.pdf", "1, 2")], "qid int, rank int, text string, score double, source string, pages string")


def test_evidence_and_markdown(spark):
    found = answer.evidence(hits(spark))
    assert {r.rank: r.citation for r in found.collect()} == {1: "[1] f.pdf, p. 1, 2", 2: "[2] unknown, p. ?"}
    text = {r.qid: r.markdown for r in answer.evidence_markdown(found, spark.createDataFrame([(0,), (1,)], "qid int")).collect()}
    assert text[0] == f"**[1] f.pdf, p. 1, 2** — score `0.062`\n\n{'x' * 699}…\n\n---\n\n**[2] unknown, p. ?** — score `0.500`\n\nb text"
    assert text[1] == answer.NO_EVIDENCE


def test_prompts_and_answers(spark):
    rows = hits(spark).fillna({"source": "g.pdf", "pages": "?"})
    prompt = answer.prompts(rows).first().prompt
    assert prompt.startswith("You are a helpful chatbot.") and prompt.endswith("\n\n[2] (Source: g.pdf, pages ?)\nb\n text") and "[1] (Source: f.pdf, pages 1, 2)\nxxx" in prompt
    got = answer.answers(spark.createDataFrame([(0,), (1,)], "qid int"), spark.createDataFrame([(0, "yes")], "qid int, answer string"))
    assert dict(got.collect()) == {0: "yes", 1: answer.NO_CONTEXT}


def test_citations(spark):
    found = answer.evidence(hits(spark))
    said = spark.createDataFrame([(0, "see [2], [2] and [9]")], "qid int, answer string")
    assert answer.citation_stats(said, found).first()[1:] == (2, 2)
    assert [(r.rank, r.first_at) for r in answer.cited_notes(said, found).orderBy("position").collect()] == [(2, 0), (1, None)]

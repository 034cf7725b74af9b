"""Options by row against the searches for one set of options, and against the settings of the console."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from passagework.operators import by_row
from passagework.operators.retrieve import Options, first_stage
from passagework.plans.settings import Settings, handle
from passagework.sources.postings import PostingsIndex

KNOWN = ["a.pdf", "b.pdf", "c d.pdf"]
LINES = [
    "/top_n=7", "/top_n=0", "/ TOP_N =5", "/top_n=+4", "/top_n=", "/mode=DENSE", "/mode=semantic", "/mode=bm25", "/rerank=yes", "/rerank=OFF", "/rerank=maybe", "/rerank_k=-1", "/rerank_k=9", "/temperature=0.7",
    "/temperature=warm", "/temperature=1e-1", "/sources= a.pdf , b.pdf ", "/sources=a.pfd", "/sources=a.pdf,a.pfd", "/sources=c d.pdf", "/sources=all", "/sources=", "/sources=,,", "/nonsense=1", "/status", "hello", "  /mode = hybrid", "",
]


def test_lines_are_read_as_the_console_reads_them(spark):
    r = random.Random(4)
    asked = {i: [r.choice(LINES) for _ in range(r.randint(0, 6))] for i in range(80)} | {80 + i: [line] for i, line in enumerate(LINES)}
    rows = spark.createDataFrame([*asked.items(), (999, None)], "qid long, lines array<string>")
    found = {x.qid: x for x in by_row.options_of(rows, spark.createDataFrame([(k,) for k in KNOWN], "source string")).collect()}
    for qid, lines in (asked | {999: []}).items():
        want = Settings(known_sources=frozenset(KNOWN))
        for line in lines:
            want = handle(line, want).settings
        x = found[qid]
        assert (x.top_n, x.temperature, x.mode, x.rerank, x.rerank_k, x.sources) == (want.top_n, want.temperature, want.mode, want.rerank, want.rerank_k, None if want.sources is None else [*want.sources]), lines


def test_one_plan_gives_what_each_set_of_options_gives(spark):
    r = random.Random(7)
    words = ["red", "green", "blue", "grey", "white"]
    corpus = [(str(i), i, r.choice(["s", "t", "u", None]), " ".join(r.choice(words) for _ in range(r.randint(0, 9))), [r.choice([-1.0, 0.5, 1.0]) for _ in range(3)]) for i in range(60)]
    corpus = spark.createDataFrame([*corpus, ("z", 99, "s", None, [0.0, 0.0, 0.0])], "id string, ord long, source string, text string, embedding array<float>")
    questions = [(i, r.choice(["red", "blue grey", "nothing", "white white"]), [1.0, r.random(), 0.0]) for i in range(9)] + [(9, "  ", [1.0, 0.0, 0.0]), (10, "green", None)]
    options = [(i, r.randint(1, 6), m, i % 4 == 0, 8, s) for i, (m, s) in enumerate([("dense", None), ("bm25", None), ("hybrid", None), ("dense", []), ("bm25", []), ("hybrid", ["s", "t"]), ("bm25", ["u"]), ("dense", ["t"]), ("odd", ["u", "s"]), ("bm25", None), ("dense", None)])]
    questions = spark.createDataFrame(questions, "qid long, query string, vector array<float>")
    table = spark.createDataFrame(options, "qid long, top_n int, mode string, rerank boolean, rerank_k int, sources array<string>")
    found = by_row.first_stages(corpus, questions, table).select("qid", "id", "score", "rank").collect()
    for qid, top_n, mode, again, rerank_k, sources in options:
        mine = {tuple(x) for x in found if x.qid == qid}
        if qid in (9, 10):
            assert not mine
            continue
        one = first_stage(corpus, questions.where(F.col("qid") == qid), Options(top_n, mode, again, rerank_k, sources))
        assert mine == {tuple(x) for x in one.collect()}, (mode, sources)
    assert by_row.first_stages(corpus.limit(0), questions, table).count() == 0


def test_many_postings_are_left_for_the_texts(spark, tmp_path, monkeypatch):
    """A block that meets too many postings is scored in the scan, by each row's own sources, with the same rows."""
    corpus = spark.createDataFrame([(str(i), i, "st"[i % 2], "red green"[: 3 + i % 7], [1.0, 0.5 * i]) for i in range(40)], "id string, ord long, source string, text string, embedding array<float>")
    questions = spark.createDataFrame([(1, "red", [1.0, 0.0]), (2, "green red", [0.0, 1.0]), (3, "red", None)], "qid long, query string, vector array<float>")
    options = spark.createDataFrame([(1, 5, "bm25", False, 8, ["s"]), (2, 3, "hybrid", False, 8, None), (3, 4, "bm25", False, 8, [])], "qid long, top_n int, mode string, rerank boolean, rerank_k int, sources array<string>")
    index = PostingsIndex.write(corpus, str(tmp_path / "i"))
    found = lambda: sorted(map(tuple, by_row.first_stages(corpus, questions, options, index).collect()))
    few = found()
    monkeypatch.setattr("passagework.operators.lexical.PRUNE_BYTES", 0)
    monkeypatch.setattr("passagework.operators.lexical.PRUNE_FROM", 0)
    monkeypatch.setattr(by_row, "matches", lambda *_: 1 / 0)
    assert found() == few

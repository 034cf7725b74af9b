"""The pipeline against a plain re-computation of every stage's decisions."""

from __future__ import annotations

import math
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from passagework.llm import mixing, packing, quality

from .test_near_copies import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.fit(quality.labelled_sample(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    kept = {i for i, p in zip(rows, quality.predict([r.text for r in rows.values()], model)) if p >= 0.5}
    stages, given = dict(corpus_pipeline.STAGES), docs
    given = stages["quality"](spark, given, SF)
    assert {r.doc_id for r in given.collect()} == kept and given.columns == docs.columns

    last = {}
    for i in kept:
        last[rows[i].text] = max(i, last.get(rows[i].text, i))
    given = stages["exact_dedup"](spark, given, SF)
    assert {r.doc_id for r in given.collect()} == set(last.values()) and given.columns == docs.columns

    stay = {min(group) for group in brute({i: rows[i].text for i in last.values()})}
    given = stages["near_dedup"](spark, given, SF)
    assert {r.doc_id for r in given.collect()} == stay and given.columns == docs.columns

    taken = {r.doc_id: r for r in mixing.mix_table(given).collect()}
    mixed = stages["mixing"](spark, given, SF)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and all(copies[i] == math.floor(t.taken / t.size + 0.5) for i, t in taken.items() if t.size)

    pieces = stages["packing"](spark, mixed, SF).collect()
    tokens, tokenizer = Counter(), Tokenizer.from_file(packing.tokenizer_path())
    for p in pieces:
        tokens[p.doc_id] += p.length
    assert all(tokens[i] == n * (len(tokenizer.encode(rows[i].text, add_special_tokens=False).ids) + 1) for i, n in copies.items())


def test_awkward_and_empty_tables(spark, awkward, empty, labels, tmp_path):
    """Nulls, blanks, ties, repeated rows and clashing names go through every stage; empty tables give empty ones."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    given = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = stage(spark, given, str(tmp_path))
        assert given.columns == awkward.columns, name
    rows = corpus_pipeline.STAGES[-1][1](spark, given, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in awkward.collect()} and all(1 <= r.length <= 4096 for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_run(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert corpus_pipeline.run(spark, SF).count() > 100

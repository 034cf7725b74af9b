"""The splitter against a second one, written from the public description of recursive character splitting."""

from __future__ import annotations

import random

import duckdb

from passagework import queries
from passagework.operators.chunk import split_text

SF = "/root/testdata/sf0.001"


def plain(text, size=512, overlap=50, separators=("\n\n", "\n", " ", "")):
    """Split at the first separator that occurs, which stays before what follows it; too long pieces go on to the finer
    separators; the others are merged to passages of at most `size`, overlapping by at most `overlap`."""
    separator, finer = next(((s, separators[i + 1 :]) for i, s in enumerate(separators) if s == "" or s in text), (separators[-1], ()))
    first, *others = text.split(separator) if separator else ("", *text)
    pieces = [p for p in (first, *(separator + o for o in others)) if p]
    out, run = [], []

    def merge():
        window = []
        for piece in run:
            if window and sum(map(len, window)) + len(piece) > size:
                out.append("".join(window))
                while sum(map(len, window)) > overlap or (window and sum(map(len, window)) + len(piece) > size):
                    window.pop(0)
            window.append(piece)
        out.append("".join(window))
        run.clear()

    for piece in pieces:
        if len(piece) < size:
            run.append(piece)
        else:
            merge()
            out.extend(plain(piece, size, overlap, finer) if finer else [piece])
    merge()
    return [p.strip() for p in out if p.strip()]


def test_random_texts():
    r = random.Random(4)
    for _ in range(400):
        text = "".join(r.choice(["a", "bc", "d" * 9, " ", " ", "\n", "\n\n", "\n\n\n", "x" * 40, "é😀"]) for _ in range(r.randint(0, 160)))
        size = r.choice([5, 20, 60])
        overlap = r.choice([0, 3, size // 2])
        assert split_text(text, size, overlap) == plain(text, size, overlap)


def test_the_query_has_the_plain_splitters_passages(spark):
    texts = duckdb.sql(f"SELECT doc_id::VARCHAR, text FROM '{SF}/documents.parquet'").fetchall()
    want = {(source, i, passage) for source, text in texts for i, passage in enumerate(plain(text))}
    assert {(r.source, r.chunk_ix, r.text) for r in queries.QUERIES["chunks"](spark, SF).collect()} == want

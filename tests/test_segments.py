"""Documents of any size: splitting by segments and first occurrences, against the plain functions over whole texts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from passagework.operators import chunk, occurrences, segments
from passagework.operators.chunk import split_text

SEGMENT, SIZE, OVERLAP = 128, 20, 6
ALPHABETS = [["a", "bc", "d" * 9, " ", " ", "\n", "\n\n", "\n\n\n", "x" * 40, "é😀"], ["a", " "], ["a"], ["\n", "\n", "a"], ["word ", "\n", "\n\n", "long" * 3 + " "], ["ab ", "cd ", "\n"]]


def texts(n, seed=3):
    r = random.Random(seed)
    found = {f"d{i}": "".join(r.choice(alphabet) for _ in range(r.randint(0, 900))) for i in range(n) for alphabet in [r.choice(ALPHABETS)]}
    return found | {"empty": "", "blank": " \n" * 300, "ends": "\n" * 1001 + "words " * 60 + "\n" * 640 + "more words\n\nand more", "one": "x" * 1000}


def test_segments_give_the_plain_splitters_passages(spark):
    all_texts = texts(40)
    documents = spark.createDataFrame([*all_texts.items(), ("null", None)], "source string, text string")
    parts = segments.segments_of_documents(documents, SEGMENT)
    found = segments.passages_of(parts, SIZE, OVERLAP, SEGMENT, members=3).collect()
    want = {(name, i, passage) for name, text in all_texts.items() for i, passage in enumerate(split_text(text, SIZE, OVERLAP))}
    assert {(r.source, r.chunk_ix, r.text) for r in found} == want and len(found) == len(want)
    assert all(all_texts[r.source][r.start :].startswith(r.text) for r in found)


def test_blocks_become_segments_of_their_document(spark):
    r = random.Random(8)
    rows = [(f"s{i}", j * 7 - 3, r.choice(["", " ", "a" * r.randint(1, 400), "two\n\nparts\n", "\n\nlines", "some words here"])) for i in range(6) for j in range(r.randint(0, 60))]
    parts = segments.segments_of_blocks(spark.createDataFrame(rows, "source string, block_no long, text string").repartition(3), segment=SEGMENT).collect()
    for name in {row[0] for row in rows}:
        want = "\n\n".join(t for s, _, t in sorted(rows) if s == name and t.strip())
        mine = sorted((p.k, p.text) for p in parts if p.source == name)
        assert "".join(t for _, t in mine) == want and [k for k, _ in mine] == [*range(len(mine))]
        assert all(len(t) == SEGMENT for _, t in mine[:-1])


def test_first_occurrences(spark):
    all_texts = texts(25, seed=9) | {"again": "the same words, again and again. " * 40}
    documents = spark.createDataFrame([*all_texts.items()], "source string, text string")
    r, asked = random.Random(2), set()
    for name, text in all_texts.items():
        for _ in range(12):
            at = r.randint(0, max(0, len(text) - 1))
            asked.add((name, text[at : at + r.randint(1, SIZE)]))
        asked.add((name, "nowhere in it"))
    asked.discard(("empty", ""))
    asked = {(n, t) for n, t in asked if t}
    passages = spark.createDataFrame([*asked], "source string, text string")
    parts = segments.segments_of_documents(documents, SEGMENT)
    found = {(x.source, x.text): x.first for x in occurrences.first_occurrences(parts, passages, SIZE, SEGMENT).collect()}
    assert found == {(n, t): all_texts[n].find(t) for n, t in asked if t in all_texts[n]}


def test_both_ways_give_the_same_chunks(spark):
    r = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "the", "same", "line"]
    rows = []
    for name in ("a", "b"):
        for j in range(40):
            text = "\n".join(" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(r.randint(1, 4)))
            rows.append((name, j, [j // 3 + 1], "the same line, everywhere" if j % 5 == 0 else text))
    rows += [("tiny", 0, [1], "few words"), ("blank", 0, [1], " \n"), ("a", 99, None, None)]
    blocks = spark.createDataFrame(rows, "source string, block_no int, pages array<int>, text string")
    plain = {tuple(map(str, x)) for x in chunk.chunks_of_blocks(blocks).collect()}
    assert {tuple(map(str, x)) for x in chunk.chunks_of_blocks(blocks, segment=4096).collect()} == plain
    assert {tuple(map(str, x)) for x in chunk.chunks_of(chunk.documents_of(blocks).drop("rows"), segment=4096).collect()} == plain
    assert chunk.chunks_of_blocks(blocks.limit(0)).count() == 0


def test_a_document_of_two_megabytes(spark):
    text = " ".join(f"word{i % 977}" for i in range(260_000))
    one = spark.createDataFrame([("big", text)], "source string, text string").withColumn("offsets", F.array(F.struct(F.lit(0).alias("s"), F.length("text").alias("e"), F.array(F.lit(1)).alias("pages"))))
    found = chunk.chunks_of(one).select("chunk_ix", "text", "pages").collect()
    assert sorted((x.chunk_ix, x.text) for x in found) == [*enumerate(split_text(text))] and {x.pages for x in found} == {"1"}


def test_work_tables_of_a_long_document_hold_its_text_once(spark, monkeypatch):
    """Repeated lines and passages: whatever is found and looked for, only segments are written as texts."""
    r, written = random.Random(4), []
    line = " ".join(f"common{i}" for i in range(60))
    rows = [("s", j, [j], line if j % 9 == 0 else " ".join(f"{r.randrange(10**9)}" for _ in range(r.randint(50, 400)))) for j in range(150)]
    blocks = spark.createDataFrame(rows, "source string, block_no int, pages array<int>, text string")
    plain = {tuple(map(str, x)) for x in chunk.chunks_of_blocks(blocks, segment=1 << 30).collect()}

    def kept(df, name, write=chunk.work_table):
        table = write(df, name)
        written.append((name, table.select(*(F.sum(F.length(c)).cast("long") for c, kind in df.dtypes if kind == "string" and c != "source")).first() if any(kind == "string" and c != "source" for c, kind in df.dtypes) else (0,)))
        return table

    for module in (chunk, occurrences, segments):
        monkeypatch.setattr(module, "work_table", kept)
    assert {tuple(map(str, x)) for x in chunk.chunks_of_blocks(blocks, segment=1 << 14).collect()} == plain
    assert sum(n or 0 for _, sums in written for n in sums) < 2 * sum(len(row[3]) for row in rows), written

"""Overlapping passages of documents, with the pages that they stand on.

A document of up to `segments.SEGMENT` code points is split in its row; a longer one by segments, so that neither a row nor a
task grows with it. Both give the same passages.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType
from pyspark.sql.window import Window

from ..functions.text import format_pages, is_blank
from ..schema import CHUNK_OVERLAP, CHUNK_SIZE, PAGE_SEPARATOR
from ..sources.work import work_table
from . import occurrences, segments

#: Block numbers in a run that is summed on its own.
BUCKET = 4096
SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Parts of a text, each with the separator before it."""
    if not separator:
        return list(text)
    first, *others = text.split(separator)
    return [p for p in (first, *(separator + o for o in others)) if p]


def _packed(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Pieces put together up to a size; the next passage starts with as many last pieces as the overlap allows."""
    held: list[str] = []
    total = start = 0  # held[start:] is the passage so far
    for piece in pieces:
        if start < len(held) and total + len(piece) > size:
            if passage := "".join(held[start:]).strip():
                yield passage
            while total > overlap or (total and total + len(piece) > size):
                total -= len(held[start])
                start += 1
        held.append(piece)
        total += len(piece)
    if passage := "".join(held[start:]).strip():
        yield passage


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Passages of at most `size` code points, cut at the coarsest separator that does it."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    found: list[str] = []
    small: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            small.append(piece)
            continue
        found.extend(_packed(small, size, overlap))
        small = []
        found.extend(split_text(piece, size, overlap, finer) if finer else [piece])
    found.extend(_packed(small, size, overlap))
    return found


@F.pandas_udf(ArrayType(StringType()))
def _split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: split_text(t) if t else [])


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _under(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for texts, passages, starts, stops, pages in batches:
        found = []
        for text, some, s, e, p in zip(texts, passages, starts, stops, pages):
            rows: list[list[int]] = []
            for passage in some:
                at, on = (text.find(passage) if passage else 0), set()
                i = bisect_right(e, at) if at >= 0 else len(e)
                while i < len(e) and s[i] < at + len(passage):
                    on.update(p[i])
                    i += 1
                rows.append(sorted(on))
            found.append(rows)
        yield pd.Series(found)


def pages_of(text: Column, passages: Column, offsets: Column) -> Column:
    """find_pages of all passages (array) of a document, whose offsets are in order: one array of pages each."""
    part = lambda name: F.transform(offsets, lambda o: o[name])
    return _under(text, passages, part("s"), part("e"), part("pages"))


def with_offsets(blocks: DataFrame, separator: str = PAGE_SEPARATOR) -> DataFrame:
    """Adds start and stop: where a block stands in its document's text, blocks being joined by the separator.

    Sums go by runs of BUCKET block numbers, and then over the runs' totals: no task holds all blocks of a document.
    """
    keys = ["source", "_bucket"]
    rows = blocks.withColumn("_bucket", F.floor(F.col("block_no") / BUCKET)).withColumn("_size", F.coalesce(F.length("text").cast("long") + len(separator), F.lit(0)))
    totals = rows.groupBy(*keys).agg(F.sum("_size").alias("_total"))
    base = totals.withColumn("_base", F.sum("_total").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_total"))
    base = base.select(F.col("source").alias("_source"), F.col("_bucket").alias("_of"), "_base")
    within = Window.partitionBy(*keys).orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(base, F.col("source").eqNullSafe(F.col("_source")) & F.col("_bucket").eqNullSafe(F.col("_of")))
    start = F.col("_base") + F.sum("_size").over(within) - F.col("_size")
    placed = joined.withColumn("start", start).withColumn("stop", F.col("start") + F.length("text"))
    return placed.select(*(F.col(f"`{c}`") for c in blocks.columns), "start", "stop")


def documents_of(blocks: DataFrame, separator: str = PAGE_SEPARATOR) -> DataFrame:
    """One row a source: text, offsets and its blocks (rows); blank blocks are left out. A document is one row: for documents as
    large as a file, not for sources of any size."""
    kept = blocks.where(~is_blank(F.col("text")))
    placed = with_offsets(kept, separator)
    row = F.struct("block_no", F.col("start").alias("s"), F.col("stop").alias("e"), "pages", "text")
    rows = placed.groupBy("source").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["text"]), separator)
    offsets = F.transform("rows", lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), r["pages"].alias("pages")))
    return rows.select("source", text.alias("text"), offsets.alias("offsets"), "rows")


def find_pages(chunk: Column, text: Column, offsets: Column) -> Column:
    """The pages under a chunk's first occurrence, distinct and sorted; none if it doesn't occur. A separator belongs to
    no block, so intervals overlap strictly."""

    def under(start: Column) -> Column:
        found = F.filter(offsets, lambda o: (o["s"] < start + F.length(chunk)) & (o["e"] > start))
        return F.when(start >= 0, F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda o: o["pages"])))))

    # through a one-element array, so that the text is searched once and not for each interval
    pages = F.transform(F.array(F.position(chunk, text) - 1), under)[0]
    return F.coalesce(pages, F.array().cast("array<int>"))


def _named(found: DataFrame) -> DataFrame:
    """id, source, chunk_ix, text, page_list, pages."""
    name = F.concat("source", F.lit("::"), F.col("chunk_ix").cast("string"))
    return found.select(name.alias("id"), "source", "chunk_ix", "text", "page_list", format_pages(F.col("page_list")).alias("pages"))


def _split_rows(documents: DataFrame) -> DataFrame:
    """source, chunk_ix, text, page_list of documents that are rows. Pages are looked up before the passages part, so that no
    passage carries its document with it. No shuffle."""
    split = documents.select("source", "text", "offsets", _split(F.col("text")).alias("_passages"))
    split = split.withColumn("_pages", pages_of(F.col("text"), F.col("_passages"), F.col("offsets")))
    placed = F.zip_with("_passages", "_pages", lambda p, on: F.struct(p.alias("text"), on.alias("page_list")))
    return split.select("source", F.posexplode(placed).alias("chunk_ix", "_p")).select("source", F.col("chunk_ix").cast("long").alias("chunk_ix"), "_p.text", "_p.page_list")


def _split_segments(parts: DataFrame, segment: int = segments.SEGMENT) -> DataFrame:
    """The same of documents that are segments with their neighbours' ends and the blocks beneath (source, k, text, before, after,
    starts, stops, pages). Only numbers are shuffled: passages are found, looked for and at last written in scans of the segments."""
    near = segments.entered(segments.with_neighbours(parts))
    found = work_table(occurrences.placed(near, segment=segment), "placed")
    wanted = work_table(found.groupBy("source", "key", "n", "length", "digest").agg(F.min("start").alias("start"), F.count("*").alias("rows")), "keyed")
    firsts = wanted.join(occurrences.earlier(near, wanted.drop("rows"), segment=segment), ["source", "length", "digest"], "left")
    firsts = work_table(firsts.where("first is not null or rows > 1").select("source", "length", "digest", F.coalesce("first", "start").alias("first")), "firsts")
    # what occurs before its own place gets the pages there, the rest those of its own
    moved = work_table(found.select("source", "k", "i", "start", "length", "digest").join(firsts, ["source", "length", "digest"]).where("first <> start").select("source", "k", "i", "first", "length"), "moved")
    spans = parts.select("source", F.explode(F.arrays_zip("starts", "stops", "pages")).alias("_s")).select("source", F.col("_s.starts").alias("start"), F.col("_s.stops").alias("stop"), F.col("_s.pages").alias("pages"))
    pages = moved.join(occurrences.pages_under(moved, spans), ["source", "first", "length"], "left").select("source", "k", "i", F.coalesce("page_list", F.array().cast("array<int>")).alias("page_list"))
    told = segments.numbered(found).join(pages.groupBy("source", "k").agg(F.map_from_entries(F.collect_list(F.struct("i", "page_list"))).alias("moved")), ["source", "k"], "left")
    return _written(near.join(work_table(told, "told"), ["source", "k"]), segment)


def _written(told: DataFrame, segment: int) -> DataFrame:
    """source, chunk_ix, text, page_list of the passages that begin in segments."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, k, text, before, after, odd, entry, starts, stops, pages, first_ix, moved in batch[columns].itertuples(index=False):
                order = sorted(range(len(starts)), key=starts.__getitem__)
                spans, rows, moved = [(starts[i], stops[i], pages[i]) for i in order], [], dict(moved or {})
                last = [s[1] for s in spans]
                for i, (at, passage) in enumerate(segments.Sliced(text, before, after, odd, CHUNK_SIZE, CHUNK_OVERLAP).passages(entry)):
                    if i not in moved:
                        at, on = at + k * segment, set()
                        j = bisect_right(last, at)
                        while j < len(spans) and spans[j][0] < at + len(passage):
                            on.update(() if spans[j][2] is None else map(int, spans[j][2]))
                            j += 1
                        moved[i] = sorted(on)
                    rows.append((source, first_ix + i, passage, moved[i]))
                yield pd.DataFrame(rows, columns=["source", "chunk_ix", "text", "page_list"])

    columns = ["source", "k", "text", "before", "after", "odd", "entry", "starts", "stops", "pages", "first_ix", "moved"]
    return told.select(columns).mapInPandas(each, "source string, chunk_ix long, text string, page_list array<int>")


def chunks_of(documents: DataFrame, segment: int = segments.SEGMENT) -> DataFrame:
    """From documents (source, text, offsets): id, source, chunk_ix, text, page_list, pages."""
    long = F.length("text") > segment
    found = _split_rows(documents.where(~long))
    if not documents.where(long).isEmpty():
        documents = documents.where(long)
        part = lambda name, kind: F.transform("offsets", lambda o: o[name].cast(kind)).alias(f"{name}_")
        cut = documents.select("source", "text", part("s", "long"), part("e", "long"), part("pages", "array<int>")).toDF("source", "text", "starts", "stops", "pages")
        found = found.unionByName(_split_segments(segments.slices_of_documents(cut, segment), segment))
    return _named(found)


def chunks_of_blocks(blocks: DataFrame, segment: int = segments.SEGMENT) -> DataFrame:
    """The same from blocks (source, block_no, pages, text), whose documents are their texts joined by the page separator."""
    kept = blocks.where(~is_blank(F.col("text")))
    sizes = kept.groupBy("source").agg((F.sum(F.length("text").cast("long") + len(PAGE_SEPARATOR)) - len(PAGE_SEPARATOR)).alias("_size"))
    long = work_table(sizes.where((F.col("_size") > segment) & F.col("source").isNotNull()).select("source"), "long")
    found = _split_rows(documents_of(kept.join(long, "source", "left_anti")))
    if not long.isEmpty():
        found = found.unionByName(_split_segments(segments.segments_of_blocks(kept.join(long, "source", "left_semi"), segment=segment), segment))
    return _named(found)

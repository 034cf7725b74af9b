"""Passages of documents of any size: no row holds a document.

A document is a sequence of segments, SEGMENT code points each. Whether a piece of text between two separators is small
(shorter than a passage may be) or is taken apart by a finer separator shows within a passage's length on either side, so
a segment with the ends of its neighbours knows its atoms (small pieces), and where runs of atoms begin that are packed
together. An atom's start decides the passage that would begin there and where the next one would begin: a pointer that
never jumps further than a passage's length.

So a segment is a function: from the start at which packing enters it, one of the few in its first SIZE code points, to the
start at which it enters the next. If a run begins in the segment that function is constant. Functions are composed by
families of FAMILY segments, those by families again, up to the document; then every segment is told its entry, downwards,
and writes its passages. Neither a task nor a row grows with a document.

Texts are shuffled once. Where a run of blocks begins in its document is known from their lengths; the runs' texts are dealt to
tasks and sorted there, and a task cuts its run into slices: a segment with its neighbours' ends and the blocks beneath. The slices
at a run's ends, which two runs or more hold parts of, are put together by a second, small shuffle.

Nulls: a document without text has no passages. Passages of white space are left out. An empty table gives an empty result.
Repeated documents of the same name aren't told apart: names must be unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_blank
from ..schema import CHUNK_OVERLAP, CHUNK_SIZE, PAGE_SEPARATOR
from ..sources.work import work_table

#: Code points of a segment (an even number, so that whole segments of line ends keep their parity); segments of a family.
SEGMENT, FAMILY = 1 << 16, 512
#: Segments, or block numbers, that are numbered in one window; segments of blocks that a task puts together at least.
BUCKET, RUN = 4_096, 128


def segments_of_documents(documents: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """source, k, text from documents (source, text): each text cut every `segment` code points, in one pass over it."""
    return documents.select("source", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{segment}}}"), F.lit(0))).alias("k", "text")).withColumn("k", F.col("k").cast("long"))


def ends(size: int) -> tuple[int, int]:
    """How many code points of its neighbours a segment sees: behind, and ahead (one more than is needed, to see that there is one)."""
    return 2 * size + 2, 3 * size + 3


SLICE = "source string, k long, begin long, slice string, starts array<long>, stops array<long>, pages array<array<int>>"


def _slices(run: Iterator[tuple[str, list[int] | None]], begin: int, total: int, separator: str, segment: int, size: int) -> Iterator[tuple]:
    """The slices of a run of blocks (text, pages) that begins at a place of its document: k, begin, slice, starts, stops and
    pages of its blocks, and whether that is the whole slice."""
    behind, ahead = ends(size)
    k, at, place, held, parts, spans = max(0, (begin - ahead) // segment), begin, begin, "", [], []

    def cut(stop: int) -> tuple:
        start = max(k * segment - behind, at)
        under = [x for x in spans if x[0] < stop and x[1] > start]
        whole = start == max(k * segment - behind, 0) and stop == min((k + 1) * segment + ahead, total)
        return k, start, held[start - at : stop - at], [x[0] for x in under], [x[1] for x in under], [x[2] for x in under], whole

    for text, pages in run:
        stop = place + len(text)
        spans.append((place, stop, pages))
        parts.append(text + separator if stop < total else text)
        place += len(parts[-1])
        if place < (k + 1) * segment + ahead:
            continue
        held, parts = held + "".join(parts), []
        while place >= (k + 1) * segment + ahead:
            yield cut((k + 1) * segment + ahead)
            k += 1
        if (keep := k * segment - behind) > at:
            held, at, spans = held[keep - at :], keep, [x for x in spans if x[1] > keep]
    held += "".join(parts)
    while k * segment - behind < place and k * segment < total:
        yield cut(min((k + 1) * segment + ahead, place))
        k += 1


def _columns(slices: DataFrame, segment: int, size: int) -> DataFrame:
    before = F.least(F.lit(ends(size)[0]).cast("long"), F.col("k") * segment).cast("int")
    part = lambda start, n: F.substring("slice", start, n)
    return slices.select("source", "k", part(before + 1, F.lit(segment)).alias("text"), part(F.lit(1), before).alias("before"), part(before + 1 + segment, F.length("slice")).alias("after"), "starts", "stops", "pages")


def slices_of_documents(documents: DataFrame, segment: int = SEGMENT, size: int = CHUNK_SIZE) -> DataFrame:
    """source, k, text, before, after, starts, stops, pages from documents (source, text, starts, stops, pages): segments with the
    ends of their neighbours and the blocks beneath. No shuffle."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, text, starts, stops, pages in batch[["source", "text", "starts", "stops", "pages"]].itertuples(index=False):
                behind, ahead = ends(size)
                rows = []
                for k in range(-(-len(text) // segment)):
                    start, stop = max(0, k * segment - behind), min(len(text), (k + 1) * segment + ahead)
                    under = [i for i in range(len(starts)) if starts[i] < stop and stops[i] > start]
                    rows.append((source, k, start, text[start:stop], [int(starts[i]) for i in under], [int(stops[i]) for i in under], [pages[i] for i in under]))
                yield pd.DataFrame(rows, columns=["source", "k", "begin", "slice", "starts", "stops", "pages"])

    made = work_table(documents.select("source", "text", "starts", "stops", "pages").mapInPandas(cut, SLICE), "slices")
    return _columns(made, segment, size)


def segments_of_blocks(blocks: DataFrame, separator: str = PAGE_SEPARATOR, segment: int = SEGMENT, size: int = CHUNK_SIZE) -> DataFrame:
    """The same from blocks (source, block_no, text, and pages if there are any), whose documents are their texts joined by the
    separator; blank blocks are left out. Blocks may be longer than a segment. Sources without a name are left out."""
    kept = blocks.where(~is_blank(F.col("text")) & F.col("source").isNotNull())
    kept = kept.select("source", "block_no", F.col("pages") if "pages" in blocks.columns else F.lit(None).cast("array<int>").alias("pages"), "text", F.floor(F.col("block_no") / BUCKET).alias("_bucket"))
    sums = kept.groupBy("source", "_bucket").agg(F.sum(F.length("text").cast("long") + len(separator)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_size")
    total = F.sum("_size").over(Window.partitionBy("source")) - len(separator)
    runs = sums.select("source", "_bucket", before.alias("_at"), total.alias("_total")).withColumn("_run", F.floor(F.col("_at") / (RUN * segment)))
    runs = runs.withColumn("_begin", F.min("_at").over(Window.partitionBy("source", "_run"))).drop("_at")
    # one row a bucket of blocks: small enough to go to every task
    dealt = kept.join(work_table(runs, "runs"), ["source", "_bucket"])
    dealt = dealt.repartition("source", "_run").sortWithinPartitions("source", "_run", "block_no")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for at in range(0, batch.num_rows, 256) for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)))
        for (source, _, begin, total), run in groupby(rows, key=lambda row: row[:4]):
            for found in _slices(((text, pages) for *_, text, pages in run), begin, total, separator, segment, size):
                yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, (source, *found)))], schema=kinds)

    kinds = pa.schema([("source", pa.string()), ("k", pa.int64()), ("begin", pa.int64()), ("slice", pa.string()), ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64())), ("pages", pa.list_(pa.list_(pa.int32()))), ("whole", pa.bool_())])
    made = work_table(dealt.select("source", "_run", "_begin", "_total", "text", "pages").mapInArrow(cut, f"{SLICE}, whole boolean"), "slices")
    listed = F.array_sort(F.collect_list(F.struct("begin", "slice", "starts", "stops", "pages")))
    parted = made.where("not whole").groupBy("source", "k").agg(listed.alias("_l"))
    of = lambda name: F.transform("_l", lambda x: x[name])
    parted = parted.select("source", "k", F.array_join(of("slice"), "").alias("slice"), *(F.flatten(of(name)).alias(name) for name in ("starts", "stops", "pages")))
    names = ["source", "k", "slice", "starts", "stops", "pages"]
    return _columns(made.where("whole").select(names).unionByName(work_table(parted, "parted").select(names)), segment, size)


def placed_by(rows: DataFrame, order: list[str], bucket: F.Column, size: F.Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `size` over a source's rows that come before, by buckets of the order and then their totals."""
    rows = rows.withColumn("_bucket", bucket).withColumn("_size", size)
    totals = rows.groupBy("source", "_bucket").agg(F.sum("_size").alias("_total"))
    base = totals.select("source", "_bucket", (F.sum("_total").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_total")).alias("_base"))
    within = Window.partitionBy("source", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(base, ["source", "_bucket"]).withColumn(out, F.col("_base") + F.sum("_size").over(within) - F.col("_size")).drop("_bucket", "_size", "_base")


def with_neighbours(segments: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Adds before and after, the ends of the neighbouring segments (null where there is none) unless they are there, and odd:
    whether an odd number of line ends stands right before `before`."""
    behind, ahead = ends(size)
    if "before" not in segments.columns:
        none = F.lit(None).cast("string")
        own = segments.select("source", "k", "text", none.alias("before"), none.alias("after"))
        to_next = segments.select("source", F.col("k") + 1, none, F.right("text", F.lit(behind)), none)
        to_last = segments.select("source", F.col("k") - 1, none, none, F.left("text", F.lit(ahead)))
        met = own.union(to_next).union(to_last).groupBy("source", "k").agg(F.max("text").alias("text"), F.max("before").alias("before"), F.max("after").alias("after"))
        segments = work_table(met.where("text is not null"), "segments")
    prefix = F.substring("text", F.lit(1), F.greatest(F.length("text") - behind, F.lit(0)))
    line_ends = lambda text: F.length(text) - F.length(F.rtrim(text, F.lit("\n")))
    # of the last segment: line ends that run up to its end (ends) and up to where `before` begins (odd); all: nothing else stands there
    marks = segments.select("source", (F.col("k") + 1).alias("k"), line_ends(F.col("text")).alias("ends"), (line_ends(F.col("text")) == F.length("text")).alias("all"), line_ends(prefix).alias("odd"), (line_ends(prefix) == F.length(prefix)).alias("odd_all"))
    marks = work_table(marks.where("ends > 0 or odd > 0 or odd_all"), "marks")
    # how many line ends stand right before a segment: those of the last one, or, where that is nothing else, of the one
    # before a whole island of such (whole segments are even and don't count)
    short = marks.select("source", (F.col("k") - 1).alias("k"), "ends", "all").where("all or ends > 0")
    islands = short.where("all").withColumn("_first", F.col("k") - F.row_number().over(Window.partitionBy("source").orderBy("k")) + 1)
    reach = islands.select("source", "k", "_first", F.min("k").over(Window.partitionBy("source", "_first")).alias("_from"))
    reach = reach.join(short.where("not all").select("source", (F.col("k") + 1).alias("_from"), F.col("ends").alias("_reach")), ["source", "_from"], "left").select("source", "k", F.coalesce("_reach", F.lit(0)).alias("_reach"))
    # at the start of segment k - 1: the ends of k - 2, through an island if that is all line ends
    start = short.where("not all").select("source", (F.col("k") + 2).alias("k"), F.col("ends").alias("_reach")).unionByName(reach.select("source", (F.col("k") + 2).alias("k"), "_reach"))
    odd = (F.col("odd") + F.when(F.col("odd_all"), F.coalesce("_reach", F.lit(0))).otherwise(0)) % 2 == 1
    odds = work_table(marks.join(start, ["source", "k"], "left").where(odd).select("source", "k", F.lit(True).alias("odd")), "odd")
    return segments.join(odds, ["source", "k"], "left").withColumn("odd", F.coalesce("odd", F.lit(False)))


@dataclass
class Atoms:
    """A segment's atoms and its neighbours' ends': starts and stops, counted from the segment's own start; the first atom of
    each run; `of` is the text that positions count in, from -offset on."""

    starts: np.ndarray
    stops: np.ndarray
    runs: np.ndarray
    size: int
    overlap: int

    def __post_init__(self) -> None:
        n = len(self.starts)
        firsts = np.append(np.flatnonzero(self.runs), n)
        run_end = firsts[np.searchsorted(firsts, np.arange(n), side="right")]
        beyond = np.searchsorted(self.stops, self.starts + self.size, side="right")
        self.end = np.minimum(beyond, run_end)
        inner = self.end < run_end
        last = np.where(inner, self.end, 0)
        room = np.minimum(self.overlap, self.size - (self.stops[last] - self.starts[last]))
        follows = np.maximum(np.searchsorted(self.starts, self.starts[last] - room), np.arange(n) + 1)
        self.next = np.where(inner, follows, -1)

    def walk(self, at: int, stop: int) -> tuple[list[int], int]:
        """The atoms at which passages begin from one on, up to a position; and the first beyond it, or -1 where the run ends."""
        found = []
        while at >= 0 and self.starts[at] < stop:
            found.append(at)
            at = int(self.next[at])
        return found, at

    def stop_of(self, at: int) -> int:
        """Where the passage stops that begins with an atom."""
        return int(self.stops[self.end[at] - 1])


def atoms_of(text: str, before: str | None, after: str | None, odd: bool, size: int, overlap: int) -> Atoms:
    """The atoms of a segment in its neighbourhood."""
    whole = f"{before or ''}{text}{after or ''}"
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n, far = len(codes), 1 << 40
    goes_on = len(after or "") > 3 * size + 2  # else the document ends within what follows
    begin, end = (-far if before else 0), (n + far if goes_on else n)
    lines = np.flatnonzero(codes == 10)
    # of a run of line ends every second one begins a separator, from the first that isn't part of one
    first = np.append(True, np.diff(lines) > 1) if len(lines) else np.zeros(0, bool)
    run = np.cumsum(first) - 1
    place = lines - lines[first][run] if len(lines) else lines
    if odd and len(lines) and lines[0] == 0:
        place = place + (run == 0)
    followed = np.append(np.diff(lines) == 1, False) if len(lines) else first
    double = lines[(place % 2 == 0) & followed]
    found_starts, found_stops, found_levels, found_first = [], [], [], []
    starts = np.unique(np.append(begin, double))
    stops = np.append(starts[1:], end)
    fresh = starts == 0 if not before else np.zeros(len(starts), bool)
    for level, separators in enumerate((None, lines, np.flatnonzero(codes == 32), np.arange(n))):
        if separators is not None:
            inside = np.searchsorted(starts, separators, side="right") - 1
            here = separators[(inside >= 0) & (separators < stops[inside])] if len(starts) else separators[:0]
            parts = np.unique(np.append(starts, here))
            parent = np.searchsorted(starts, parts, side="right") - 1
            part_stops = np.minimum(np.append(parts[1:], far * 2), stops[parent]) if len(parts) else parts
            fresh = parts == starts[parent] if len(parts) else np.zeros(0, bool)
            starts, stops = parts, part_stops
        small = (stops - starts < size) if level < 3 else np.ones(len(starts), bool)
        found_starts.append(starts[small])
        found_stops.append(stops[small])
        found_levels.append(np.full(int(small.sum()), level))
        found_first.append(fresh[small])
        starts, stops = starts[~small], stops[~small]
    starts, stops, levels, fresh = (np.concatenate(x) for x in (found_starts, found_stops, found_levels, found_first))
    order = np.argsort(starts, kind="stable")
    starts, stops, levels, fresh = starts[order], stops[order], levels[order], fresh[order]
    real = (stops > 0) & (starts >= 0) & (starts < n)
    starts, stops, levels, fresh = starts[real], stops[real], levels[real], fresh[real]
    runs = fresh | np.append(True, np.diff(levels) != 0) if len(levels) else fresh
    offset = len(before or "")
    return Atoms(starts - offset, stops - offset, runs, size, overlap)


def _function(atoms: Atoms, length: int) -> tuple[bool, int, list[int], list[int]]:
    """A segment as a function: whether it is constant, what it gives without an entry, entries and what they give."""
    own = (atoms.starts >= 0) & (atoms.starts < length)
    begun = np.flatnonzero(atoms.runs & own)

    def leaves(at: int) -> int:
        beyond = atoms.walk(at, length)[1]
        return int(atoms.starts[beyond]) - length if beyond >= 0 else -1

    if len(begun):
        return True, leaves(int(begun[-1])), [], []
    at = np.flatnonzero(own & (atoms.starts < atoms.size))
    known: dict[int, int] = {}
    exits = []
    for i in at.tolist():
        passed, j = [], i
        while j >= 0 and atoms.starts[j] < length and j not in known:
            passed.append(j)
            j = int(atoms.next[j])
        value = known[j] if j in known else (int(atoms.starts[j]) - length if j >= 0 else -1)
        known.update(dict.fromkeys(passed, value))
        exits.append(value)
    return False, -1, atoms.starts[at].tolist(), exits


FUNCTION = "source string, k long, constant boolean, otherwise int, entries array<int>, exits array<int>"


def _functions(segments: DataFrame, size: int, overlap: int) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, k, text, before, after, odd in batch[["source", "k", "text", "before", "after", "odd"]].itertuples(index=False):
                rows.append((source, k, *_function(atoms_of(text, before, after, odd, size, overlap), len(text))))
            yield pd.DataFrame(rows, columns=["source", "k", "constant", "otherwise", "entries", "exits"])

    return segments.select("source", "k", "text", "before", "after", "odd").mapInPandas(each, FUNCTION)


def _applied(row: tuple, entry: int) -> int:
    constant, otherwise, entries, exits = row
    if constant or entry < 0:
        return otherwise
    return dict(zip(entries, exits)).get(entry, -1)


def _rows(family: pd.DataFrame) -> list[tuple]:
    """The functions of a family, in order."""
    family = family.sort_values("k")
    return [(k, (c, o, list(e), list(x))) for k, c, o, e, x in family[["k", "constant", "otherwise", "entries", "exits"]].itertuples(index=False)]


def _composed(family: pd.DataFrame) -> pd.DataFrame:
    """A family's functions as one."""
    rows = _rows(family)

    def through(entry: int, rows: list[tuple]) -> int:
        for _, row in rows:
            entry = _applied(row, entry)
        return entry

    last = max((i for i, (_, row) in enumerate(rows) if row[0]), default=-1)
    if last >= 0:
        found = (True, through(-1, rows[last:]), [], [])
    else:
        entries = rows[0][1][2]
        reached = {e: e for e in entries}
        for _, row in rows:
            step = dict(zip(row[2], row[3]))
            reached = {e: step.get(x, -1) if x >= 0 else row[1] for e, x in reached.items()}
        found = (False, through(-1, rows), entries, [reached[e] for e in entries])
    return pd.DataFrame([(family["source"].iloc[0], int(family["_family"].iloc[0]), *found)], columns=["source", "k", "constant", "otherwise", "entries", "exits"])


def _told(family: pd.DataFrame) -> pd.DataFrame:
    """The entries of a family's members, from its own."""
    rows, entry, found = _rows(family), int(family["entry"].iloc[0]), []
    for k, row in rows:
        found.append((family["source"].iloc[0], k, entry))
        entry = _applied(row, entry)
    return pd.DataFrame(found, columns=["source", "k", "entry"])


def entries_of(functions: DataFrame, members: int = FAMILY) -> DataFrame:
    """source, k, entry: where packing enters every segment; -1 where it doesn't, as at a document's start."""
    most = functions.agg(F.max("k")).first()[0]
    family = F.floor(F.col("k") / members)
    if most is None or most < members:
        above = functions.select("source", F.lit(0).cast("long").alias("_family"), F.lit(-1).alias("entry")).distinct()
    else:
        composed = work_table(functions.withColumn("_family", family).groupBy("source", "_family").applyInPandas(_composed, FUNCTION), "functions")
        above = entries_of(composed, members).select("source", F.col("k").alias("_family"), "entry")
    joined = functions.withColumn("_family", family).join(above, ["source", "_family"])
    return joined.groupBy("source", "_family").applyInPandas(_told, "source string, k long, entry int")


class Sliced:
    """A segment in its neighbourhood, with the passages that begin in it."""

    def __init__(self, text: str, before: str | None, after: str | None, odd: bool, size: int, overlap: int) -> None:
        self.whole, self.offset, self.length = f"{before or ''}{text}{after or ''}", len(before or ""), len(text)
        self.atoms = atoms_of(text, before, after, odd, size, overlap)

    def passages(self, entry: int) -> Iterator[tuple[int, str]]:
        """Where each begins, from the segment's start, and its text; `entry` is where packing enters."""
        atoms = self.atoms
        heads = np.flatnonzero(atoms.runs & (atoms.starts >= 0) & (atoms.starts < self.length)).tolist()
        if entry >= 0:
            heads.insert(0, int(np.searchsorted(atoms.starts, entry)))
        for head in heads:
            for at in atoms.walk(head, self.length)[0]:
                raw = self.whole[self.offset + int(atoms.starts[at]) : self.offset + atoms.stop_of(at)]
                if passage := raw.strip():
                    yield int(atoms.starts[at]) + len(raw) - len(raw.lstrip()), passage


def entered(near: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, members: int = FAMILY) -> DataFrame:
    """Adds entry to segments with their neighbours."""
    entries = entries_of(work_table(_functions(near, size, overlap), "functions"), members)
    return near.join(work_table(entries, "entries"), ["source", "k"])


def numbered(passages: DataFrame) -> DataFrame:
    """source, k, first_ix from passages (source, k): the number of the first passage that begins in a segment."""
    counts = passages.groupBy("source", "k").agg(F.count("*").alias("n"))
    return placed_by(counts, ["k"], F.floor(F.col("k") / BUCKET), F.col("n"), "first_ix").select("source", "k", "first_ix")


def passages_of(segments: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, segment: int = SEGMENT, members: int = FAMILY) -> DataFrame:
    """source, chunk_ix, start, text from segments (source, k, text): a document's passages in order, and where in the
    document each begins."""

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, k, text, before, after, odd, entry in batch[["source", "k", "text", "before", "after", "odd", "entry"]].itertuples(index=False):
                found = Sliced(text, before, after, odd, size, overlap).passages(entry)
                yield pd.DataFrame([(source, k, i, k * segment + at, passage) for i, (at, passage) in enumerate(found)], columns=["source", "k", "i", "start", "text"])

    near = entered(with_neighbours(segments, size), size, overlap, members)
    found = work_table(near.select("source", "k", "text", "before", "after", "odd", "entry").mapInPandas(written, "source string, k long, i int, start long, text string"), "passages")
    return found.join(numbered(found), ["source", "k"]).select("source", (F.col("first_ix") + F.col("i")).alias("chunk_ix"), "start", "text")

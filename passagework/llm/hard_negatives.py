"""Hard-negative mining by distributed radix selection.

Anchors ask for their nearest rows of the same label (positives), then, for every positive, for the nearest rows of other
labels whose scores lie in a window below the positive's. Scores are inner products of whole-number vectors.

Nothing is sorted to find the k best of a window. A scan counts the window's rows by digit (equal intervals of the
score), the counts of all tasks are summed by Spark, and the digit in which the k-th row lies becomes the next scan's
interval: digit by digit until it holds at most FEW rows. Where more than FEW rows share the k-th score itself, their ids'
digits go on in the same way. A last scan then gathers the rows from that digit up, at most k + FEW a window, and only
these are ranked.

Anchors go in blocks of about ANCHORS, each broadcast to scans of all rows; a block's intervals and the one digit chosen
for each window are all that the driver sees. A block's result is written before the next begins.

Rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors of other lengths count as
if zeros followed. Rows with an anchor's id are the anchor, and no positives of it; repeated anchors are answered each.
Ties of scores go by the smaller id; rows that repeat an id are each counted. Scores are exact up to 2 ** 53. Empty
tables, tables without anchors, and windows without rows give no rows. Further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path

#: Anchors of a block, about; rows that are scored against them at a time.
ANCHORS, CHUNK = 2_048, 1_024
#: Digits of an interval, for one window an anchor and for several.
DIGITS_ALONE, DIGITS = 1_024, 128
#: A digit of so many rows at most isn't taken apart any further.
FEW = 64
SCALE = 256.0


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.select("vec_id", "label", "embedding").where("vec_id is not null and label is not null and embedding is not null").where(finite)


def _matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Whole-number vectors, one a row, as doubles; shorter ones end in zeros."""
    values, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum([0, *(lists.value_lengths().to_numpy(zero_copy_only=False))])
    values, lengths = np.floor(SCALE * values), np.diff(ends).astype(int)
    width = max(width, lengths.max(initial=0))
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    found = np.zeros((len(lengths), width))
    for i, n in enumerate(lengths):
        found[i, :n] = values[ends[i] : ends[i] + n]
    return found


@dataclass
class Windows:
    """A block's anchors and their windows, by [anchor, window]. While a window is open, the k-th row lies in the interval
    from `low` to `high` of the scores, or, where `score` is set, of the complements of the ids that have that score."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    same: bool
    first: np.ndarray
    last: np.ndarray
    k: int
    digits: int
    few: int = FEW
    low: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)
    score: np.ndarray = field(init=False)
    by_id: np.ndarray = field(init=False)
    need: np.ndarray = field(init=False)
    open: np.ndarray = field(init=False)
    #: Rows qualify above `cut`, and at `cut` up to the id `cut_id`.
    cut: np.ndarray = field(init=False)
    cut_id: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.low, self.high = self.first.copy(), self.last.copy()
        self.open = self.first <= self.last
        self.by_id, self.score = np.zeros_like(self.open), np.zeros_like(self.first)
        self.need = np.full_like(self.first, self.k)
        self.cut, self.cut_id = self.first - 1, np.full_like(self.first, np.iinfo(np.int64).min)

    def step(self) -> np.ndarray:
        """How many values a digit of each window spans."""
        span = self.high.astype(np.uint64) - self.low.astype(np.uint64)
        return span // np.uint64(self.digits) + np.uint64(1)

    def narrow(self, window: np.ndarray, digit: np.ndarray, count: np.ndarray, above: np.ndarray, ids: tuple[int, int]) -> None:
        """Go on with the digits in which the k-th rows lie; windows that aren't named have fewer than k rows and are done."""
        step, n = self.step(), self.first.shape[1]
        named = np.zeros_like(self.open)
        for w, d, c, before in zip(window.tolist(), digit.tolist(), count.tolist(), above.tolist()):
            at = divmod(w, n)
            named[at] = True
            self.need[at] -= before
            low = int(self.low[at]) + d * int(step[at])
            high = min(int(self.high[at]), low + int(step[at]) - 1)
            if self.by_id[at]:
                if c <= self.few or low == high:
                    self.open[at], self.cut[at], self.cut_id[at] = False, self.score[at], ~low
            elif c <= self.few:
                self.open[at], self.cut[at] = False, low - 1
            elif low == high:
                self.by_id[at], self.score[at] = True, low
                low, high = ~ids[1], ~ids[0]
            self.low[at], self.high[at] = low, high
        short = self.open & ~named
        self.open[short] = False
        # of ids, all that have the score qualify
        self.cut[short & self.by_id] = self.score[short & self.by_id] - 1

    def pairs(self, batches: Iterator[pa.RecordBatch], least: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, anchors' places and scores of the pairs of the wanted kind whose scores an anchor's windows can use."""
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            rows = _matrix(batch.column(2), self.vectors.shape[1])
            anchors = np.pad(self.vectors, ((0, 0), (0, rows.shape[1] - self.vectors.shape[1]))).T
            for i in range(0, len(ids), CHUNK):
                scores = rows[i : i + CHUNK] @ anchors
                wanted = (scores >= least) & (scores <= most)
                alike = labels[i : i + CHUNK, None] == self.labels
                wanted &= (alike & (ids[i : i + CHUNK, None] != self.ids)) if self.same else ~alike
                row, anchor = np.nonzero(wanted)
                if len(row):
                    yield ids[i + row], anchor, scores[row, anchor].astype(np.int64)

    def counts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """window, digit, n: how many of a task's rows lie in each digit of the open windows."""
        n, digits, step = self.first.shape[1], self.digits, self.step()
        floor = np.where(self.by_id, self.score, self.low)
        ceiling = np.where(self.by_id, self.score, self.high)
        least = np.where(self.open, floor, np.iinfo(np.int64).max).min(1).astype(float)
        most = np.where(self.open, ceiling, np.iinfo(np.int64).min).max(1).astype(float)
        total = np.zeros(self.first.size * digits, dtype=np.int64)
        for ids, anchor, scores in self.pairs(batches, least, most):
            for j in range(n):
                value = np.where(self.by_id[anchor, j], ~ids, scores)
                here = self.open[anchor, j] & (scores >= floor[anchor, j]) & (scores <= ceiling[anchor, j])
                here &= (value >= self.low[anchor, j]) & (value <= self.high[anchor, j])
                at = anchor[here]
                digit = (value[here].astype(np.uint64) - self.low[at, j].astype(np.uint64)) // step[at, j]
                np.add.at(total, (at * n + j) * digits + digit.astype(np.int64), 1)
        found = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (found // digits, found % digits, total[found])], ["window", "digit", "n"])

    def gathered(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """window, vec_id, score of the rows that qualify; of a chunk of rows the k best a window, at most."""
        n = self.first.shape[1]
        some = self.first <= self.last
        least = np.where(some, np.maximum(self.cut, self.first), np.iinfo(np.int64).max).min(1).astype(float)
        most = np.where(some, self.last, np.iinfo(np.int64).min).max(1).astype(float)
        for ids, anchor, scores in self.pairs(batches, least, most):
            for j in range(n):
                cut = self.cut[anchor, j]
                here = (scores >= self.first[anchor, j]) & (scores <= self.last[anchor, j]) & ((scores > cut) | ((scores == cut) & (ids <= self.cut_id[anchor, j])))
                window, vec_id, score = anchor[here] * n + j, ids[here], scores[here]
                order = np.lexsort((vec_id, -score, window))
                window, vec_id, score = window[order], vec_id[order], score[order]
                place = np.arange(len(window)) - np.searchsorted(window, window)
                best = place < self.k
                if best.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[best], pa.int64()) for x in (window, vec_id, score)], ["window", "vec_id", "score"])


def select(rows: DataFrame, windows: Windows, ids: tuple[int, int]) -> DataFrame:
    """window, vec_id, score, rank: the k best rows of every window (window = anchor's place * windows an anchor + place)."""
    context = rows.sparkSession.sparkContext
    while windows.open.any():
        sent = context.broadcast(windows)
        counted = rows.mapInArrow(lambda batches, sent=sent: sent.value.counts(batches), "window long, digit long, n long")
        summed = counted.groupBy("window", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("window").orderBy(F.desc("digit")))
        need = rows.sparkSession.createDataFrame(pa.table({"window": np.flatnonzero(windows.open), "need": windows.need[windows.open]}))
        reached = summed.withColumn("upto", upto).join(F.broadcast(need), "window").where("upto >= need and upto - n < need")
        found = reached.select("window", "digit", "n", (F.col("upto") - F.col("n")).alias("above")).toPandas()
        windows.narrow(*(found[c].to_numpy() for c in ("window", "digit", "n", "above")), ids)
        sent.destroy()
    sent = context.broadcast(windows)
    best = rows.mapInArrow(lambda batches, sent=sent: sent.value.gathered(batches), "window long, vec_id long, score long")
    order = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= windows.k)


def mine(
    rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100), anchors: int = ANCHORS,
    digits: tuple[int, int] = (DIGITS_ALONE, DIGITS), few: int = FEW,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from rows (vec_id, label, embedding).

    Anchors are the rows whose id is divisible by `every`. A window goes from low[0] / low[1] of the positive's score up
    to it. `anchors`, `digits` and `few` change the scans and not the result."""
    spark, rows = rows.sparkSession, usable(rows)
    anchor = F.col("vec_id") % every == 0
    square = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + F.pow(F.floor(x.cast("double") * SCALE), F.lit(2.0)))
    known = rows.agg(F.count_if(anchor).alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"), F.max(square).alias("square")).first()
    path, schema = new_path(spark, "hard-negatives"), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    blocks = -(-known.n // anchors)
    if blocks:
        dealt = rows.where(anchor).repartition(blocks).withColumn("block", F.spark_partition_id())
        dealt.write.partitionBy("block").parquet(f"{path}/anchors")
    for block in range(blocks):
        asking = spark.read.parquet(f"{path}/anchors").where(F.col("block") == block).select("vec_id", "label", "embedding").toArrow().combine_chunks()
        if not len(asking):
            continue
        ids, labels = (asking[c].to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        vectors = _matrix(asking["embedding"].combine_chunks())
        # no score is larger than the product of the lengths
        reach = np.minimum(np.ceil(np.sqrt((vectors**2).sum(1)) * np.sqrt(known.square)) + 1, 2.0**62).astype(np.int64)[:, None]
        near = select(rows, Windows(ids, labels, vectors, True, -reach, reach, positives, digits[0], few), (known.first, known.last)).toPandas()
        first, last = np.ones((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
        positive = np.zeros((len(ids), positives), np.int64)
        at = (near.window.to_numpy(), near["rank"].to_numpy() - 1)
        first[at], last[at], positive[at] = -(-low[0] * near.score.to_numpy() // low[1]), near.score, near.vec_id
        found = select(rows, Windows(ids, labels, vectors, False, first, last, negatives, digits[1], few), (known.first, known.last))
        asked = spark.createDataFrame(pa.table({"window": np.arange(last.size), "anchor_id": np.repeat(ids, positives), "positive_id": positive.ravel(), "positive_score": last.ravel()}))
        named = found.join(F.broadcast(asked), "window").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        named.write.mode("append").parquet(f"{path}/found")
    return spark.read.schema(schema).parquet(f"{path}/found") if blocks else spark.createDataFrame([], schema)


def mined(embeddings: DataFrame, **options) -> DataFrame:
    """The hard negatives of a table of embeddings in which every seventh label is off by one; options as `mine` has."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings.select("vec_id", label.alias("label"), "embedding"), **options)

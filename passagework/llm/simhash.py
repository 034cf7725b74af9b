"""SimHash near-duplicates through a pivot distance table.

Fingerprints. Whole text, A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of three words (repeats included), XXH64
with seed 42. A bit is 1 if it is set in over half the hashes. No words: fingerprint zero.

Links (fingerprints that differ in two bits or fewer) are sought among distinct fingerprints, so copies cost nothing.
The pivot table holds a fingerprint's Hamming distances to 97 references:

- an origin and its 64 neighbours (the origin with one bit turned over), in four groups of 16. A neighbour is a bit
  nearer or further than the origin; two fingerprints two bits apart or less have the same 16 relative coordinates in at
  least two of the groups, so an equality join on each of the six pairs of groups proposes all links;
- 32 scattered references. A pair whose coordinates differ by more than two anywhere is discarded (the maximum
  coordinate difference is a lower bound of the distance); survivors are verified by their exact distance.

A coordinate group of more than HOT fingerprints isn't paired off. There each fingerprint takes the place of itself and
of its one-bit neighbours, among the 32 bits that the group leaves free; those that meet in a place are two bits apart
or less, and each links to the smallest there. That joins the same components with 33 rows a fingerprint.

Nulls: a null text has no words. A null doc_id is never a group's smallest, unless all are null. Repeated rows and ties
get the same component. Empty tables give empty results. Further columns pass through `deduplicate`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import never_null, table, whole, whole_row
from .components import components

SEED, SHINGLE, MAX_BITS = 42, 3, 2
#: Groups of coordinates larger than this are linked by shared neighbours rather than by pairs.
HOT = 32
#: Bytes of text that are worked on at a time; longer texts are taken in blocks that overlap by a shingle.
TEXT_BLOCK = 1 << 20

GROUPS, WIDTH = 4, 16
PAIRS = [(a, b) for a in range(GROUPS) for b in range(a + 1, GROUPS)]
_random = np.random.default_rng(SEED)
ORIGIN = np.uint64(_random.integers(0, 2**64, dtype=np.uint64))
NEIGHBOURS = ORIGIN ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
SCATTERED = _random.integers(0, 2**64, 32, dtype=np.uint64)

#: The eight bits of every byte value, the lowest first.
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > TEXT_BLOCK:
            found = _BLANK.search(data, at + TEXT_BLOCK)
            end = found.end() if found else end
        yield data[at:end].split()
        at = end


def ones_of(hashes: np.ndarray) -> np.ndarray:
    """In how many of the 64-bit hashes each bit is set."""
    columns = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        return np.unpackbits(columns, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])


def majority(ones: np.ndarray, total: int) -> int:
    """The bits that are set in over half the hashes."""
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text."""
    hashing = xxhash.xxh64_intdigest
    ones, total, carry = np.zeros(64, dtype=np.int64), 0, []
    for words in _word_blocks((text or "").encode("utf-8", "replace").lower()):
        words = carry + words
        if len(words) >= SHINGLE:
            hashes = np.array([hashing(b" ".join(x), SEED) for x in zip(words, words[1:], words[2:])], dtype="<u8")
            total += len(hashes)
            ones += ones_of(hashes)
        carry = words[-(SHINGLE - 1) :]
    if not total:
        return hashing(b" ".join(carry), SEED) if carry else 0
    return majority(ones, total)


@F.pandas_udf(LongType())
def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def relative_to_origin(prints: np.ndarray) -> np.ndarray:
    """64 coordinates of every fingerprint: whether the origin's neighbours are nearer than the origin is."""
    return np.bitwise_count(prints[:, None] ^ NEIGHBOURS) < np.bitwise_count(prints ^ ORIGIN)[:, None]


def pivot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of fingerprints: one row for each pair of groups, with the join key and the packed scattered distances."""
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        near = relative_to_origin(prints)
        relative = np.packbits(near, axis=1, bitorder="little").view("<u2").astype(np.int64)
        far = np.bitwise_count(prints[:, None] ^ SCATTERED).astype(np.uint8).view("<i8")
        n = len(prints)
        key = np.concatenate([(k << 32) | (relative[:, a] << 16) | relative[:, b] for k, (a, b) in enumerate(PAIRS)] if n else [np.zeros(0, np.int64)])
        columns = [np.tile(prints.view(np.int64), len(PAIRS)), key, *(np.tile(far[:, i], len(PAIRS)) for i in range(4))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["fp", "key", "far0", "far1", "far2", "far3"])


def _far_apart(a: str, b: str) -> Column:
    """The largest difference of the scattered coordinates."""
    at = lambda side, i: F.shiftrightunsigned(F.col(f"{side}.far{i // 8}"), 8 * (i % 8)).bitwiseAND(255)
    return F.greatest(*(F.abs(at(a, i) - at(b, i)) for i in range(len(SCATTERED))))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(prints: DataFrame) -> DataFrame:
    """From distinct fingerprints (fp): links (u, v) that join all fingerprints MAX_BITS or fewer bits apart."""
    rows = prints.select("fp").mapInArrow(pivot_rows, "fp long, key long, far0 long, far1 long, far2 long, far3 long")
    rows = table(rows, "pivots")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = table(rows.join(sizes, "key"), "pivots-shared")
    few = shared.where(F.col("size") <= HOT)
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (_far_apart("a", "b") <= MAX_BITS) & (_distance("a.fp", "b.fp") <= MAX_BITS)
    paired = few.alias("a").join(few.alias("b"), near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))

    places = F.lit(None)
    for k, pair in enumerate(PAIRS):
        free = [F.lit(0)] + [F.lit(int(np.uint64(1 << bit).astype(np.int64))) for g in range(GROUPS) if g not in pair for bit in range(g * WIDTH, (g + 1) * WIDTH)]
        places = F.when(F.shiftright("key", 32) == k, F.array(*(m.cast("long") for m in free))).otherwise(places)
    turned = shared.where(F.col("size") > HOT).select("fp", "key", F.explode(places).alias("mask"))
    turned = turned.select("fp", "key", F.col("fp").bitwiseXOR(F.col("mask")).alias("place"))
    least = turned.groupBy("key", "place").agg(F.min("fp").alias("least"), F.count("*").alias("met")).where("met > 1")
    starred = turned.join(least, ["key", "place"]).where("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    return paired.unionByName(starred).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp, text_hash, root, component_id of every document: component_id is the smallest doc_id of its component,
    root tells components apart whose documents have no doc_id."""
    rows = table(docs.select("doc_id", F.xxhash64(whole("text")).alias("text_hash"), simhash(whole("text")).alias("fp")), "simhash")
    prints = table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(prints)).withColumnRenamed("node", "fp")
    prints = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = prints.groupBy("root").agg(F.min("first").alias("component_id"))
    named = table(prints.join(smallest, "root").select("fp", "root", "component_id"), "simhash-classes")
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id (of equal ids the smallest text hash), with
    all its columns."""
    found = classes(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = found.groupBy("root").agg(F.min(F.struct(F.col("text_hash").alias("_text"), never_null("doc_id").alias("_doc"))).alias("_")).select("_.*")
    rows = docs.select(whole_row(docs), never_null("doc_id").alias("_doc"), F.xxhash64(whole("text")).alias("_text"))
    return rows.join(keep, ["_doc", "_text"], "left_semi").dropDuplicates(["_doc", "_text"]).select("_row.*")

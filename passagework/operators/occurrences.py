"""Where in a document of any size a passage first occurs, and the pages under it.

Every passage has a key: the hash of its first P code points, P the largest power of two that it is long. A scan of the
segments hashes all windows of these lengths (differences of running polynomial hashes, whole segments at a time) and
keeps the places of those that a filter of all keys lets through; of windows in a segment that go on alike the first. What is
kept are numbers; they meet the passages by document and key. The places that may so be earlier than a passage's own are
read once more: the digest of the whole passage decides, and the smallest place wins. No text is shuffled but that of segments
with such places, once, where these are too many to be broadcast. The filter holds three bits a key, all in one bitmap, and
MOST_BITS bits at most; past that it lets more through, and loses none.

Pages: passages and blocks meet by bins of BIN code points, so that no document's blocks are compared with all its passages.

Nulls: a null or empty passage occurs nowhere. Equal passages of a document get the same place, the first; passages are equal
whose lengths and 128-bit digests (BLAKE2b) are. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CHUNK_OVERLAP, CHUNK_SIZE
from ..sources.work import work_table
from .segments import SEGMENT, Sliced, with_neighbours

#: Bits of one bitmap (fixed by `bitmap_construct_agg`), bits a key, and bits of the whole filter at most (64 MB).
BITMAP, BITS_A_KEY, MOST_BITS = 32_768, 32, 1 << 29
#: The bits of a key that choose a bitmap, and where those stand that choose its three bits there.
WHICH, PROBES = 14, (14, 29, 44)
#: Code points of a bin of blocks.
BIN = 1 << 14
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@lru_cache(4)
def _powers(n: int, base: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, dtype=np.uint64))


class Hashes:
    """The hashes of a text's windows: differences of a running sum of code times power, divided by the power of the window's
    place (BASE is odd, so it has an inverse)."""

    def __init__(self, text: str) -> None:
        codes = _codes(text)
        self.n, room = len(codes), 1 << len(codes).bit_length()
        self.inverse = _powers(room, int(INVERSE))
        self.running = np.append(np.uint64(0), np.cumsum((codes + np.uint64(1)) * _powers(room, int(BASE))[: self.n], dtype=np.uint64))

    def all(self, n: int) -> np.ndarray:
        """Of all windows of a length."""
        return _mixed((self.running[n:] - self.running[: self.n + 1 - n]) * self.inverse[: self.n + 1 - n]) if n <= self.n else self.running[:0]

    def at(self, places: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Of the windows at some places."""
        return _mixed((self.running[places + n] - self.running[places]) * self.inverse[places])


@lru_cache(1024)
def _document(source: str) -> np.uint64:
    return np.frombuffer(blake2b((source or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), dtype=np.uint64)[0]


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _keys(source: str, hashes: Hashes, places: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of passages at some places of a text: how many code points their keys cover, and the keys."""
    n = np.left_shift(1, np.frexp(lengths)[1].astype(np.int64) - 1)
    return n, (hashes.at(places, n) ^ _document(source) ^ n.astype(np.uint64)).view(np.int64)


def keyed(passages: DataFrame) -> DataFrame:
    """Distinct passages (source, text) with length, n, key and digest."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_keys(s, Hashes(t), np.zeros(1, np.int64), np.array([len(t)])) for s, t in zip(batch["source"], batch["text"])]
            yield pd.DataFrame({"source": batch["source"], "text": batch["text"], "length": batch["text"].map(len), "n": [int(n[0]) for n, _ in found], "key": [int(key[0]) for _, key in found], "digest": batch["text"].map(_digest)})

    return passages.where("text <> ''").select("source", "text").distinct().mapInPandas(each, "source string, text string, length int, n int, key long, digest binary")


def _filter(keys: DataFrame) -> np.ndarray:
    """Bitmaps of the keys, as bytes, one to a row; their size is bounded, whatever the number of keys."""
    most = min(MOST_BITS // BITMAP, max(1, -(-keys.count() * BITS_A_KEY // BITMAP)))
    bitmaps = min(1 << (most - 1).bit_length(), 1 << WHICH)
    bits = F.array(*(F.shiftrightunsigned("key", p).bitwiseAND(BITMAP - 1) for p in PROBES))
    dealt = keys.select(F.col("key").bitwiseAND(bitmaps - 1).alias("no"), bits.alias("bits")).repartition("no")
    rows = dealt.select("no", F.explode("bits").alias("bit")).groupBy("no").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    found = np.zeros((bitmaps, BITMAP // 8), dtype=np.uint8)
    for row in rows:
        found[row.no] = np.frombuffer(row.bits, dtype=np.uint8)
    return found


def _maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The places of the keys that the filter lets through."""
    places = np.arange(len(keys))
    for probe in PROBES:
        bit = (keys[places] >> np.uint64(probe)) & np.uint64(BITMAP - 1)
        places = places[bits[(keys[places] & np.uint64(len(bits) - 1)).astype(np.int64), (bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1]
    return places


def earlier(near: DataFrame, wanted: DataFrame, size: int = CHUNK_SIZE, segment: int = SEGMENT) -> DataFrame:
    """source, length, digest, first of the wanted passages (source, length, n, key, digest, start) that occur in their documents
    (segments with what comes after) before their start (anywhere, if that is null): the smallest such place."""
    sent = near.sparkSession.sparkContext.broadcast(_filter(wanted.select("key").distinct()))
    lengths = sorted(row.n for row in wanted.select("n").distinct().collect())

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = sent.value
        for batch in batches:
            for source, k, text, after in batch[["source", "k", "text", "after"]].itertuples(index=False):
                hashes, document = Hashes(f"{text}{after or ''}"), _document(source)
                found, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for n in lengths:
                    keys = hashes.all(n)[: len(text)] ^ document ^ np.uint64(n)
                    places, far = _maybe(bits, keys), min(size, 2 * n - 1)
                    inside = places + far <= hashes.n
                    _, first = np.unique(hashes.at(places[inside], far), return_index=True)
                    places = np.concatenate([places[inside][first], places[~inside]])
                    found.append(keys[places].view(np.int64))
                    at.append(places + k * segment)
                yield pd.DataFrame({"source": source, "key": np.concatenate(found), "at": np.concatenate(at)})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, k, text, after, asked in batch[["source", "k", "text", "after", "asked"]].itertuples(index=False):
                whole = f"{text}{after or ''}"
                rows = [(source, x["length"], x["digest"], x["at"]) for x in asked if _digest(whole[x["at"] - k * segment :][: x["length"]]) == bytes(x["digest"])]
                yield pd.DataFrame(rows, columns=["source", "length", "digest", "first"])

    places = near.select("source", "k", "text", "after").mapInPandas(kept, "source string, key long, at long")
    met = places.join(wanted, ["source", "key"]).where("start is null or at < start")
    asked = met.groupBy("source", F.floor(F.col("at") / segment).alias("k")).agg(F.collect_list(F.struct("length", "digest", "at")).alias("asked"))
    rows = near.select("source", "k", "text", "after").join(work_table(asked, "asked"), ["source", "k"]).mapInPandas(read, "source string, length int, digest binary, first long")
    return rows.groupBy("source", "length", "digest").agg(F.min("first").alias("first"))


def first_occurrences(segments: DataFrame, passages: DataFrame, size: int = CHUNK_SIZE, segment: int = SEGMENT) -> DataFrame:
    """source, text, first of every distinct passage (source, text; at most `size` code points) that occurs in its document
    (segments source, k, text): the code point at which it does so for the first time."""
    wanted = work_table(keyed(passages), "keyed")
    found = earlier(with_neighbours(segments, size), wanted.drop("text").withColumn("start", F.lit(None).cast("long")), size, segment)
    return wanted.join(found, ["source", "length", "digest"]).select("source", "text", "first")


def placed(entered: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, segment: int = SEGMENT) -> DataFrame:
    """source, k, i, start, length, n, key, digest of the passages that begin in segments with their entries: no texts."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, k, text, before, after, odd, entry in batch[["source", "k", "text", "before", "after", "odd", "entry"]].itertuples(index=False):
                sliced = Sliced(text, before, after, odd, size, overlap)
                rows = [*sliced.passages(entry)]
                starts, lengths = np.array([at for at, _ in rows], dtype=np.int64), np.array([len(p) for _, p in rows], dtype=np.int64)
                n, keys = _keys(source, Hashes(sliced.whole), starts + sliced.offset, lengths)
                yield pd.DataFrame({"source": source, "k": k, "i": np.arange(len(rows)), "start": starts + k * segment, "length": lengths, "n": n, "key": keys, "digest": [_digest(p) for _, p in rows]})

    return entered.select("source", "k", "text", "before", "after", "odd", "entry").mapInPandas(each, "source string, k long, i int, start long, length int, n int, key long, digest binary")


def _binned(rows: DataFrame, start: str, stop: str) -> DataFrame:
    return rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor((F.col(stop) - 1) / BIN))))


def pages_under(passages: DataFrame, blocks: DataFrame) -> DataFrame:
    """source, first, length, page_list of places (source, first, length): the distinct pages, sorted, of the blocks (source,
    start, stop, pages) that a passage there overlaps. A place without blocks is left out."""
    left = _binned(passages.select("source", "first", "length", (F.col("first") + F.col("length")).alias("_stop")).distinct(), "first", "_stop")
    right = _binned(blocks.where("stop > start").select("source", F.col("start").alias("_s"), F.col("stop").alias("_e"), "pages"), "_s", "_e")
    met = left.join(right, ["source", "_bin"]).where("_s < _stop and _e > first")
    return met.select("source", "first", "length", F.explode("pages").alias("_page")).groupBy("source", "first", "length").agg(F.array_sort(F.collect_set("_page")).alias("page_list"))

"""Vector best-fit packing of tokenised documents into sequences.

A document is its token ids and a closing id. Only documents longer than a sequence are cut, into whole sequences and a
rest. A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). Pieces
go in by decreasing length, each into the open sequence that fits it under every constraint and whose weighted residual
norm is then smallest; where none fits, a new one opens.

Whole-sequence pieces need no search. The others are dealt by hash into groups of about GROUP_TOKENS tokens and GROUP_ROWS
pieces at most, each packed by itself: a group's memory is bounded, and what it wastes is its last sequences, a few of thousands.

Tokenising goes word by word through a bounded cache: the tokenizer never joins text across white space, so a text's ids
are its words' ids in a row. Texts stream through in blocks; no piece needs more than a block in memory.

Nulls: a null text is empty and gives the closing id alone; a null doc_id passes through. Repeated rows are packed each.
Ties of length go by doc_id, piece and row. Empty tables give empty results. Further columns aren't read.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .simhash import TEXT_BLOCK, _word_blocks

SEQUENCE, CLOSING = 4096, 1
#: What a sequence may hold, and how much an unused share of each capacity weighs in the residual norm.
MAX_DOCS, MAX_COST = SEQUENCE, SEQUENCE * SEQUENCE
WEIGHTS = (1.0, 0.01, 0.01)
GROUP_TOKENS, GROUP_ROWS = 16_000_000, 200_000
#: Words whose ids a worker remembers at most, and the longest that isn't left to the whole tokenizer.
CACHED_WORDS, LONGEST_PLAIN = 800_000, 64
#: Texts of an Arrow batch that are Python objects at a time.
ROWS_AT_ONCE = 512

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCoder:
    """The ids of white-space separated words as little-endian unsigned 32-bit numbers, through a bounded memory.

    Words of letters, perhaps with punctuation after them, are most of a text. Their letters go through the vocabulary's
    merges many at a time, parted by spaces; anything else goes through the whole tokenizer.
    """

    PUNCTUATION = b".,;:!?%#$&*|"
    #: Letters that every normalisation form leaves alone and whose lower case is one letter.
    PLAIN = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str, most: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)  # the same model, without a normaliser
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.most = most
        self.tails: dict[bytes, bytes] = {}

    def _each(self, words: list[bytes]) -> list[bytes]:
        found = self.whole.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found]

    def _letters(self, words: list[bytes]) -> list[bytes]:
        found = np.array(self.merges.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        data, cuts = found.tobytes(), (4 * np.flatnonzero(self.ends[found]) + 4).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def _core(self, word: bytes) -> bytes | None:
        """The lower-cased letters of a word that is letters and then punctuation; None for others."""
        core = word.rstrip(self.PUNCTUATION)
        if core.isalpha() and len(core) <= LONGEST_PLAIN:  # ASCII
            return core.lower()
        text = core.decode("utf-8", "replace") if len(core) <= LONGEST_PLAIN else ""
        return text.lower().encode() if self.PLAIN.fullmatch(text) else None

    def learn(self, lists: Iterable[list[bytes]]) -> None:
        """Make sure that the words of these lists are known. A full memory keeps what came first: the frequent words."""
        known = self.known
        words = set().union(*lists)
        new = words.difference(known)
        if len(known) + len(new) > self.most:
            first = dict(islice(known.items(), self.most // 2))
            known.clear()
            known.update(first)
            new = words.difference(known)
        if not new:
            return
        cores = dict(zip(new, map(self._core, new)))
        rest = [word for word, core in cores.items() if core is None]
        known.update(zip(rest, self._each(rest)))
        plain, letters = list({core for core in cores.values() if core is not None}), {}
        for i in range(0, len(plain), 4096):
            letters.update(zip(plain[i : i + 4096], self._letters(plain[i : i + 4096])))
        tails = self.tails
        for word, core in cores.items():
            if core is not None:
                tail = word[len(core) :]
                if not tail:
                    known[word] = letters[core]
                elif tail in tails:
                    known[word] = letters[core] + tails[tail]
                else:
                    known[word] = letters[core] + self._each([tail])[0]
                    if len(tails) < 1000:
                        tails[tail] = self._each([tail])[0]

    def encode(self, words: list[bytes]) -> bytes:
        """The ids of words that have been learnt."""
        return b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=1)
def _coder(path: str, most: int) -> WordCoder:
    return WordCoder(path, most)


def _lowered(text: str | None) -> bytes:
    """A text's bytes, A-Z lower-cased, as the tokenizer does itself, so that more words are known.

    Not where that might write a special token, and not where a combining mark (U+0300 to U+036F, bytes CC and CD) might
    follow a letter: the tokenizer composes before it lower-cases, and T with a diaeresis has a composed form only as a
    small letter.
    """
    data = (text or "").encode("utf-8", "replace")
    return data if b"<|" in data or b"\xcc" in data or b"\xcd" in data else data.lower()


def _together(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Texts as bytes, a block's worth at a time."""
    held, size = [], 0
    for text in texts:
        held.append(_lowered(text))
        size += len(held[-1])
        if size > TEXT_BLOCK:
            yield held
            held, size = [], 0
    yield held


def pieces_of(blocks: Iterable[list[bytes]], coder: WordCoder, size: int = SEQUENCE) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids) of a document, given as blocks of words."""
    width, held, piece = 4 * size, b"", 0
    for words in blocks:
        held += coder.encode(words)
        while len(held) > width:  # an equal length may be the last piece
            yield piece, piece * size, size, zlib.crc32(held[:width])
            held, piece = held[width:], piece + 1
    if len(held) == width:
        yield piece, piece * size, size, zlib.crc32(held)
        held, piece = b"", piece + 1
    held += CLOSING.to_bytes(4, "little")
    yield piece, piece * size, len(held) // 4, zlib.crc32(held)


def _learnt(blocks: Iterable[list[bytes]], coder: WordCoder) -> Iterator[list[bytes]]:
    for words in blocks:
        coder.learn([words])
        yield words


def tokenised(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, words: int = CACHED_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces of all documents. `words`: how many a worker remembers."""

    def rows_of(texts: list[str | None], coder: WordCoder) -> Iterator[tuple]:
        number = 0
        for some in _together(texts):
            if sum(map(len, some)) > 2 * TEXT_BLOCK:  # a very long text among them
                blocks = [_learnt(_word_blocks(t), coder) for t in some]
            else:
                blocks = [[t.split()] for t in some]
                coder.learn([words for (words,) in blocks])
            for block in blocks:
                yield from ((number, *p) for p in pieces_of(block, coder, size))
                number += 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path or tokenizer_path(), words)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                ids, rows = batch.column(0), list(rows_of(batch.column(1).to_pylist(), coder))
                columns = [ids.take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE)


def best_fit(lengths: list[int], size: int = SEQUENCE, max_docs: int = MAX_DOCS, max_cost: int = MAX_COST, weights: tuple[float, float, float] = WEIGHTS) -> list[tuple[int, int]]:
    """(sequence, offset) of every piece, for pieces in the order in which they are placed."""
    by_tokens, by_docs, by_cost = weights[0] / size**2, weights[1] / max_docs**2, weights[2] / max_cost**2
    open_: dict[int, dict[tuple[int, int], list[int]]] = {}  # residual tokens -> (documents, cost) -> sequences alike
    levels: list[int] = []  # the keys of open_, sorted
    placed, n = [], 0
    for length in lengths:
        cost, best, least = length * length, None, float("inf")
        for at in range(bisect_left(levels, length), len(levels)):
            tokens = levels[at]
            norm = by_tokens * (tokens - length) ** 2
            if norm >= least:
                break
            for docs, left in open_[tokens]:
                if docs >= 1 and left >= cost:
                    whole = norm + by_docs * (docs - 1) ** 2 + by_cost * (left - cost) ** 2
                    if whole < least:
                        best, least = (tokens, docs, left), whole
        if best is None:
            number, tokens, docs, left = n, size, max_docs, max_cost
            n += 1
        else:
            tokens, docs, left = best
            alike = open_[tokens]
            number = alike[docs, left].pop()
            if not alike[docs, left]:
                del alike[docs, left]
                if not alike:
                    del open_[tokens]
                    del levels[bisect_left(levels, tokens)]
        placed.append((number, size - tokens))
        tokens, docs, left = tokens - length, docs - 1, left - cost
        if tokens > 0 and docs > 0:
            if tokens not in open_:
                open_[tokens] = {}
                insort(levels, tokens)
            open_[tokens].setdefault((docs, left), []).append(number)
    return placed


def pack_pieces(pieces: DataFrame, size: int = SEQUENCE, max_docs: int = MAX_DOCS, max_cost: int = MAX_COST, weights: tuple[float, float, float] = WEIGHTS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `size` tokens."""
    pieces = table(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    rest = pieces.where(F.col("length") < size)
    tokens, rows = rest.agg(F.sum("length"), F.count("*")).first()
    groups = max(1, math.ceil(max((tokens or 0) / group_tokens, rows / GROUP_ROWS)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "_row"], ascending=[False, True, True, True], kind="stable")
        placed = best_fit(group["length"].tolist(), size, max_docs, max_cost, weights)
        group["sequence_id"] = [(int(group["_group"].iloc[0]) << 32) + s for s, _ in placed]
        group["offset"] = [o for _, o in placed]
        return group[names]

    names = [*(c for c in pieces.columns if c != "_row"), "sequence_id", "offset"]
    kinds = ", ".join(f"{n} {k}" for n, k in pieces.dtypes if n != "_row") + ", sequence_id long, offset long"
    dealt = rest.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    packed = dealt.groupBy("_group").applyInPandas(pack, kinds)
    alone = pieces.where(F.col("length") >= size).select("*", (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).select(*names)
    return packed.unionByName(alone)


def packed(docs: DataFrame, path: str | None = None, words: int = CACHED_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all pieces."""
    return pack_pieces(tokenised(docs, path, words=words))

"""Model interfaces, and deterministic stand-ins for tests and offline runs."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from typing import Protocol


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Captioner(Protocol):
    def describe(self, path: str) -> str: ...


class PairScorer(Protocol):
    def scores(self, pairs: Sequence[tuple[str, str]]) -> list[float]: ...


class Generator(Protocol):
    def stream(self, system: str, user: str, temperature: float) -> Iterator[str | None]: ...


class Extractor(Protocol):
    """layer: the text that each page of a file already has; blocks: pages and their text, read as `ocr` says (none,
    regions, full or full_legacy)."""

    def layer(self, content: bytes) -> list[str]: ...

    def blocks(self, content: bytes, ocr: str) -> list[tuple[list[int], str]]: ...


class HashEmbedder:
    """Words hashed into signed buckets, normalised: texts with words in common are near."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        found = []
        for text in texts:
            vector = [0.0] * self.dimensions
            for word in re.findall(r"\w+", text.lower()):
                number = int.from_bytes(hashlib.sha256(word.encode("utf-8", "replace")).digest()[:8], "big")
                vector[number % self.dimensions] += 1.0 if number >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in vector)) or 1.0
            found.append([x / size for x in vector])
        return found


class OverlapScorer:
    """The share of the query's words that a text has, through a sigmoid."""

    def scores(self, pairs: Sequence[tuple[str, str]]) -> list[float]:
        found = []
        for query, text in pairs:
            asked, words = set(re.findall(r"\w+", query.lower())), set(re.findall(r"\w+", text.lower()))
            found.append(1 / (1 + math.exp(-(4 * len(asked & words) / max(1, len(asked)) - 2))))
        return found


class QuotingGenerator:
    """Answers with the first words of the first passage, and cites it."""

    def stream(self, system: str, user: str, temperature: float) -> Iterator[str | None]:
        context = system.partition("[1] (")[2].partition("\n")[2]
        for word in context.split()[:8]:
            yield word + " "
        yield None
        yield "[1]"


class PlainTextExtractor:
    """Reads UTF-8 text as a document; a form feed ends a page. Has no eyes: what `ocr` asks for is left undone."""

    def layer(self, content: bytes) -> list[str]:
        if content.startswith(b"%PDF-"):
            raise ValueError("this extractor reads plain text; give the service one that reads PDF")
        return content.decode("utf-8", "ignore").split("\f")

    def blocks(self, content: bytes, ocr: str = "none") -> list[tuple[list[int], str]]:
        return [([number], text) for number, text in enumerate(self.layer(content), 1)]


class NameCaptioner:
    """Captions an image by its file name."""

    def describe(self, path: str) -> str:
        return re.sub(r"[-_]+", " ", path.rsplit("/", 1)[-1].rsplit(".", 1)[0])

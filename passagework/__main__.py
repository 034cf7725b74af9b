"""python -m passagework DOCS STORE [--images DIR] [--suffix pdf]: questions and slash commands on the console."""

from __future__ import annotations

import argparse
from collections.abc import Iterable, Iterator

from .functions.text import sanitize
from .operators.answer import display_lines, evidence
from .operators.retrieve import LABELS, Options
from .plans.service import Service
from .plans.settings import Settings, handle
from .session import session

QUIT = ("exit", "quit", "q")


def settled(service: Service, settings: Settings) -> tuple[Settings, list[str]]:
    """Does what commands have put off, reindexing first, then image search, then refreshing."""
    said = []
    if settings.reindex:
        service.reindex(settings.reindex)
        said.append(f"reindexed {settings.reindex}")
    if settings.find:
        found = service.find_images([settings.find]).orderBy("rank").collect()
        said += [f" - [{r['rank']}] ({r['score']:.3f}) {r['source']}\n{r['caption']}" for r in found] or ["No matching images found."]
    if settings.refresh == "docs":
        said.append(f"{service.refresh()} chunks")
    if settings.refresh == "images":
        said.append(f"{service.refresh_gallery()} images")
    known = frozenset(service.status()["sources"]) if settings.reindex or settings.refresh else settings.known_sources
    return Settings(**{**settings.__dict__, "reindex": None, "find": None, "refresh": None, "known_sources": known}), said


def answered(service: Service, settings: Settings, question: str) -> Iterator[str]:
    """What the console shows for a question: the passages, then the answer as it comes."""
    if not service.chunks():
        yield "Database is empty."
        return
    options = Options(settings.top_n, settings.mode, settings.rerank, settings.rerank_k, None if settings.sources is None else list(settings.sources))
    hits = service.retrieve([question], options).persist()
    try:
        label = LABELS["rerank" if settings.rerank else settings.mode]
        lines = [r["line"] for r in display_lines(evidence(hits), label).orderBy("rank").collect()]
        if not lines:
            yield "No matching results found."
            return
        yield from lines
        yield "".join(service.stream_answer(question, hits, settings.temperature))
    finally:
        hits.unpersist()


def converse(service: Service, lines: Iterable[str]) -> Iterator[str]:
    """A session: what each line brings to the console."""
    settings = Settings(known_sources=frozenset(service.status()["sources"]))
    for line in map(sanitize, lines):
        if line.strip().lower() in QUIT:
            return
        if not line.strip():
            continue
        done = handle(line, settings)
        settings = done.settings
        if done.message:
            yield done.message
        settings, said = settled(service, settings)
        yield from said
        if not done.consumed:
            yield from answered(service, settings, line.strip())


def main() -> None:
    import sys

    parser = argparse.ArgumentParser(prog="passagework")
    parser.add_argument("docs")
    parser.add_argument("store")
    parser.add_argument("--images")
    parser.add_argument("--suffix", default="pdf")
    given = parser.parse_args()
    service = Service(session(), given.docs, given.store, given.images, suffix=given.suffix)
    service.refresh()
    service.refresh_gallery()
    for text in converse(service, sys.stdin):
        print(text, flush=True)


if __name__ == "__main__":
    main()

"""Slash commands."""

from __future__ import annotations

import pytest

from passagework.plans.settings import FALSY, TRUTHY, Settings, handle

KNOWN = Settings(known_sources=frozenset({"a.pdf", "b.pdf"}))


@pytest.mark.parametrize(
    "line, field, value",
    [
        ("/top_n=7", "top_n", 7), ("/top_n=0", "top_n", 3), ("/top_n=-1", "top_n", 3), ("/top_n=many", "top_n", 3), ("/top_n=", "top_n", 3), ("/ TOP_N =5", "top_n", 5),
        ("/rerank_k=0", "rerank_k", 30), ("/rerank_k=9", "rerank_k", 9), ("/temperature=hot", "temperature", 0.0), ("/temperature=0.5", "temperature", 0.5),
        ("/mode=DENSE", "mode", "dense"), ("/mode=semantic", "mode", "hybrid"), *((f"/rerank={w}", "rerank", True) for w in TRUTHY), *((f"/rerank={w}", "rerank", False) for w in (*FALSY, "maybe")),
        ("/sources= a.pdf , b.pdf ", "sources", ("a.pdf", "b.pdf")), ("/sources=a.pfd", "sources", None), ("/sources=a.pdf,nope.pdf", "sources", None), ("/sources=  ,  ", "sources", None),
        ("/reindex=a.pdf", "reindex", "a.pdf"), ("/reindex=", "reindex", None), ("/find=a red car", "find", "a red car"), ("/refresh=DOCS", "refresh", "docs"), ("/refresh=all", "refresh", None),
    ],
)
def test_commands(line, field, value):
    done = handle(line, KNOWN)
    assert done.consumed and getattr(done.settings, field) == value


def test_sources():
    limited = handle("/sources=a.pdf", KNOWN).settings
    assert handle("/sources=ALL", limited).settings.sources is None
    assert handle("/sources=any.pdf", Settings()).settings.sources == ("any.pdf",)  # nothing known yet
    message = handle("/sources=a.pfd", KNOWN).message
    assert "a.pfd" in message and "a.pdf" in message


def test_lines():
    assert not handle("what is dialectics?", Settings()).consumed
    assert "Unknown command" in handle("/nonsense=1", Settings()).message and handle("/nonsense=1", Settings()).consumed
    assert "mode = hybrid" in handle("/status", Settings()).message

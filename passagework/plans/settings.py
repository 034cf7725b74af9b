"""Session settings and the slash commands that change them. Driver-side, immutable."""

from __future__ import annotations

from dataclasses import dataclass, replace

TRUTHY, FALSY = ("on", "true", "1", "yes"), ("off", "false", "0", "no")
MODES, TARGETS = ("dense", "bm25", "hybrid"), ("docs", "images")


@dataclass(frozen=True)
class Settings:
    top_n: int = 3
    temperature: float = 0.0
    sources: tuple[str, ...] | None = None
    mode: str = "hybrid"
    rerank: bool = False
    rerank_k: int = 30
    reindex: str | None = None
    find: str | None = None
    refresh: str | None = None
    known_sources: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Outcome:
    """What a line did: whether it was a command, the settings after it, and what to tell the user."""

    consumed: bool
    settings: Settings
    message: str = ""


def _positive(name: str):
    def change(settings: Settings, value: str) -> tuple[Settings, str]:
        try:
            number = int(value)
        except ValueError:
            number = 0
        return (replace(settings, **{name: number}), f"{name} set to {number}") if number >= 1 else (settings, f"{name} must be a positive integer")

    return change


def _temperature(settings: Settings, value: str) -> tuple[Settings, str]:
    try:
        return replace(settings, temperature=float(value)), f"temperature set to {float(value)}"
    except ValueError:
        return settings, "temperature must be a number"


def _mode(settings: Settings, value: str) -> tuple[Settings, str]:
    wanted = value.lower()
    return (replace(settings, mode=wanted), f"mode set to {wanted}") if wanted in MODES else (settings, f"mode must be one of: {', '.join(MODES)}")


def _rerank(settings: Settings, value: str) -> tuple[Settings, str]:
    wanted = value.lower()
    if wanted not in TRUTHY + FALSY:
        return settings, f"rerank must be one of: {', '.join(TRUTHY + FALSY)}"
    return replace(settings, rerank=wanted in TRUTHY), f"rerank {'on' if wanted in TRUTHY else 'off'}"


def _sources(settings: Settings, value: str) -> tuple[Settings, str]:
    if value.lower() == "all":
        return replace(settings, sources=None), "all sources"
    wanted = tuple(filter(None, map(str.strip, value.split(","))))
    unknown = [w for w in wanted if w not in settings.known_sources] if settings.known_sources else []
    if not wanted:
        return settings, "usage: /sources=<names> or /sources=all"
    if unknown:
        return settings, f"unknown: {', '.join(unknown)}; indexed: {', '.join(sorted(settings.known_sources))}"
    return replace(settings, sources=wanted), f"sources: {', '.join(wanted)}"


def _pending(name: str, allowed: tuple[str, ...] | None = None):
    def change(settings: Settings, value: str) -> tuple[Settings, str]:
        wanted = value.lower() if allowed else value
        if not wanted or allowed and wanted not in allowed:
            return settings, f"usage: /{name}=<{'|'.join(allowed or ('name',))}>"
        return replace(settings, **{name: wanted}), ""

    return change


def status(settings: Settings) -> str:
    listed = "all" if settings.sources is None else ", ".join(settings.sources)
    shown = {"mode": settings.mode, "rerank": "on" if settings.rerank else "off", "rerank_k": settings.rerank_k, "top_n": settings.top_n, "temperature": settings.temperature, "sources": listed}
    return "\n".join(f"{name} = {value}" for name, value in shown.items())


COMMANDS = {
    "top_n": _positive("top_n"), "temperature": _temperature, "mode": _mode, "rerank": _rerank, "rerank_k": _positive("rerank_k"), "sources": _sources,
    "reindex": _pending("reindex"), "find": _pending("find"), "refresh": _pending("refresh", TARGETS), "status": lambda settings, _: (settings, status(settings)),
}


def handle(line: str, settings: Settings) -> Outcome:
    """Read a line; anything that starts with a slash is a command, known or not."""
    text = line.strip()
    if not text.startswith("/"):
        return Outcome(False, settings)
    name, _, value = text[1:].partition("=")
    change = COMMANDS.get(name.strip().lower())
    if change is None:
        return Outcome(True, settings, f"Unknown command: {text}")
    after, message = change(settings, value.strip())
    return Outcome(True, after, message)

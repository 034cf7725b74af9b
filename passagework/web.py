"""The engine over HTTP, on the standard library's server: JSON routes, and answers as server-sent events."""

from __future__ import annotations

import json
import mimetypes
import threading
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path, PurePosixPath
from urllib.parse import unquote

from .operators.retrieve import Options
from .plans.service import Service
from .streaming.events import answer_events, frame, framed


def ask_events(service: Service, request: dict) -> Iterator[str]:
    """An answer's frames: `empty`, or `sources`, each `token` as it comes and `done`; `error` on any failure.

    What the hits alone decide comes from the rows of `streaming.events`; the generator's fragments are framed between."""
    try:
        options = Options(request.get("top_n", 4), request.get("mode", "hybrid"), request.get("rerank", False), sources=request.get("sources"))
        question = request["question"]
        hits = service.retrieve([question], options).persist()
        try:
            asked = service.spark.createDataFrame([(0,)], "qid int")
            silent = service.spark.createDataFrame([], "qid int, at int, fragment string")
            first, *rest = framed(answer_events(asked, hits, silent)).orderBy("seq").collect()
            yield first.frame
            if rest:
                yield from (frame("token", t) for t in service.stream_answer(question, hits, request.get("temperature", 0.0)) if t)
                yield rest[-1].frame
        finally:
            hits.unpersist()
    except Exception as problem:
        yield frame("error", str(problem))


def image_path(folder: str | None, name: str) -> Path | None:
    """A gallery file by its base name only, from a URL's encoded path; None if there is none."""
    plain = PurePosixPath(unquote(name).replace("\\", "/")).name
    if not folder or not plain or "\0" in plain:
        return None
    path = Path(folder) / plain
    return path if path.is_file() else None


def site_file(folder: str | None, path: str) -> Path | None:
    """A static file below the folder, `/` being its index.html; None for anything else."""
    if not folder:
        return None
    root = Path(folder).resolve()
    found = (root / unquote(path.split("?")[0]).lstrip("/").replace("\0", "")).resolve()
    found = found / "index.html" if found.is_dir() else found
    return found if found.is_relative_to(root) and found.is_file() else None


def handler(service: Service, site: str | None = None) -> type[BaseHTTPRequestHandler]:
    refreshing = threading.Lock()  # one refresh at a time; readers use the published snapshot

    class Handler(BaseHTTPRequestHandler):
        def _json(self, payload: object, status: int = 200) -> None:
            data = json.dumps(payload, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _refreshed(self, refresh) -> None:
            """Refresh, then answer what `refresh` gives."""
            try:
                with refreshing:
                    told = refresh()
                self._json(told)
            except Exception as problem:
                self._json({"detail": str(problem)}, 500)

        def do_GET(self) -> None:
            if self.path == "/api/status":
                self._json(service.status())
            elif self.path == "/api/gallery/status":
                self._json({"count": service.images_known()})
            elif self.path.startswith("/api/gallery/file/"):
                self._file(image_path(service.images, self.path.removeprefix("/api/gallery/file/")))
            else:
                self._file(site_file(site, self.path))

        def _file(self, path: Path | None) -> None:
            if path is None:
                self._json({"detail": "not found"}, 404)
                return
            self.send_response(200)
            self.send_header("Content-Type", mimetypes.guess_type(path.name)[0] or "application/octet-stream")
            self.end_headers()
            self.wfile.write(path.read_bytes())

        def do_POST(self) -> None:
            request = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            if self.path == "/api/refresh":
                self._refreshed(lambda: (service.refresh(), service.status())[1])
            elif self.path == "/api/gallery/refresh":
                self._refreshed(lambda: {"count": service.refresh_gallery()})
            elif self.path == "/api/gallery/search":
                found = service.find_images([request["query"]], request.get("top_n", 6)).orderBy("rank").collect()
                self._json([{k: r[k] for k in ("source", "caption", "score", "url")} for r in found])
            elif self.path == "/api/ask":
                self.send_response(200)
                self.send_header("Content-Type", "text/event-stream")
                self.send_header("Cache-Control", "no-cache")
                self.end_headers()
                for text in ask_events(service, request):
                    self.wfile.write(text.encode())
                    self.wfile.flush()
            else:
                self._json({"detail": "not found"}, 404)

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000, site: str | None = None) -> ThreadingHTTPServer:
    """A server, not yet running: call serve_forever. `site`: a folder of static files to serve beside the routes."""
    return ThreadingHTTPServer((host, port), handler(service, site))

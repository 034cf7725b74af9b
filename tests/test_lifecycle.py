"""Documents and images come, change and go; syncs fail half-way; the facade, console and web serve what is there."""

from __future__ import annotations

import http.client
import json
import threading
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from passagework import web
from passagework.__main__ import converse
from passagework.operators.answer import NO_CONTEXT
from passagework.operators.retrieve import Options
from passagework.plans import lifecycle
from passagework.plans.service import Service
from passagework.sources import files
from passagework.sources.store import Store
from passagework.streaming import events


class Folders:
    def __init__(self, path: Path) -> None:
        self.docs, self.images, self.store = path / "docs", path / "images", path / "store"
        self.docs.mkdir()
        self.images.mkdir()

    def write(self, name: str, text: str) -> None:
        (self.docs / name).write_text(text)


@pytest.fixture
def at(tmp_path):
    return Folders(tmp_path)


@pytest.fixture
def service(spark, at):
    return Service(spark, str(at.docs), str(at.store), str(at.images))


def stored(service):
    return Counter(r.source for r in service.store.read("corpus").collect())


def test_documents_come_change_and_go(service, at):
    at.write("a.pdf", "first page about cats\fsecond page about dogs")
    at.write("b.pdf", "birds " * 300)
    at.write("note.txt", "not a document")
    n = service.refresh()
    assert n == sum(stored(service).values()) and set(stored(service)) == {"a.pdf", "b.pdf"}
    snapshot = service.store.current()
    service.refresh()
    assert service.store.current() == snapshot  # nothing changed
    before = {r.source: r.digest for r in service.store.read("manifest").collect()}
    at.write("a.pdf", "only fish now")
    service.refresh()
    after = {r.source: r.digest for r in service.store.read("manifest").collect()}
    assert before["b.pdf"] == after["b.pdf"] and before["a.pdf"] != after["a.pdf"]
    assert [r.text for r in service.store.read("corpus").where("source = 'a.pdf'").collect()] == ["only fish now"]
    (at.docs / "b.pdf").unlink()
    service.refresh()
    assert set(stored(service)) == {"a.pdf"}
    (at.docs / "a.pdf").unlink()
    assert service.refresh() == 0 and service.store.read("manifest").count() == 0
    at.write("a.pdf", "back again")
    assert service.refresh() == 1


def test_pages_are_attributed(service, at):
    at.write("a.pdf", "one\ftwo\f\ffour")
    service.refresh()
    assert [r.pages for r in service.store.read("corpus").collect()] == ["1, 2, 4"]


def test_a_document_without_text_is_marked_and_not_tried_again(service, at):
    at.write("blank.pdf", " \f ")
    service.refresh()
    assert [(r.source, r.n_chunks) for r in service.store.read("manifest").collect()] == [("blank.pdf", 0)]
    snapshot = service.store.current()
    service.refresh()
    assert service.store.current() == snapshot


def test_a_sync_that_fails_leaves_the_old_snapshot(service, at, monkeypatch):
    at.write("a.pdf", "old text")
    service.refresh()
    at.write("a.pdf", "new text")

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(lifecycle, "next_manifest", fail)
        with pytest.raises(OSError):
            service.refresh()
    assert [r.text for r in service.store.read("corpus").collect()] == ["old text"]
    service.refresh()
    assert [r.text for r in service.store.read("corpus").collect()] == ["new text"]


def test_states(spark):
    on_disk = spark.createDataFrame([("new", "1"), ("same", "1"), ("edited", "2"), ("half", "1"), ("legacy", "1")], "source string, digest string")
    manifest = spark.createDataFrame([("same", "1", 1), ("edited", "1", 1), ("gone", "1", 1)], "source string, digest string, n_chunks long")
    corpus = spark.createDataFrame([("half::0", "half", 0, None), ("orphan::0", "orphan", 1, None), ("legacy::0", "legacy", 2, "0"), ("legacy::1", "legacy", 3, "1")], "id string, source string, ord long, file_hash string")
    plan = dict(lifecycle.sync_plan(on_disk, manifest, corpus).collect())
    assert plan == {"new": "new", "same": "skip", "edited": "changed", "half": "interrupted", "legacy": "skip", "gone": "deleted", "orphan": "deleted"}
    assert dict(lifecycle.sync_plan(on_disk, manifest, corpus, ["same"]).collect())["same"] == "changed"
    assert not lifecycle.any_changed(lifecycle.sync_plan(on_disk.limit(0), manifest.limit(0), corpus.limit(0))).first()[0]


def test_reindex(service, at):
    at.write("a.pdf", "text")
    service.refresh()
    snapshot = service.store.current()
    assert service.reindex("some/where/a.pdf") and service.store.current() != snapshot
    (at.docs / "a.pdf").unlink()
    service.reindex("a.pdf")
    assert not stored(service)


def test_file_scans(spark, at):
    for name in ("a.pdf", "B.PDF", ".hidden.pdf", "_under.pdf", "sp ace.pdf", "p%20q.pdf"):
        at.write(name, "x")
    (at.docs / "deep").mkdir()
    (at.docs / "deep" / "c.pdf").write_text("x")
    found = {r.source: bytes(r.content) for r in files.document_files(spark, str(at.docs)).collect()}
    assert found == dict.fromkeys(["a.pdf", "sp ace.pdf", "p%20q.pdf", "_under.pdf"], b"x")
    for name in ("a.png", "b.JPG", "c.txt", "d.WebP", ".x.png", "_y.png"):
        (at.images / name).write_bytes(b"x")
    assert {r.source for r in files.image_files(spark, str(at.images)).collect()} == {"a.png", "b.JPG", "d.WebP", ".x.png", "_y.png"}
    assert files.image_files(spark, str(at.images / "none")).count() == 0


def test_images_come_change_and_go(service, at):
    (at.images / "red-car.png").write_bytes(b"1")
    (at.images / "blue_sky.JPG").write_bytes(b"2")
    assert service.refresh_gallery() == 2
    snapshot = service.store.current()
    service.refresh_gallery()
    assert service.store.current() == snapshot
    best = service.find_images(["blue sky"]).orderBy("rank").first()
    assert (best.source, best.caption, best.url) == ("blue_sky.JPG", "blue sky", "/api/gallery/file/blue_sky.JPG") and best.score == pytest.approx(1.0)
    assert service.find_images(["  "]).count() == 0
    (at.images / "red-car.png").write_bytes(b"3")
    (at.images / "blue_sky.JPG").unlink()
    service.refresh_gallery()
    assert [r.source for r in service.store.read("gallery").collect()] == ["red-car.png"]


def test_one_changed_file_writes_one_bucket(service, at, spark):
    for i in range(1000):
        at.write(f"f{i}.pdf", f"text number {i}")
    assert service.refresh() == 1000
    before = service.store.parts()
    at.write("f7.pdf", "other text")
    assert service.refresh() == 1000
    after = service.store.parts()
    (bucket,) = [str(r.b) for r in spark.createDataFrame([("f7.pdf",)], "source string").select(service.store.bucket().alias("b")).collect()]
    for table in ("corpus", "manifest", "postings", "impacts", "lengths"):
        assert {b for b in before[table] if before[table][b] != after[table][b]} == {bucket} and len(after[table]) == service.store.buckets
    assert service.store.vacuum() == 0  # older folders still hold the other buckets
    found = service.search(["other"], Options(top_n=1, mode="bm25")).first()
    assert found.source == "f7.pdf"
    postings = service.store.read("postings")
    assert postings.count() == 3 * 999 + 2 and service.store.read("lengths").agg({"n": "sum"}).first()[0] == 1000


def test_folders_without_a_reader_go(service, at):
    at.write("a.pdf", "one")
    service.refresh()
    at.write("a.pdf", "two")
    service.refresh()
    assert service.store.vacuum() == 5 and [r.text for r in service.store.read("corpus").collect()] == ["two"]


def test_store_starts_empty(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.current() is None and store.read("corpus").count() == 0 and store.read("manifest").columns == ["source", "digest", "n_chunks"]


def test_asking(service, at):
    assert service.answer("anything")[0] == NO_CONTEXT
    at.write("cats.pdf", "cats sleep all day long in the sun")
    at.write("dogs.pdf", "dogs bark at night")
    service.refresh()
    said, found = service.answer("when do cats sleep", Options(top_n=1))
    assert said.endswith("[1]") and said.startswith("cats sleep") and [r.source for r in found] == ["cats.pdf"]
    assert service.search([" "]).count() == 0
    assert "**[1] cats.pdf" in service.markdown(["cats"], Options(top_n=1)).first().markdown


def test_console(service, at):
    at.write("cats.pdf", "cats sleep all day")
    service.refresh()
    said = list(converse(service, ["/top_n=1", "do cats sleep", "", "/find=cat", "/sources=nope.pdf", "/refresh=docs", "quit", "never read"]))
    assert said[0] == "top_n set to 1" and "[cats.pdf, p. 1]" in said[1] and said[2].endswith("[1]") and "No matching images found." in said
    assert any("unknown: nope.pdf" in s for s in said) and said[-1] == "1 chunks"


def test_event_rows(spark):
    asked = spark.createDataFrame([(0,), (1,)], "qid int")
    hits = spark.createDataFrame([(0, 1, "Tiếng Việt", 0.5, "f", "1")], "qid int, rank int, text string, score double, source string, pages string")
    tokens = spark.createDataFrame([(0, 0, "Xin"), (0, 1, ""), (0, 2, "chào"), (1, 0, "x")], "qid int, at int, fragment string")
    rows = events.framed(events.answer_events(asked, hits, tokens)).orderBy("qid", "seq").collect()
    assert [(r.qid, r.name) for r in rows] == [(0, "sources"), (0, "token"), (0, "token"), (0, "done"), (1, "empty")]
    assert "Tiếng Việt" in rows[0].payload and [json.loads(r.payload) for r in rows[1:3]] == ["Xin", "chào"]
    whole = "".join(r.frame for r in rows)
    assert [n for n, _ in events.frames(whole[i : i + 7] for i in range(0, len(whole), 7))] == [r.name for r in rows]


def test_frames():
    text = events.frame("token", "chào") + events.frame("sources", [{"rank": 1}])
    assert "chào" in text and list(events.frames([text, "event: tok"])) == [("token", "chào"), ("sources", [{"rank": 1}])]


def test_following_new_pages(spark, tmp_path):
    write = lambda n: spark.createDataFrame([(n, "short")], "page int, text string").write.mode("append").parquet(str(tmp_path / "in"))
    for n in (1, 2):
        write(n)
        events.follow_pages(spark, str(tmp_path / "in"), "page int, text string", str(tmp_path / "out"), str(tmp_path / "check"))
        assert spark.read.parquet(str(tmp_path / "out")).where(F.col("image_only")).count() == n


def test_image_paths(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"x")
    (tmp_path / "secret").write_bytes(b"x")
    assert web.image_path(str(tmp_path / "in"), "a.png") and web.image_path(str(tmp_path / "in"), "b.png") is None
    for name in ("../secret", "..\\secret", "/etc/passwd", "..", ""):
        assert web.image_path(str(tmp_path / "in"), name) is None


def test_a_site_is_served_and_nothing_beside_it(tmp_path):
    (tmp_path / "site" / "deep").mkdir(parents=True)
    (tmp_path / "site" / "index.html").write_text("home")
    (tmp_path / "site" / "deep" / "a b.js").write_text("x")
    (tmp_path / "secret").write_text("no")
    site = str(tmp_path / "site")
    assert web.site_file(site, "/").read_text() == "home" and web.site_file(site, "/deep/a%20b.js?v=1").read_text() == "x"
    for path in ("/../secret", "/%2e%2e/secret", "/nope", "/deep", "//etc/passwd"):
        assert web.site_file(site, path) is None
    assert web.site_file(None, "/") is None


def test_text_layers_decide_how_files_are_read(spark):
    class Pages:
        def layer(self, content):
            return content.decode().split("|")

        def blocks(self, content, ocr):
            return [([1], ocr)]

    long = "x" * 200
    files = spark.createDataFrame([(n, t.encode()) for n, t in (("scan", "|".join([""] * 9 + [long])), ("text", long), ("mixed", "|".join(["", long, long])), ("old", "ªº" * 100))], "source string, content binary")
    assert {r.source: r.text for r in lifecycle.extracted(files, Pages()).collect()} == {"scan": "full", "text": "none", "mixed": "regions", "old": "full_legacy"}


def test_plain_text_is_not_made_of_pdf(service, at, spark):
    (at.docs / "real.pdf").write_bytes(b"%PDF-1.7 ...")
    with pytest.raises(Exception, match="reads plain text"):
        service.refresh()
    assert service.store.current() is None


def test_web(service, at):
    at.write("cats.pdf", "cats sleep all day")
    (at.images / "cat.png").write_bytes(b"img")
    (at.docs.parent / "secret").write_bytes(b"no")
    server = web.serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method, path, body=None):
        connection = http.client.HTTPConnection(*server.server_address)
        connection.request(method, path, json.dumps(body) if body is not None else None)
        answer = connection.getresponse()
        return answer.status, answer.read()

    try:
        assert json.loads(call("POST", "/api/refresh")[1]) == {"chunks": 1, "sources": ["cats.pdf"], "images": 0}
        assert json.loads(call("POST", "/api/gallery/refresh")[1]) == json.loads(call("GET", "/api/gallery/status")[1]) == {"count": 1}
        told = dict(events.frames([call("POST", "/api/ask", {"question": "cats", "top_n": 1})[1].decode()]))
        assert list(told) == ["sources", "token", "done"] and told["sources"][0]["source"] == "cats.pdf"
        assert dict(events.frames([call("POST", "/api/ask", {"question": "cats", "top_n": 0})[1].decode()])).keys() == {"error"}
        assert json.loads(call("POST", "/api/gallery/search", {"query": "cat"})[1])[0]["source"] == "cat.png"
        assert call("GET", "/api/gallery/file/cat.png") == (200, b"img") and call("GET", "/api/gallery/file/..%2Fsecret")[0] == 404 and call("GET", "/nope")[0] == 404
        (at.images / "a b%.png").write_bytes(b"odd")
        assert call("GET", "/api/gallery/file/a%20b%25.png") == (200, b"odd")
        at.write("bad.pdf", "x")
        service.extractor = None
        assert call("POST", "/api/refresh")[0] == 500
    finally:
        server.shutdown()

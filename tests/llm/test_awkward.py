"""Every operator over awkward and over empty tables."""

from __future__ import annotations

import zlib
from collections import Counter

from passagework.llm import exact_dedup, fingerprints, html_text, mixing, packing, pii, quality, sharding, simhash, url_filter

from .conftest import ROWS


def ids(df, column="doc_id"):
    return Counter(r[column] for r in df.select(column).collect())


WANT = Counter(r[0] for r in ROWS)


def test_sharding(awkward, empty):
    rows = sharding.shard_documents(awkward).collect()
    assert Counter(r.doc_id for r in rows) == WANT
    for r in rows:
        texts = {t for i, t, *_ in ROWS if i == r.doc_id}
        assert (r.size, r.text_crc32) in {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts}
        assert r.grown_shard in (r.shard, 16)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert sharding.shard_documents(empty).count() == 0


def test_simhash(awkward, empty):
    rows = {r.doc_id: r for r in simhash.near_duplicates(awkward).collect()}
    assert ids(simhash.near_duplicates(awkward)) == WANT
    assert rows[1].component_id == rows[2].component_id == rows[3].component_id == 1  # A-Z are lower-cased
    assert {rows[i].fingerprint for i in (4, 5, 6)} == {"0" * 16} and {rows[i].component_id for i in (4, 5, 6)} == {4}
    kept = simhash.deduplicate(awkward)
    assert kept.columns == awkward.columns
    assert {1, 4, 7, 8, 9} <= set(ids(kept)) and ids(kept)[7] == 1 and 2 not in ids(kept)
    assert simhash.near_duplicates(empty).count() == simhash.deduplicate(empty).count() == 0


def test_quality(awkward, empty, labels):
    found = quality.scored(awkward, labels)
    rows = found.collect()
    assert Counter(r.doc_id for r in rows) == WANT and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert quality.keep_good(awkward, labels).columns == awkward.columns
    assert {r.score for r in quality.scored(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(empty, labels).count() == 0


def test_html(spark, empty):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<article><p>A&amp;B"), (4, "u", "<" * 1000 + "div" * 10), (None, "u", "<article>" + "<div>" * 5000 + "<p>deep words.")], "page_id long, url string, html string")
    rows = {r.page_id: r.text for r in html_text.extracted(pages).collect()}
    assert rows[1] == rows[2] == "" and rows[3] == "A&B" and rows[None] == "deep words."
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_pii(awkward, empty):
    rows = {r.doc_id: r for r in pii.report(awkward).collect()}
    assert ids(pii.report(awkward)) == WANT
    assert rows[10].spans == "email:5:19,phone:28:42" and rows[12].spans == "ip:28:36,card:5:24" and rows[4].spans == ""
    assert pii.report(empty).count() == 0


def test_fingerprints(awkward, empty, spark):
    found = fingerprints.edited_fingerprints(awkward)
    rows = {r.doc_id: r for r in found.collect()}
    assert ids(found) == WANT
    assert rows[1].fingerprint == rows[2].fingerprint == rows[3].fingerprint and rows[4].fingerprint == rows[5].fingerprint == rows[6].fingerprint
    assert rows[5].near_next == 1.0 and all(0 <= r.near_edited <= 1 for r in rows.values())
    assert fingerprints.edited_fingerprints(empty).count() == 0
    alone = fingerprints.edited_fingerprints(awkward.where("doc_id = 8")).first()
    assert alone.near_next == 1.0


def test_mixing(awkward, empty):
    rows = mixing.mix_table(awkward).collect()
    assert Counter(r.doc_id for r in rows) == WANT and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(awkward).columns == awkward.columns
    assert mixing.mix_table(empty).count() == mixing.mix(empty).count() == 0
    assert mixing.mix_table(awkward.where("doc_id in (4, 5, 6)")).agg({"taken": "sum"}).first()[0] == 0


def test_packing(awkward, empty):
    rows = packing.packed(awkward).collect()
    assert set(r.doc_id for r in rows) == set(WANT)
    assert [r.length for r in rows if r.doc_id == 4] == [1] and sum(r.doc_id == 7 for r in rows) == 2
    assert packing.packed(empty).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "no scheme", "x"), (None, "HTTP://A.Org/fr/1", "x"), (3, "http://h.com/" + "a/" * 30, "x")], "page_id long, url string, verdict string")
    rows = {r.page_id: r for r in url_filter.judged(pages).collect()}
    assert url_filter.judged(pages).count() == 5 and (rows[1].host, rows[1].path, rows[1].rule, rows[1].verdict) == ("", "", None, "allow")
    assert (rows[None].host, rows[None].rule, rows[None].verdict) == ("a.org", "org/fr/", "allow")
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_exact_dedup(awkward, empty):
    found = exact_dedup.exact_groups(awkward)
    rows = {r.doc_id: r for r in found.collect()}
    assert ids(found) == WANT
    assert (rows[1].keep_id, rows[1].kept, rows[2].kept, rows[3].kept) == (2, False, True, True)
    assert (rows[4].keep_id, rows[4].group_size) == (5, 2) and rows[None].kept and rows[None].keep_id is None
    assert sum(r.kept for r in found.where("doc_id = 7").collect()) == 1
    kept = exact_dedup.deduplicate(awkward)
    assert kept.columns == awkward.columns and kept.count() == len({t or "" for _, t, *_ in ROWS})
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0

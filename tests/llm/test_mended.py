"""Cases that once went wrong: lone articles, long URLs, IBANs with words behind them, labelled ids that repeat."""

from __future__ import annotations

import pytest

from passagework.llm import html_text, pii, quality, url_filter


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>A&amp;B", "A&B"), ("<main><p>Hello world</p></main>", "Hello world"), ("<p>plain words only here.", "plain words only here."), ("plain text without tags", "plain text without tags"),
        ("<article><p>Only a paragraph without a stop</p></article><footer>Copyright 2020</footer>", "Only a paragraph without a stop"),
        ('<p title="a hidden gem of text">Visible sentence here.</p>', "Visible sentence here."), ("<nav><a href=1>Home</a></nav><footer>Copyright 2020</footer>", ""),
        ('<article><p>Seen words here are many.</p><p style="color:red; display: none">Not seen.</p><p hidden>Nor this.</p><p HIDDEN="">Nor that.</p></article>', "Seen words here are many."),
    ],
)
def test_short_and_hidden_texts(page, text):
    assert html_text.main_text(page, html_text.trained()) == text


def test_a_url_of_a_hundred_thousand_segments(spark):
    urls = ["http://h.com/" + "/".join(f"s{i % 13}" for i in range(100_000)), "http://h.com/s0/s1/page", "http://example.com/de/x", "http://h.com/" + "a/" * 3_000]
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.judged(pages).collect()}
    assert {i: r.verdict for i, r in rows.items()} == {0: "allow", 1: "allow", 2: "block", 3: "allow"} and len(rows[0].path) == len(urls[0]) - len("http://h.com")


def test_ibans_end_where_their_country_says(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "account GB29NWBK60161331926819 AND MORE", "iban NL91ABNA0417164300", "iban DE89 3704 0044 0532 0130 01 BIC", "iban DE89 3704 0044 0532 0130 00, iban FR14 2004 1010 0505 0001 3M02 606"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    found = {(r.doc_id, r.match) for r in pii.find_spans(docs).where("kind = 'iban'").collect()}
    assert found == {(0, "DE89 3704 0044 0532 0130 00"), (1, "GB29NWBK60161331926819"), (2, "NL91ABNA0417164300"), (4, "DE89 3704 0044 0532 0130 00"), (4, "FR14 2004 1010 0505 0001 3M02 606")}


def test_a_labelled_id_that_many_rows_share_is_one_row_of_the_sample(spark):
    docs = spark.range(3_000).selectExpr("id % 3 as doc_id", "concat('text ', id) as text")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    sample = quality.labelled_sample(docs, labels)
    assert len(sample) == sample.doc_id.nunique() <= 3

"""Text and number functions against Python's own."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.functions import numeric, text


def column(spark, expression, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i long, x {kind}").select("i", expression(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


WORDS = ["Hello, world!", "Phép biện chứng duy vật", "a_b c-d 1½ x²", "", "ΣΑΣ Straße ÉTÉ", "‍😀 tab\tline\n"]


def test_tokens(spark):
    assert column(spark, text.tokens, WORDS) == [re.findall(r"\w+", w.lower()) for w in WORDS]


SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, 0x2000, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def test_white_space(spark):
    values = [f"{s}a{s}{s}b{s}" for s in SPACES] + ["", " ", "x"]
    assert column(spark, text.collapse_ws, values) == [" ".join(v.split()) for v in values]
    assert column(spark, text.is_blank, values) == [not v.strip() for v in values]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Mn", "Mc", "Me", "Cn", "Lo"], exclude_characters="\x00"), max_size=30), min_size=1, max_size=40))
def test_collapse_and_tokens_agree_with_python(spark, values):
    assert column(spark, text.collapse_ws, values) == [" ".join(v.split()) for v in values]


def test_truncation(spark):
    assert column(spark, lambda c: text.truncated(c, 5), ["12345", "123456", "1234 6", "é😀é😀é😀"]) == ["12345", "1234…", "1234…", "é😀é😀…"]


def test_pages(spark):
    assert column(spark, text.format_pages, [[3, 4], [], [7]], "array<int>") == ["3, 4", "", "7"]


def test_three_decimals(spark):
    values = [0.0625, 0.1875, 1.0, -0.0625, 2 / 3, 12.3456, 0.0, 5.3125]
    assert column(spark, text.fixed3, values, "double") == [f"{v:.3f}" for v in values]


def test_base_names(spark):
    assert column(spark, text.basename, ["a/b/c d.pdf", "x%20y.pdf", "/z"]) == ["c d.pdf", "x%20y.pdf", "z"]


def test_citations(spark):
    answers = ["a [1] b [2][3]", "[1] and [1]", "[9]", "[n] [] 1"]
    assert column(spark, text.citations, answers) == [[1, 2, 3], [1, 1], [9], []]
    assert column(spark, text.linked_citations, ["x [12]"]) == ['x <a class="cite" href="#note-12">[12]</a>']
    assert column(spark, text.html_escape, ['<a href="x">&</a>']) == ["&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"]


def test_digests(spark):
    one, other = column(spark, lambda c: text.digest(c, "v1"), [b"a", b"b"], "binary")
    assert one != other and one.startswith("v1:") and column(spark, lambda c: text.digest(c, "v2"), [b"a"], "binary") != [one]


def test_sanitize():
    assert text.sanitize("a\ud800b") == "ab" and text.sanitize("Tiếng Việt") == "Tiếng Việt"


def test_sigmoid(spark):
    assert column(spark, numeric.sigmoid, [0.0, 800.0, -800.0], "double") == pytest.approx([0.5, 1.0, 0.0])


def test_cosine(spark):
    got = spark.sql("SELECT array(1f, 0f) AS a, array(1f, 1f) AS b, array(0f, 0f) AS z").select(numeric.cosine(F.col("a"), F.col("b")), numeric.cosine(F.col("a"), F.col("z"))).first()
    assert got[0] == pytest.approx(0.5**0.5) and got[1] is None


def test_percent(spark):
    from passagework.functions.text import percent

    shares = [0.0, 0.005, 0.015, 0.125, 0.2, 0.999, 1.0, 0.375]
    found = spark.createDataFrame([(x,) for x in shares], "x double").select("x", percent(F.col("x")).alias("p")).collect()
    assert {r.x: r.p for r in found} == {x: f"{x:.0%}" for x in shares}

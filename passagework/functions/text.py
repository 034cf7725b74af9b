"""Column functions over text. All JVM-side.

Java's `\\w` and `\\s` know ASCII only, so word and white-space classes are spelt out to agree with Unicode rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}_]+)"
SPACES = r"[\s\p{Z}\x1c-\x1f\x85]+"
CITATION = r"\[(\d+)\]"


def tokens(text: Column) -> Column:
    """Lower-cased words in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 1)


def collapse_ws(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def is_blank(text: Column) -> Column:
    return F.coalesce(collapse_ws(text) == "", F.lit(True))


def truncated(text: Column, most: int) -> Column:
    """At most so many code points; an ellipsis ends what was cut."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most - 1))), F.lit("…"))).otherwise(text)


def format_pages(pages: Column) -> Column:
    """Comma-joined page numbers; none: an empty string."""
    return F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")


def fixed3(x: Column) -> Column:
    """Three decimals; a value halfway between two, which only odd sixteenths are, goes to the even one."""
    sixteenths = F.abs(x * 16)
    half = (sixteenths == F.floor(sixteenths)) & (sixteenths % 2 == 1)
    return F.when(half, F.format_string("%.3f", F.bround(x.cast("decimal(24,6)"), 3).cast("double"))).otherwise(F.format_string("%.3f", x))


def percent(x: Column) -> Column:
    """A share as whole per cent; halves go to the even one."""
    return F.format_string("%.0f%%", F.bround((x * 100).cast("double"), 0))


def basename(path: Column) -> Column:
    """The last part of a path; not URL-decoded, as readers give paths plain."""
    return F.element_at(F.split(path, "/"), -1)


def citations(answer: Column) -> Column:
    """The ranks that an answer cites, in order, repeats kept."""
    return F.transform(F.regexp_extract_all(answer, F.lit(CITATION), 1), lambda x: x.cast("int"))


def html_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def linked_citations(answer: Column) -> Column:
    """Each [n] as a link to note n."""
    return F.regexp_replace(answer, CITATION, '<a class="cite" href="#note-$1">[$1]</a>')


def digest(content: Column, version: str) -> Column:
    """A content digest in a version's namespace: a new version or other bytes give another digest."""
    return F.concat(F.lit(f"{version}:"), F.sha2(content, 256))


def sanitize(text: str) -> str:
    """Without lone surrogates. On the driver and in Python readers, before text enters the JVM."""
    return text.encode("utf-8", "ignore").decode("utf-8")

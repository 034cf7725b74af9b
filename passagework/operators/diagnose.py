"""What the text layer of a document's pages is worth, and how much OCR it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..schema import FULL_OCR, LEGACY_RATIO, MIN_PAGE_CHARS, OCR_TRIGGER

#: Characters that text in legacy font encodings is full of; fixed values.
LEGACY_CHARS = "¡¢£¤¥¦¨ª¬¯´¸¹º¼½¾¿×÷ÐÞßðþ"


def layer_stats(pages: DataFrame) -> DataFrame:
    """From pages (source, text): source, n_pages, image_only_ratio, legacy_ratio.

    The image-only ratio is the share of pages with too few characters; the legacy ratio is a share of all characters,
    not a mean over pages. One shuffle, pre-aggregated by source.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    legacy = F.length(F.regexp_replace(text, f"[^{LEGACY_CHARS}]", ""))
    return pages.groupBy("source").agg(
        F.count("*").alias("n_pages"), F.avg((F.length(text) < MIN_PAGE_CHARS).cast("double")).alias("image_only_ratio"),
        F.coalesce(F.try_divide(F.sum(legacy), F.sum(F.length(text))), F.lit(0.0)).alias("legacy_ratio"),
    )


def ocr_mode(image_only: Column, legacy: Column) -> Column:
    """none, regions, full, or full_legacy: a text layer that is there but in a legacy encoding."""
    return (
        F.when(image_only >= FULL_OCR, "full").when(legacy >= LEGACY_RATIO, "full_legacy").when(image_only >= OCR_TRIGGER, "regions").otherwise("none")
    )


def ocr_decisions(pages: DataFrame) -> DataFrame:
    """layer_stats and the OCR mode of every source."""
    return layer_stats(pages).withColumn("ocr", ocr_mode(F.col("image_only_ratio"), F.col("legacy_ratio")))


def ocr_engine(installed: set[str], has_fallback: bool, wanted: tuple[str, ...] = ("vie", "eng")) -> str:
    """The OCR engine to use, on the driver: the first if it has all languages, else the fallback."""
    if set(wanted) <= installed:
        return "tesseract"
    if has_fallback:
        return "easyocr"
    raise RuntimeError(f"no OCR engine reads {', '.join(wanted)}")


def page_spans(items: DataFrame) -> DataFrame:
    """From items (source, prov array<int>): source, page, pages. An item belongs to its first page; a page covers all
    pages of its items, sorted."""
    keyed = items.where(F.size("prov") > 0).select("source", F.col("prov")[0].alias("page"), F.explode("prov").alias("p"))
    return keyed.groupBy("source", "page").agg(F.array_sort(F.collect_set("p")).alias("pages"))


def page_markdown(items: DataFrame) -> DataFrame:
    """From items (source, page, item_no, kind, level, text): source, page, text: a page's items in order as Markdown.

    Headings get a number sign a level, list items a dash, code a fence; images are dropped; nothing is escaped. Items
    without text leave no mark. Blank lines stand between items, and none between the items of a list."""
    marked = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.col("level"), F.lit(1))), F.lit(" "), "text"))
        .when(F.col("kind") == "list", F.concat(F.lit("- "), "text")).when(F.col("kind") == "code", F.concat(F.lit("```\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    )
    rows = items.where(F.col("kind") != "image").where(~is_blank(F.col("text"))).withColumn("_text", marked)
    listed = F.array_sort(F.collect_list(F.struct("item_no", (F.col("kind") == "list").alias("li"), F.col("_text").alias("t"))))
    pages = rows.groupBy("source", "page").agg(listed.alias("_items"))
    joint = lambda x, i: F.when(i == 0, "").when(x["li"] & F.get("_items", i - 1)["li"], "\n").otherwise("\n\n")
    return pages.select("source", "page", F.array_join(F.transform("_items", lambda x, i: F.concat(joint(x, i), x["t"])), "").alias("text"))


def page_blocks(items: DataFrame) -> DataFrame:
    """source, block_no, pages, text from items that also have prov (the pages that they stand on): one block a page, in
    page order; blank pages are left out, and a page without spans covers itself."""
    spans = page_spans(items.select("source", "prov"))
    blocks = page_markdown(items).join(spans, ["source", "page"], "left")
    return blocks.select("source", F.col("page").alias("block_no"), F.coalesce("pages", F.array("page")).alias("pages"), "text")

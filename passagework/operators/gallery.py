"""Image search by caption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .dense import dense_search


def gallery_search(gallery: DataFrame, queries: DataFrame, top_n: int = 6) -> DataFrame:
    """qid, rank, source, caption, score, url of the images whose captions are nearest; blank queries find nothing."""
    rows = gallery.select(F.col("source").alias("id"), F.xxhash64("source").alias("ord"), "source", "embedding")
    hits = dense_search(rows, queries.where(~is_blank(F.col("query"))), top_n).select("qid", "rank", "id", "score")
    found = gallery.select("source", "caption").join(hits, F.col("source") == F.col("id"))
    return found.select("qid", "rank", "source", "caption", "score", F.concat(F.lit("/api/gallery/file/"), "source").alias("url"))


def gallery_plan(images: DataFrame, gallery: DataFrame) -> DataFrame:
    """source, status: skip, ingest or delete, from images (source, digest) and gallery (source, file_hash)."""
    known = gallery.select("source", F.coalesce("file_hash", F.lit("")).alias("_known"))
    joined = images.select("source", "digest").join(known, "source", "full_outer")
    status = F.when(F.col("digest").isNull(), "delete").when(F.col("_known") == F.col("digest"), "skip").otherwise("ingest")
    return joined.select("source", status.alias("status"))

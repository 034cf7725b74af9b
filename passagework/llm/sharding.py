"""Sharding by weighted rendezvous hashing.

Every record key scores each shard, w / -ln(u) with u in (0, 1) from md5(key:shard), and goes to the highest score. A
shard's chance is its weight's share; a further shard changes no other score, so it only takes rows into itself.

The law of `shard_documents` is `key`: doc_id and the shard count decide and nothing else, so rows of equal texts and
different doc_ids may lie in different shards, and rows of equal doc_ids lie in one.

Nulls: a null key hashes as the empty string. Repeated keys go to the same shard. An empty table gives an empty result.
Columns beyond the key pass through; names starting with an underscore are the operator's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, running_total, table, whole

#: Hex digits of a digest that make a uniform number: 52 bits, exact in a double.
DIGITS = 13


def uniform(digest: Column) -> Column:
    """A number inside (0, 1) from a hex digest."""
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def shard_scores(key: Column, weights: Sequence[float]) -> list[Column]:
    """A shard's score for a key, for every shard."""
    name = F.coalesce(key.cast("string"), F.lit(""))
    return [F.lit(float(w)) / -F.ln(uniform(F.md5(F.concat(name, F.lit(f":{i}"))))) for i, w in enumerate(weights)]


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: the position of the highest score, the first of equal ones."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    scores = F.array(*shard_scores(key, weights))
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def with_slots(rows: DataFrame, shard: str, key: str) -> DataFrame:
    """Adds `slot`: a place in the shard, gapless from 0, in the order of md5(key), then key.

    Each shard is numbered in buckets of the digest's range, so no task gets a whole shard.
    """
    digits = buckets_for(rows.count())
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = rows.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, digits))
    return running_total(rows, [shard], "_bucket", [F.col("_digest"), F.col(key)], F.lit(1), "slot").drop("_digest", "_bucket")


def shard_documents(docs: DataFrame, shards: int = 16, weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard (the shard if there were one more)."""
    weights = list(weights or [1.0] * shards)
    grown = [*weights, sum(weights) / len(weights)]
    doc = F.col("doc_id")
    rows = docs.select(
        doc, (F.octet_length(whole("text")) + 1).cast("long").alias("size"), F.crc32(whole("text").cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(doc, weights).alias("shard"), rendezvous(doc, grown).alias("grown_shard"),
    )
    placed = with_slots(table(rows, "shards"), "shard", "doc_id")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")

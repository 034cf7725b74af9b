"""Answer streams: server-sent events as rows and as frames, and append-only ingest with Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.answer import evidence
from ..schema import MIN_PAGE_CHARS


def frame(name: str, payload: object) -> str:
    """One event as it goes over the wire."""
    return f"event: {name}\ndata: {json.dumps(payload, ensure_ascii=False)}\n\n"


def frames(chunks: Iterable[str]) -> Iterator[tuple[str, object]]:
    """Events put together again from a stream cut anywhere; an unfinished frame is kept back."""
    held = ""
    for chunk in chunks:
        held += chunk
        *whole, held = held.split("\n\n")
        for text in whole:
            fields = dict(line.split(": ", 1) for line in text.split("\n") if ": " in line)
            if "event" in fields and "data" in fields:
                yield fields["event"], json.loads(fields["data"])


def answer_events(queries: DataFrame, hits: DataFrame, tokens: DataFrame) -> DataFrame:
    """qid, seq, name, payload: `empty`, or `sources`, each `token` (qid, at, fragment; empty ones left out) and `done`."""
    found = evidence(hits)
    listed = F.array_sort(F.collect_list(F.struct("rank", "text", "score", "source", "pages")))
    sources = found.groupBy("qid").agg(F.to_json(listed).alias("payload"))
    answered = queries.select("qid").join(sources, "qid", "left")
    nothing = F.lit("{}")
    first = answered.select("qid", F.lit(0).cast("long").alias("seq"), F.when(F.col("payload").isNull(), "empty").otherwise("sources").alias("name"), F.coalesce("payload", nothing).alias("payload"))
    said = tokens.where("length(fragment) > 0").join(sources.select("qid"), "qid", "left_semi")
    said = said.select("qid", (F.col("at") + 1).cast("long").alias("seq"), F.lit("token").alias("name"), F.to_json(F.array("fragment")).alias("payload"))
    said = said.withColumn("payload", F.expr("substring(payload, 2, length(payload) - 2)"))
    last = sources.join(said.groupBy("qid").agg(F.max("seq").alias("_last")), "qid", "left")
    last = last.select("qid", (F.coalesce("_last", F.lit(0)) + 1).alias("seq"), F.lit("done").alias("name"), nothing.alias("payload"))
    return first.unionByName(said).unionByName(last)


def framed(events: DataFrame) -> DataFrame:
    """Adds frame: the event as text."""
    return events.withColumn("frame", F.concat(F.lit("event: "), "name", F.lit("\ndata: "), "payload", F.lit("\n\n")))


def follow_pages(spark: SparkSession, folder: str, schema: str, to: str, checkpoint: str) -> None:
    """Append-only variant of page diagnosis: takes up files that are new since the last run, then ends.

    A file source sees new files only; edits and deletions need the manifest's comparison in plans.lifecycle.
    """
    pages = spark.readStream.schema(schema).parquet(folder)
    counted = pages.withColumn("image_only", F.length(F.coalesce("text", F.lit(""))) < MIN_PAGE_CHARS)
    query = counted.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

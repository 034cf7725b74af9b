"""Incremental ingest: what changed, and the next snapshot.

Files on disk are compared with the manifest by digest, in one plan for all files. Re-ingested documents replace their
chunks, vanished ones lose them, and the manifest is published together with the corpus, so that a document is marked
only when all its chunks are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.text import sanitize
from ..models import Captioner, Embedder, Extractor
from ..operators.chunk import chunks_of_blocks
from ..operators.diagnose import ocr_decisions
from ..operators.lexical import postings_of
from ..schema import CHUNK_SIZE
from ..sources.postings import impacts_of, lengths_of
from ..sources.store import Store
from ..sources.work import work_table

#: Texts that an embedder gets at a time.
BATCH = 32


def effective_manifest(manifest: DataFrame, corpus: DataFrame) -> DataFrame:
    """source, digest: markers win over digests that older stores keep with each chunk (the last chunk's)."""
    legacy = corpus.where("coalesce(file_hash, '') <> ''").groupBy("source").agg(F.max_by("file_hash", "ord").alias("legacy"))
    joined = manifest.select("source", "digest").join(legacy, "source", "full_outer")
    return joined.select("source", F.coalesce("digest", "legacy").alias("digest"))


def sync_plan(files: DataFrame, manifest: DataFrame, corpus: DataFrame, forced: list[str] | None = None) -> DataFrame:
    """source, status of everything on disk or in the store, from files (source, digest).

    skip: unchanged; changed: another digest, or forced; interrupted: chunks without a marker; new; deleted: not on disk.
    """
    marked = effective_manifest(manifest, corpus).withColumnRenamed("digest", "_marked")
    stored = corpus.select("source").distinct().withColumn("_stored", F.lit(True))
    joined = files.select("source", "digest").join(marked, "source", "full_outer").join(stored, "source", "full_outer")
    status = (
        F.when(F.col("digest").isNull(), "deleted").when(F.col("source").isin(forced or []), "changed").when(F.col("_marked") == F.col("digest"), "skip")
        .when(F.col("_marked").isNotNull(), "changed").when(F.col("_stored"), "interrupted").otherwise("new")
    )
    return joined.select("source", status.alias("status"))


def any_changed(plan: DataFrame) -> DataFrame:
    """One row: whether a sync has anything to do."""
    return plan.agg(F.coalesce(F.bool_or(F.col("status") != "skip"), F.lit(False)).alias("changed"))


def sync_apply(plan: DataFrame, corpus: DataFrame, fresh: DataFrame) -> DataFrame:
    """The next corpus: chunks of skipped documents and the fresh chunks of re-ingested ones."""
    stays = plan.where("status = 'skip'").select("source")
    again = plan.where("status in ('changed', 'interrupted', 'new')").select("source")
    return corpus.join(stays, "source", "left_semi").unionByName(fresh.join(again, "source", "left_semi"))


def next_manifest(files: DataFrame, corpus: DataFrame) -> DataFrame:
    """A marker for every file on disk; one without any text is marked with no chunks, and not tried again."""
    sizes = corpus.groupBy("source").agg(F.count("*").alias("n_chunks"))
    return files.select("source", "digest").join(sizes, "source", "left").select("source", "digest", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))


def embedded(df: DataFrame, column: str, embedder: Embedder) -> DataFrame:
    """Adds embedding, BATCH texts at a time."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors: list[list[float]] = []
            for at in range(0, len(texts), BATCH):
                vectors.extend(embedder.embed([sanitize(t or "") for t in texts[at : at + BATCH]]))
            yield pd.Series(vectors)

    return df.withColumn("embedding", embed(F.col(column)))


def routed(files: DataFrame, extractor: Extractor) -> DataFrame:
    """Adds ocr to files (source, content): how their text layers say that they are to be read."""

    def layers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, sanitize(t)) for s, c in zip(batch["source"], batch["content"]) for t in extractor.layer(c)]
            yield pd.DataFrame(rows, columns=["source", "text"])

    modes = ocr_decisions(files.select("source", "content").mapInPandas(layers, "source string, text string")).select("source", "ocr")
    return files.join(modes, "source", "left").withColumn("ocr", F.coalesce("ocr", F.lit("none")))


def extracted(files: DataFrame, extractor: Extractor) -> DataFrame:
    """Blocks (source, block_no, pages, text) of files (source, content)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = zip(batch["source"], batch["content"], batch["ocr"])
            rows = [(s, i, pages, sanitize(t)) for s, c, ocr in files for i, (pages, t) in enumerate(extractor.blocks(c, ocr))]
            yield pd.DataFrame(rows, columns=["source", "block_no", "pages", "text"])

    return routed(files, extractor).select("source", "content", "ocr").mapInPandas(read, "source string, block_no int, pages array<int>, text string")


def _touched(store: Store, changed: DataFrame) -> list[int]:
    """The buckets of these sources: as many as the store has, at most."""
    return sorted(r.bucket for r in changed.select(store.bucket().alias("bucket")).distinct().collect())


def ingest(store: Store, files: DataFrame, extractor: Extractor, embedder: Embedder, forced: list[str] | None = None) -> bool:
    """Bring the store up to date with files (source, content, digest); whether anything changed.

    Only buckets with a changed document are written: their passages, markers, postings, impacts and lengths."""
    plan = sync_plan(files, store.read("manifest"), store.read("corpus"), forced).persist()
    try:
        touched = _touched(store, plan.where("status <> 'skip'"))
        if not touched:
            return False
        again = plan.where("status in ('changed', 'interrupted', 'new')").select("source")
        blocks = work_table(extracted(files.join(again, "source", "left_semi"), extractor), "extracted")
        chunks = embedded(chunks_of_blocks(blocks), "text", embedder)
        # by the hash of the source; two sources that share it are told apart by id wherever ord decides
        order = F.xxhash64("source").bitwiseAND(0x3FFFFFFF) * F.lit(1 << 32) + F.col("chunk_ix")
        fresh = chunks.select("id", "source", order.alias("ord"), "text", "pages", "embedding", F.lit(None).cast("string").alias("file_hash"))
        draft = store.draft()
        corpus = draft.put("corpus", sync_apply(plan, store.read("corpus", touched), fresh), touched)
        postings = draft.put("postings", postings_of(corpus), touched, order="term")
        known = store.read("lengths").agg(F.sum("total") / F.sum("n")).first()[0]
        draft.put("impacts", impacts_of(postings, max(1.0, known or CHUNK_SIZE / 8)), touched, order="term")
        draft.put("lengths", lengths_of(corpus, "source"), touched)
        draft.put("manifest", next_manifest(files.where(store.bucket().isin(touched)), corpus), touched)
        draft.publish()
        return True
    finally:
        plan.unpersist()


def reindex(store: Store, files: DataFrame, extractor: Extractor, embedder: Embedder, name: str) -> bool:
    """Ingest one document again whatever its digest; if its file is gone, its chunks go."""
    return ingest(store, files, extractor, embedder, forced=[name.rsplit("/", 1)[-1]])


def sync_gallery(store: Store, files: DataFrame, captioner: Captioner, embedder: Embedder) -> bool:
    """Bring the gallery up to date with image files (source, path, content, digest); whether anything changed."""
    gallery = store.read("gallery")
    joined = files.select("source", "path", "digest").join(gallery.select("source", F.coalesce("file_hash", F.lit("")).alias("_known")), "source", "full_outer").persist()
    try:
        changed = joined.where("digest is null or _known is null or digest <> _known")
        if not changed.take(1):
            return False

        @F.pandas_udf("string")
        def describe(paths: pd.Series) -> pd.Series:
            return paths.map(lambda p: sanitize(captioner.describe(p) or ""))

        again = changed.where("digest is not null").withColumn("caption", describe(F.col("path")))
        fresh = embedded(again, "caption", embedder).select("source", "path", "caption", F.col("digest").alias("file_hash"), "embedding")
        touched = _touched(store, changed)
        kept = store.read("gallery", touched).join(changed.select("source"), "source", "left_anti")
        draft = store.draft()
        draft.put("gallery", kept.unionByName(fresh), touched)
        draft.publish()
        return True
    finally:
        joined.unpersist()

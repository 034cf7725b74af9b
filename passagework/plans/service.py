"""The library's facade: a store kept up to date, searched and asked."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sanitize
from ..models import Captioner, Embedder, Extractor, Generator, HashEmbedder, NameCaptioner, OverlapScorer, PairScorer, PlainTextExtractor, QuotingGenerator
from ..operators.answer import NO_CONTEXT, evidence, evidence_markdown, prompts
from ..operators.gallery import gallery_search
from ..operators.rerank import pair_scores
from ..operators.retrieve import Options, retrieve
from ..sources.files import document_files, image_files, with_digest
from ..sources.postings import PostingsIndex
from ..sources.store import Store
from . import lifecycle

EXTRACTOR_VERSION, VISION_VERSION = "text-1", "names-1"


class Service:
    """Documents and images of two folders, in a store of so many buckets, with pluggable models."""

    def __init__(
        self, spark: SparkSession, docs: str, store: str, images: str | None = None, embedder: Embedder | None = None, scorer: PairScorer | None = None,
        generator: Generator | None = None, extractor: Extractor | None = None, captioner: Captioner | None = None, suffix: str = "pdf", buckets: int = 64,
    ) -> None:
        self.spark, self.docs, self.images, self.suffix = spark, docs, images, suffix
        self.store = Store(spark, store, buckets)
        self.embedder, self.scorer, self.generator = embedder or HashEmbedder(), scorer or OverlapScorer(), generator or QuotingGenerator()
        self.extractor, self.captioner = extractor or PlainTextExtractor(), captioner or NameCaptioner()

    def files(self) -> DataFrame:
        return with_digest(document_files(self.spark, self.docs, self.suffix), EXTRACTOR_VERSION)

    def refresh(self) -> int:
        """Take up what changed on disk; how many chunks there are now."""
        lifecycle.ingest(self.store, self.files(), self.extractor, self.embedder)
        return self.chunks()

    def chunks(self) -> int:
        """How many chunks there are, by the markers."""
        return self.store.read("manifest").agg(F.coalesce(F.sum("n_chunks"), F.lit(0))).first()[0]

    def reindex(self, name: str) -> bool:
        return lifecycle.reindex(self.store, self.files(), self.extractor, self.embedder, name)

    def refresh_gallery(self) -> int:
        if self.images:
            lifecycle.sync_gallery(self.store, with_digest(image_files(self.spark, self.images), VISION_VERSION), self.captioner, self.embedder)
        return self.images_known()

    def status(self) -> dict[str, object]:
        """Counts, and the names of all documents that have chunks, from their markers."""
        sources = [r[0] for r in self.store.read("manifest").where("n_chunks > 0").select("source").orderBy("source").collect()]
        return {"chunks": self.chunks(), "sources": sources, "images": self.images_known()}

    def images_known(self) -> int:
        return self.store.read("gallery").count()

    def queries(self, texts: list[str]) -> DataFrame:
        """A block of queries: qid, query, vector."""
        clean = [sanitize(t).strip() for t in texts]
        vectors = self.embedder.embed(clean) if clean else []
        return self.spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(zip(clean, vectors))], "qid int, query string, vector array<float>")

    def retrieve(self, texts: list[str], options: Options = Options(top_n=4, rerank=True)) -> DataFrame:
        scorer = self.scorer
        score = pair_scores(type(scorer).__name__, lambda: scorer, F.col("query"), F.col("text")) if options.rerank else None
        # a store that was written before there were impacts has them only where a sync has been since
        parts = self.store.parts()
        complete = set(parts.get("impacts", {})) == set(parts.get("postings", {}))
        index = PostingsIndex(self.store.read("postings"), self.store.read("lengths"), self.store.read("impacts") if complete else None)
        return retrieve(self.store.read("corpus"), self.queries(texts), options, score, index)

    def search(self, texts: list[str], options: Options = Options(top_n=4, rerank=True)) -> DataFrame:
        return evidence(self.retrieve(texts, options))

    def markdown(self, texts: list[str], options: Options = Options(top_n=4, rerank=True)) -> DataFrame:
        return evidence_markdown(self.search(texts, options), self.queries(texts))

    def stream_answer(self, question: str, hits: DataFrame, temperature: float = 0.0) -> Iterator[str]:
        """Fragments of an answer from hits; a missing fragment is an empty one."""
        prompt = prompts(hits).first()
        if prompt is not None:
            for fragment in self.generator.stream(prompt["prompt"], sanitize(question), temperature):
                yield fragment or ""

    def answer(self, question: str, options: Options = Options(top_n=4, rerank=True), temperature: float = 0.0) -> tuple[str, list]:
        """An answer and its evidence; without any, a fixed answer."""
        hits = self.retrieve([question], options).persist()
        try:
            found = evidence(hits).orderBy("rank").collect()
            return ("".join(self.stream_answer(question, hits, temperature)), found) if found else (NO_CONTEXT, [])
        finally:
            hits.unpersist()

    def find_images(self, texts: list[str], top_n: int = 6) -> DataFrame:
        return gallery_search(self.store.read("gallery"), self.queries(texts), top_n)

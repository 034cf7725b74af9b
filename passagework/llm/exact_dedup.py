"""Exact deduplication through a log-structured merge index of text digests.

- Flush: each input slice is a memtable. Its rows become (digest, identifier), sorted by digest, one file a task: a
  sorted run. No shuffle.
- Compact: all runs merge into one sorted run with one row a digest: the copies and the identifier that stays. Partial
  sums come before the shuffle, so a digest that a third of the rows share costs one row a task. Spark merges by hash
  and sorts what comes out; it has no merge of sorted files.
- Filter: the hits (digests of more than one row) go into a filter of bits, of 64 MB at most, that is broadcast. Only
  texts that it lets through are read any further: nothing else is shuffled, neither to verify nor to deduplicate.
- Verify: the smallest and the largest text of a hit must be the same bytes. Digests that fail are told apart by the
  text itself.

"Smallest identifier" is smallest in the index's order; `keep="largest"` turns that order round.

Nulls: a null text counts as empty. A null identifier loses to any other; if a group has no other, one such row stays.
Repeated rows (same text and identifier): one of them stays. An empty table gives an empty result. Further columns are
not read by the index and pass through `deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, never_null, new_path, table, whole, whole_row, with_maybe

#: A digest of more than this share of the rows (and LEAST_HOT rows) is joined by broadcast: no more than 1 / HOT_SHARE
#: digests, 5,000 rows of some 50 bytes, can be so common.
HOT_SHARE, LEAST_HOT = 1 / 5_000, 1_000


def digest_of(text: Column) -> Column:
    """The text's SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestIndex:
    """A log-structured index of digests in a folder that all executors share: `runs` and the compacted `level1`."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "largest") -> None:
        if keep not in ("largest", "smallest"):
            raise ValueError("keep is 'largest' or 'smallest'")
        self.spark, self.path, self.keep = spark, path or new_path(spark, "lsm"), keep

    def _write(self, df: DataFrame, to: str, mode: str) -> None:
        sorted_runs = df.sortWithinPartitions("digest")
        sorted_runs.write.mode(mode).option("compression", "zstd").parquet(f"{self.path}/{to}")

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Append the sorted runs of these documents."""
        self._write(docs.select(digest_of(whole(text_col)).alias("digest"), F.col(id_col).cast("long").alias("id")), "runs", "append")

    def runs(self) -> DataFrame:
        return self.spark.read.schema("digest binary, id long").parquet(f"{self.path}/runs")

    def compact(self) -> DataFrame:
        """Merge all runs; one row a digest: copies, keep_id."""
        best = F.max("id") if self.keep == "largest" else F.min("id")
        self._write(self.runs().groupBy("digest").agg(F.count("*").alias("copies"), best.alias("keep_id")), "level1", "overwrite")
        return self.level1()

    def level1(self) -> DataFrame:
        return self.spark.read.schema("digest binary, copies long, keep_id long").parquet(f"{self.path}/level1")

    def hits(self) -> DataFrame:
        """The filter of the digests that more than one row has."""
        return bit_filter(self.level1().where("copies > 1"), "digest")

    def collisions(self, docs: DataFrame, hits: DataFrame | None = None, text_col: str = "text") -> DataFrame:
        """Byte verification of all hits: the digests that stand for more than one text (none, in practice).

        The filter stands in the scan, and every task folds its rows of a digest to the smallest and the largest text
        before anything is shuffled: texts without a copy stay where they are, and a text that a third of the rows
        share travels twice a task. What the filter lets through by mistake has one text and so is no collision.
        """
        texts = docs.select(whole(text_col).alias("_text")).withColumn("digest", digest_of(F.col("_text")))
        texts = with_maybe(texts, "digest", hits or self.hits()).where("_maybe")
        spread = texts.groupBy("digest").agg(F.min("_text").alias("_low"), F.max("_text").alias("_high"))
        return spread.where("_low <> _high").select("digest")

    def probe(self) -> DataFrame:
        """Every indexed row with its group: digest, id, keep_id, copies, kept. Hot digests are joined by broadcast."""
        rows = self.runs().groupBy("digest", "id").agg(F.count("*").alias("_same"))
        groups = self.level1()
        most = max(LEAST_HOT, int((groups.agg(F.sum("copies")).first()[0] or 0) * HOT_SHARE))
        hot = F.broadcast(groups.where(F.col("copies") > most))
        cold = groups.where(F.col("copies") <= most)
        joined = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest"))
        stays = F.col("id").eqNullSafe(F.col("keep_id"))
        copy = F.explode(F.sequence(F.lit(1), F.col("_same"))).alias("_copy")
        return joined.select("digest", "id", "keep_id", "copies", stays.alias("_stays"), copy).select(
            "digest", "id", "keep_id", "copies", (F.col("_stays") & (F.col("_copy") == 1)).alias("kept")
        )


def _plain(docs: DataFrame, text_col: str, id_col: str, keep: str) -> DataFrame:
    """Groups by the text itself, for digests that stand for more than one text."""
    best = F.max(id_col) if keep == "largest" else F.min(id_col)
    rows = docs.groupBy("_digest", F.col(text_col).alias("_text"), F.col(id_col).alias("id")).agg(F.count("*").alias("_same"))
    groups = docs.groupBy("_digest", F.col(text_col).alias("_text")).agg(F.count("*").alias("copies"), best.alias("keep_id"))
    joined = rows.join(groups, ["_digest", "_text"]).select("*", F.explode(F.sequence(F.lit(1), F.col("_same"))).alias("_copy"))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    return joined.select(F.col("_digest").alias("digest"), "id", "keep_id", "copies", kept.alias("kept"))


def _decided(docs: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    """One row a document (digest, id, keep_id, copies, kept), and the filter of the digests of more than one row."""
    index = DigestIndex(docs.sparkSession, keep=keep)
    index.flush(docs)
    index.compact()
    hits = index.hits()
    clashes = table(index.collisions(docs, hits), "collisions")
    if clashes.isEmpty():
        return index.probe(), hits
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text")).withColumn("_digest", digest_of(F.col("text")))
    apart = _plain(rows.join(clashes, F.col("_digest") == F.col("digest"), "left_semi"), "text", "doc_id", keep)
    return index.probe().join(clashes, "digest", "left_anti").unionByName(apart), hits


def decide(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row a document: digest, id, keep_id, copies, kept."""
    return _decided(docs, keep)[0]


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document, dropped ones too; the largest doc_id stays."""
    return decide(docs).select(
        F.col("id").alias("doc_id"), "keep_id", F.col("copies").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicate(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The documents that stay, one of each group of equal texts, with all their columns.

    A text that the filter of the hits hasn't seen has one row, which stays without a shuffle."""
    decided, hits = _decided(docs, keep)
    stay = decided.where("kept").select(F.col("digest").alias("_key"), never_null("id").alias("_doc"))
    rows = docs.select(whole_row(docs), digest_of(whole("text")).alias("_key"), never_null("doc_id").alias("_doc"))
    rows = with_maybe(rows, "_key", hits)
    several = rows.where("_maybe").join(stay, ["_key", "_doc"], "left_semi").dropDuplicates(["_key", "_doc"])
    return rows.where("not _maybe").select("_row").unionByName(several.select("_row")).select("_row.*")

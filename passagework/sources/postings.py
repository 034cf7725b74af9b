"""Stored postings: what a lexical search reads instead of texts.

postings: term, id, ord, source, dl, tf, sorted by term within a file, so that row groups without a wanted term are
skipped; impacts: by term, source and range of RANGE store places how many postings there are, and the largest impact, tf / (tf + k1 *
(1 - b + b * dl / avgdl)), at the average length of that time. Their numbers add up to document frequencies. At another
average length no impact is larger than that times the ratio of the averages (or than that, if the average fell);
lengths: n and total, the passages and words that the average length is made of, one row a part of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.lexical import K1, B, postings_of

#: Words that a scan is given as literals, for the row groups' statistics; beyond, the join alone selects.
MOST_LITERALS = 200
#: Store places of a range.
RANGE = 2_048


def block_of(ord_: Column) -> Column:
    """The range that a passage's place in the store lies in."""
    return F.floor(ord_ / RANGE)


def impacts_of(postings: DataFrame, avgdl: float) -> DataFrame:
    """term, source, block, n, impact, at_avgdl of postings; pre-aggregated, a hot term's rows part by source and block."""
    grouped = postings.groupBy("term", "source", block_of(F.col("ord")).alias("block"))
    impact = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    return grouped.agg(F.count("*").alias("n"), F.max(impact).alias("impact")).withColumn("at_avgdl", F.lit(avgdl))


def lengths_of(corpus: DataFrame, *by: str) -> DataFrame:
    """n, total by the given columns."""
    return corpus.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.size(tokens(F.col("text")))).cast("long").alias("total"))


class PostingsIndex:
    """Tables of postings, lengths and impacts, and what a search asks of them. Without impacts all postings of a query's
    words are scored."""

    def __init__(self, postings: DataFrame, lengths: DataFrame, impacts: DataFrame | None = None) -> None:
        self.postings, self.lengths, self.impacts = postings, lengths, impacts

    @classmethod
    def write(cls, corpus: DataFrame, path: str) -> PostingsIndex:
        """Count a corpus's postings, once, and store them; the whole is there when `lengths` is, which comes last."""
        # rebalanced, so that the postings of a common word part
        dealt = postings_of(corpus).hint("rebalance", "term").sortWithinPartitions("term", "source", "ord")
        dealt.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
        lengths = lengths_of(corpus).first()
        impacts = impacts_of(corpus.sparkSession.read.parquet(f"{path}/postings"), max(1.0, (lengths.total or 0) / max(1, lengths.n)))
        impacts.hint("rebalance", "term").sortWithinPartitions("term", "source", "block").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/impacts")
        corpus.sparkSession.createDataFrame([lengths], "n long, total long").write.mode("overwrite").parquet(f"{path}/lengths")
        return cls.at(corpus.sparkSession, [path])

    @classmethod
    def at(cls, spark: SparkSession, paths: Sequence[str]) -> PostingsIndex:
        return cls(*(spark.read.parquet(*(f"{p}/{name}" for p in paths)) for name in ("postings", "lengths", "impacts")))

    def stats(self) -> DataFrame:
        """One row: n, avgdl."""
        return self.lengths.agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("avgdl"))

    def of(self, vocabulary: DataFrame) -> DataFrame:
        """The postings of the words in vocabulary (term, distinct)."""
        return self.narrowed(self.postings, vocabulary).join(vocabulary, "term", "left_semi")

    def narrowed(self, rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
        """Rows (term, further columns) of a few words, by a filter that the scan can use; of many, all."""
        words = [r.term for r in vocabulary.limit(MOST_LITERALS + 1).collect()]
        return rows.where(F.col("term").isin(words)) if len(words) <= MOST_LITERALS else rows


def kept_index(spark: SparkSession, folder: str, corpus: DataFrame) -> PostingsIndex:
    """The postings of a corpus that is made of a table's files, kept for as long as the driver runs.

    They are found again by the files' names, lengths and times: other files are another corpus. They stand in
    spark.checkpoint.dir, which the driver and the executors share; in one of our own where that is unset, as in tests."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    seen = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in files.listStatus(path))
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or "/tmp/checkpoints/passagework"
    at = f"{base.rstrip('/')}/postings-{hashlib.md5(repr((folder, seen, spark.sparkContext.applicationId)).encode()).hexdigest()}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/lengths/_SUCCESS")
    store = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(done):
        return PostingsIndex.at(spark, [at])
    made = PostingsIndex.write(corpus, at)
    store.deleteOnExit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at))
    return made

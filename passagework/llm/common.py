"""What several corpus operators share: the shared work folder, distributed prefix sums, word counts."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Runs of anything but ASCII white space: the words of a text.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or the one that the context was given.

    Where neither is set, one of our own, but only if everything runs on this machine: a local folder of a cluster's
    machines isn't shared.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (path or "/tmp/checkpoints/passagework").rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; it goes when the driver's JVM ends, or before that by `remove`."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, hadoop = _file_system(spark, path)
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work folder, at once."""
    files, hadoop = _file_system(spark, path)
    files.delete(hadoop, True)
    files.cancelDeleteOnExit(hadoop)


#: Bytes of an Arrow batch at most, or one row. With Spark's own bound (64 MB) 10,000 whole texts make a batch, which every
#: worker and the JVM that feeds it hold several times over.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python functions of the jobs that run meanwhile get their rows in Arrow batches of BATCH_BYTES."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors. Arrow batches
    are small ones."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("append").option("compression", "zstd")
    for key, value in options.items():
        writer = writer.option(key, value)
    with small_batches(spark):
        writer.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._work_path = path
    return found


def drop(*tables: DataFrame) -> None:
    """Delete work tables (as `table` returned them) that nothing will read again."""
    for found in tables:
        remove(found.sparkSession, found._work_path)


def whole(text: str | Column) -> Column:
    """A text, null as the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def never_null(column: str) -> Column:
    """A key's text, or a text that no key has: joins on it are plain, and share their partitioning with sums and windows."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def whole_row(df: DataFrame) -> Column:
    """All columns in one struct, `_row`, out of the way of an operator's own names."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")


def n_words(text: str | Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def buckets_for(rows: int) -> int:
    """How many hex digits of a digest to bucket hashed rows by: about as many buckets as a bucket has rows."""
    return max(1, round(math.log(max(1, rows), 16) / 2))


def running_total(rows: DataFrame, groups: Sequence[str], bucket: str, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same group that come before, by (bucket, *order).

    Buckets are ranges of the order, so no task holds a whole group: one window numbers the rows of a bucket, another
    sums the buckets' totals (one row per group and bucket). Group columns must not be null.
    """
    keys = [*groups, bucket]
    rows = rows.withColumn("_value", value)
    before = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    totals = rows.groupBy(*keys).agg(F.sum("_value").alias("_total"))
    base = totals.select(*keys, (F.sum("_total").over(before.orderBy(bucket)) - F.col("_total")).alias("_base"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(base, keys).withColumn(out, F.col("_base") + F.sum("_value").over(within) - F.col("_value")).drop("_base", "_value")


#: Bits of one bitmap, as `bitmap_construct_agg` makes them; bits a key; bitmaps at most (64 MB, whatever the input).
BITMAP, BITS_A_KEY, MOST_BITMAPS = 32_768, 16, 16_384


def bit_filter(keys: DataFrame, key: str | Column) -> DataFrame:
    """A filter of hashed keys: rows of (_bitmap_no, _bits), MOST_BITMAPS at most, with the number of all in `_bitmaps`.

    Past some 30 million keys it lets more strangers through, and never loses a key.
    """
    n = keys.count()
    bitmaps = min(MOST_BITMAPS, max(1, -(-n * BITS_A_KEY // BITMAP)))
    hashed = keys.select(F.xxhash64(key).alias("_hash"))
    rows = hashed.select(F.pmod("_hash", F.lit(bitmaps)).alias("_bitmap_no"), F.pmod(F.xxhash64("_hash"), F.lit(BITMAP)).alias("_bit"))
    made = rows.groupBy("_bitmap_no").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    found = table(made, "filter")
    found._bitmaps = bitmaps
    return found


def with_maybe(rows: DataFrame, key: str | Column, keys_filter: DataFrame) -> DataFrame:
    """Adds `_maybe`: false where the filter has surely not seen the key. No shuffle: the filter is broadcast."""
    rows = rows.withColumn("_key_hash", F.xxhash64(key)).withColumn("_bitmap_no", F.pmod("_key_hash", F.lit(keys_filter._bitmaps)))
    joined = rows.join(F.broadcast(keys_filter), "_bitmap_no", "left")
    bit = F.pmod(F.xxhash64("_key_hash"), F.lit(BITMAP)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    seen = F.getbit(byte, bit.bitwiseAND(7)) == 1
    return joined.withColumn("_maybe", F.coalesce(seen, F.lit(False))).drop("_key_hash", "_bitmap_no", "_bits")

"""Scans of document and image folders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, digest

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp")


def _names(spark: SparkSession, folder: str) -> list[tuple[str, str]] | None:
    """Name and path of a flat folder's files; None if there is no such folder. Listed on the driver, as Spark lists, too."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(s.getPath().getName(), s.getPath().toString()) for s in files.listStatus(path) if s.isFile()] if files.exists(path) else None


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """source, path, content of paths."""
    from pyarrow import fs

    for batch in batches:
        found = []
        for path in batch["path"]:
            files, at = fs.FileSystem.from_uri(path)
            with files.open_input_stream(at) as stream:
                found.append(stream.read())
        yield pd.DataFrame({"source": batch["source"], "path": batch["path"], "content": found})


def _read(spark: SparkSession, folder: str, pattern: str, known: list[tuple[str, str]]) -> DataFrame:
    """source, path, content of the folder's files by a pattern, and of those known that Spark takes for hidden ones."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    files = files.select(basename(F.col("path")).alias("source"), "path", "content")
    hidden = [(name, path) for name, path in known if name[0] in "._"]
    if not hidden:
        return files
    others = spark.createDataFrame(hidden, "source string, path string").mapInPandas(_contents, "source string, path string, content binary")
    return files.unionByName(others)


def document_files(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """source, path, content of a flat folder's documents; the suffix's case counts, dot-files don't."""
    known = [(n, p) for n, p in _names(spark, folder) or [] if n.endswith(f".{suffix}") and not n.startswith(".")]
    return _read(spark, folder, f"[!._]*.{suffix}", known)


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """source, path, content of a folder's images, suffixes in any case, dot-files too; a missing folder has none."""
    known = _names(spark, folder)
    if known is None:
        return spark.createDataFrame([], "source string, path string, content binary")
    suffix = F.lower(F.element_at(F.split("source", r"\."), -1))
    return _read(spark, folder, "*.*", [(n, p) for n, p in known if n.lower().rsplit(".", 1)[-1] in IMAGE_SUFFIXES and "." in n[1:]]).where(suffix.isin(*IMAGE_SUFFIXES))


def with_digest(files: DataFrame, version: str) -> DataFrame:
    """Adds a digest of content and version; the content column itself isn't shuffled anywhere."""
    return files.withColumn("digest", digest(F.col("content"), version))


def file_place(name: Column) -> Column:
    """A served file's name without any folder, so that no request leaves the folder."""
    return basename(F.replace(name, F.lit("\\"), F.lit("/")))

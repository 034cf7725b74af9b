"""A versioned store on plain Parquet, written by parts: a pointer that is written last publishes a snapshot.

Rows are dealt to buckets by the hash of their source. A bucket's rows of a table are a folder that is never changed;
a snapshot is a list of such folders. A sync writes the buckets that it touches and refers to the others where they
are, so its cost is that of the touched buckets. A reader sees either all of a sync or nothing of it; one that dies
before the pointer leaves the old snapshot in force.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CORPUS, GALLERY, IMPACTS, LENGTHS, MANIFEST, POSTINGS

TABLES = {"corpus": CORPUS, "manifest": MANIFEST, "gallery": GALLERY, "postings": POSTINGS, "impacts": IMPACTS, "lengths": LENGTHS}


class Store:
    """A folder that all executors share: data/<id>/_bucket=<n>, snapshot-<id>.json and the file CURRENT.

    `buckets` holds for a store's whole life: choose it so that a bucket is some hundred megabytes.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _write_text(self, name: str, text: str) -> None:
        path, fs = self._fs(name)
        stream = fs.create(path, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def current(self) -> str | None:
        path, fs = self._fs("CURRENT")
        return self.spark.read.text(f"{self.path}/CURRENT").first()[0] if fs.exists(path) else None

    def parts(self) -> dict[str, dict[str, str]]:
        """Of the current snapshot: table -> bucket -> folder."""
        at = self.current()
        if at is None:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/{at}.json", wholetext=True).first()[0])

    def bucket(self, source: str = "source") -> Column:
        return F.pmod(F.xxhash64(source), F.lit(self.buckets)).cast("int")

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table of the current snapshot, or some of its buckets; empty, with its schema, before the first."""
        return self._rows(table, self.parts().get(table, {}), buckets)

    def _rows(self, table: str, parts: dict[str, str], buckets: Iterable[int] | None) -> DataFrame:
        schema = TABLES[table]
        wanted = parts if buckets is None else {str(b) for b in buckets} & set(parts)
        folders = [f"{self.path}/{parts[b]}" for b in sorted(wanted)]
        return self.spark.read.schema(schema).parquet(*folders).select(schema.names) if folders else self.spark.createDataFrame([], schema)

    def draft(self) -> Draft:
        return Draft(self)

    def vacuum(self) -> int:
        """Delete the folders that the current snapshot doesn't refer to; how many. Not while older snapshots are read."""
        kept = {folder.split("/")[1] for parts in self.parts().values() for folder in parts.values()}
        path, fs = self._fs("data")
        stale = [s.getPath() for s in (fs.listStatus(path) if fs.exists(path) else []) if s.getPath().getName() not in kept]
        for folder in stale:
            fs.delete(folder, True)
        return len(stale)


class Draft:
    """The next snapshot, as far as it is written."""

    def __init__(self, store: Store) -> None:
        self.store, self.parts = store, store.parts()

    def put(self, table: str, rows: DataFrame, buckets: Iterable[int], order: str | None = None) -> DataFrame:
        """Replace a table's rows in these buckets; the new rows as they stand in the draft. `order` sorts each file."""
        store, at = self.store, f"data/{uuid.uuid4().hex}"
        dealt = rows.select(TABLES[table].names).withColumn("_bucket", store.bucket()).hint("rebalance", "_bucket")
        dealt = dealt.sortWithinPartitions("_bucket", *([order] if order else []))
        dealt.write.partitionBy("_bucket").parquet(f"{store.path}/{at}")
        path, fs = store._fs(at)
        written = {s.getPath().getName().removeprefix("_bucket="): f"{at}/{s.getPath().getName()}" for s in fs.listStatus(path) if s.isDirectory()}
        touched = {str(b) for b in buckets}
        if not set(written) <= touched:
            raise ValueError(f"rows outside the buckets that are replaced: {sorted(set(written) - touched)}")
        self.parts[table] = {b: f for b, f in self.parts.get(table, {}).items() if b not in touched} | written
        return store._rows(table, self.parts[table], touched)

    def publish(self) -> str:
        """Make the draft the current snapshot."""
        name = f"snapshot-{uuid.uuid4().hex}"
        self.store._write_text(f"{name}.json", json.dumps(self.parts))
        self.store._write_text("CURRENT", name)
        return name

"""A quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts. A text is cut into blocks of
BLOCK bytes (all of it), each block is compressed with both; with g and h the summed sizes, d = (h - g) / (h + g) is
positive where the good dictionary fits better. Boilerplate repeated many times shrinks under either dictionary, so the
calibration also sees r = log(g / bytes). A ridge logistic regression on (d, r, d², r²) turns them into a probability.

Dictionaries learn from one part of the labelled rows, the calibration from another, so that a text's own copy in a
dictionary doesn't flatter the calibration. Both parts are bounded samples (SAMPLE rows a class, MAX_BYTES of text a
class, by md5 of doc_id), so the fit costs the same at every size; scoring covers every whole text.

Nulls and empty texts score as (d, r) = (0, 0) of the calibration's scale. Repeated rows get equal scores. Of rows that
share a labelled id the first text is learned from, and of conflicting labels the better. With no labels, or one class
only, the score is that class's share (0.5 with none). Ties in the sample's order go by doc_id. An empty table gives an
empty result. Further columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, whole

BLOCK, DICT_BYTES, LEVEL = 512, 32 << 10, 3
#: The labelled sample's bounds, a class and part.
SAMPLE, MAX_BYTES = 1_500, 4 << 20
RIDGE = 1e-2


@dataclass(frozen=True)
class Model:
    """Both dictionaries and the calibration: weights of (1, d, r, d², r²), standardised."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]


def _blocks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def train_dictionary(texts: list[str]) -> bytes:
    """A dictionary of the texts' common passages; the texts themselves where they are too few to train on."""
    blocks = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICT_BYTES:]


@lru_cache(maxsize=8)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if data is not None:
        data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def features(texts: list[str], good: bytes, bad: bytes) -> np.ndarray:
    """(d, r, d², r²) a text."""
    by_good, by_bad = _compressor(good).compress, _compressor(bad).compress
    rows = np.zeros((len(texts), 4))
    for i, text in enumerate(texts):
        if text:
            g = h = n = 0
            for block in _blocks(text):
                g += len(by_good(block))
                h += len(by_bad(block))
                n += len(block)
            d, r = (h - g) / (h + g), math.log(g / n + 0.01)
            rows[i] = d, r, d * d, r * r
    return rows


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's steps."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, a.T @ (y - p) - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w, centre, scale


def fit(sample: pd.DataFrame) -> Model | float:
    """From rows of (doc_id, text, quality, part): part 0 trains dictionaries, part 1 the calibration."""
    if not len(sample) or sample.quality.nunique() < 2:
        return float(sample.quality.mean()) if len(sample) else 0.5
    sample = sample.sort_values(["doc_id", "text"], kind="stable")
    learn, tune = sample[sample.part == 0], sample[sample.part == 1]
    if learn.quality.nunique() < 2 or tune.quality.nunique() < 2:  # too few rows to keep them apart
        learn = tune = sample
    good, bad = (train_dictionary(learn[learn.quality == q].text.tolist()) for q in (1, 0))
    w, centre, scale = calibrate(features(tune.text.tolist(), good, bad), tune.quality.to_numpy(float))
    return Model(good, bad, tuple(w), tuple(centre), tuple(scale))


def predict(texts: list[str], model: Model | float) -> np.ndarray:
    if not isinstance(model, Model):
        return np.full(len(texts), model)
    x = (features(texts, model.good, model.bad) - np.array(model.centre)) / np.array(model.scale)
    z = model.weights[0] + x @ np.array(model.weights[1:])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def labelled_sample(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """The bounded sample to fit on: of either class and part the SAMPLE rows with the smallest md5(doc_id)."""
    order = F.md5(F.col("doc_id").cast("string"))
    rows = labels.where("doc_id is not null and quality in (0, 1)").where(fold(F.col("doc_id")) != 1)
    rows = rows.groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("part", (fold(F.col("doc_id")) == 2).cast("int"))
    picked = None
    for quality in (0, 1):
        for part in (0, 1):
            some = rows.where((F.col("quality") == quality) & (F.col("part") == part)).orderBy(order).limit(SAMPLE)
            picked = some if picked is None else picked.unionByName(some)
    picked = F.broadcast(table(picked.coalesce(1), "labelled-ids"))  # 4 * SAMPLE rows at most
    texts = docs.select("doc_id", whole("text").alias("text")).join(picked, "doc_id")
    texts = texts.where(F.octet_length("text") <= MAX_BYTES).groupBy("doc_id", "quality", "part").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("quality", "part").orderBy(order, "doc_id"))
    return texts.withColumn("_bytes", so_far).where(F.col("_bytes") <= MAX_BYTES).drop("_bytes").toPandas()


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels)))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(predict(texts.fillna("").tolist(), model.value))

    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels)))

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(predict(texts.fillna("").tolist(), model.value) >= 0.5)

    return docs.where(good(F.col("text")))


"""The engine's tables, by explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

#: A file on disk; identity is its base name.
FILES = StructType([StructField("source", StringType()), StructField("path", StringType()), StructField("content", BinaryType())])
#: Text of one or more pages of a document, in order.
BLOCKS = StructType([StructField("source", StringType()), StructField("block_no", IntegerType()), StructField("pages", ArrayType(IntegerType())), StructField("text", StringType())])
#: A half-open interval of code points and the pages that it belongs to.
OFFSETS = ArrayType(StructType([StructField("s", IntegerType()), StructField("e", IntegerType()), StructField("pages", ArrayType(IntegerType()))]))
CHUNKS = StructType([StructField("source", StringType()), StructField("chunk_ix", IntegerType()), StructField("text", StringType()), StructField("page_list", ArrayType(IntegerType()))])
#: A stored chunk. `ord` makes the store's order explicit; `file_hash` is the per-chunk digest of older stores.
CORPUS = StructType(
    [
        StructField("id", StringType()), StructField("source", StringType()), StructField("ord", LongType()), StructField("text", StringType()),
        StructField("pages", StringType()), StructField("embedding", ArrayType(FloatType())), StructField("file_hash", StringType()),
    ]
)
#: A document's commit record.
MANIFEST = StructType([StructField("source", StringType()), StructField("digest", StringType()), StructField("n_chunks", LongType())])
#: A word of a passage, and how often it stands there; what the average length of passages is made of.
POSTINGS = StructType(
    [
        StructField("term", StringType()), StructField("id", StringType()), StructField("ord", LongType()), StructField("source", StringType()),
        StructField("dl", IntegerType()), StructField("tf", LongType()),
    ]
)
#: Of a word's postings in a range of a source's passages: how many, and the largest impact, at an average length.
IMPACTS = StructType(
    [
        StructField("term", StringType()), StructField("source", StringType()), StructField("block", LongType()), StructField("n", LongType()),
        StructField("impact", DoubleType()), StructField("at_avgdl", DoubleType()),
    ]
)
LENGTHS = StructType([StructField("source", StringType()), StructField("n", LongType()), StructField("total", LongType())])
GALLERY = StructType([StructField("source", StringType()), StructField("path", StringType()), StructField("caption", StringType()), StructField("file_hash", StringType()), StructField("embedding", ArrayType(FloatType()))])

#: Constants that define semantics.
PAGE_SEPARATOR = "\n\n"
CHUNK_SIZE, CHUNK_OVERLAP = 512, 50
RRF_K, RERANK_K = 60, 30
MIN_PAGE_CHARS, OCR_TRIGGER, FULL_OCR, LEGACY_RATIO = 100, 0.2, 0.8, 0.01
MAX_EVIDENCE_CHARS = 700
SCHEMA_VERSION = "1"

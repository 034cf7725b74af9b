"""Document fingerprints by consistent weighted sampling.

A text is a bag of lower-cased words, each weighing as often as it occurs. For each of SAMPLES samples and each word of weight w,
with r and c from Gamma(2, 1) and b from (0, 1), all fixed by the word's hash and the sample's number:

    t = floor(ln w / r + b),   ln a = ln c - r * (t - b) - r

and the word of the smallest a is the sample. Two texts draw the same (word, t) with the probability of their generalised
Jaccard similarity, sum of min(w) / sum of max(w). The smallest a names the sample, as words differ in r, c or b. A
fingerprint is 16 bits of each sample in hex; likeness is the share of equal ones.

One 64-bit hash of a word and a sample's number gives all five uniform numbers: the gamma variates are -ln(u * u').

A document's text and its edited text are sampled together. Most words are in both as often, and are drawn for once;
so are words that documents of a slice have in common.

All in DataFrame functions. A text is shuffled once, by the hash of its key; joins, word counts and minima reuse that partitioning. The
order of documents is a range sort of keys alone.

Nulls: a null text is empty; a text without words has one empty word. A null doc_id comes last. Rows with the same
doc_id and text are one document, reported as often as they occur; of the same doc_id and different texts the one with
the larger text hash is first. Empty tables give empty results. Further columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, whole

SAMPLES = 64
#: Samples that one aggregation takes; many more make its generated code too long to be compiled.
AT_ONCE = 32
GAMMA_BITS, SHIFT_BITS = 13, 12
#: Characters of text in a slice, a task's share, and its documents, about.
SLICE_CHARS, SLICE_ROWS = 8_000_000, 40_000


def _sample(term: Column, part: Column, k: int, log_weight: Column) -> Column:
    """ln a of a word, in sample k of a part."""
    bits = F.xxhash64(term, part, F.lit(k))

    def uniform(at: int, width: int) -> Column:
        return F.shiftrightunsigned(bits, at).bitwiseAND((1 << width) - 1) * F.lit(2.0**-width) + F.lit(2.0 ** -(width + 1))

    r = -F.ln(uniform(0, GAMMA_BITS) * uniform(GAMMA_BITS, GAMMA_BITS))
    c = -F.ln(uniform(2 * GAMMA_BITS, GAMMA_BITS) * uniform(3 * GAMMA_BITS, GAMMA_BITS))
    b = uniform(4 * GAMMA_BITS, SHIFT_BITS)
    return F.ln(c) - r * (F.floor(log_weight / r + b) - b + 1.0)


#: The words of both versions of a text, of the one only, of the other only.
FIRST, SECOND, BOTH = 1, 2, 3


def signatures(segments: DataFrame, key: str, slice_: str) -> DataFrame:
    """slice, key, first, second: fingerprints of two versions of a text, from rows of (slice, key, _in, text).

    The key is a number of the document in its slice. _in says which versions a segment belongs to; no word may run over a
    segment's end. Every document needs a segment, be it empty. Rows that are already dealt out by slice aren't shuffled
    again. Within a slice, documents with the same word as often share its samples: they are drawn once and handed to all
    of them. Slices are of bounded size.
    """
    words = segments.select(slice_, key, "_in", F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("_word"))
    terms = words.select(slice_, key, "_in", F.when(F.col("_word") != "", F.xxhash64("_word")).alias("_term"))
    weighed = terms.groupBy(slice_, key, "_term").agg(F.sum(F.col("_in").bitwiseAND(1)).alias("_n"), F.sum(F.shiftright("_in", 1)).alias("_m"))
    # owners of a sample: four times the document's number, and the versions that it is drawn for
    one = lambda which, n: F.struct((F.col(key) * 4 + which).cast("long").alias("owner"), F.col(n).alias("n"))
    drawn = (
        F.when(F.col("_n") == F.col("_m"), F.array(one(BOTH, "_n"))).when(F.col("_m") == 0, F.array(one(FIRST, "_n")))
        .when(F.col("_n") == 0, F.array(one(SECOND, "_m"))).otherwise(F.array(one(FIRST, "_n"), one(SECOND, "_m")))
    )
    weighed = weighed.select(slice_, "_term", F.explode(drawn).alias("_d")).select(slice_, "_term", "_d.owner", F.col("_d.n").alias("_w"))
    shared = weighed.groupBy(slice_, "_term", "_w").agg(F.collect_list("owner").alias("_owners"))
    # null for the blank word, which so has no sample; a column of its own, as samples within a condition would share none
    # of their subexpressions
    log_weight = F.when(F.col("_term").isNotNull(), F.ln(F.col("_w").cast("double")))
    parts = F.explode(F.array(*(F.lit(p) for p in range(SAMPLES // AT_ONCE))))
    shared = shared.select(slice_, "_term", "_owners", log_weight.alias("_log")).select("*", parts.alias("_part"))
    # a lambda keeps this projection out of whole-stage code, where its samples would make one method too long for the
    # JIT; on its own it is generated in methods of a fitting size
    part = F.transform(F.array("_part"), lambda p: p)[0]
    samples = [_sample(F.col("_term"), F.col("_part"), k, F.col("_log")).alias(f"_{k}") for k in range(AT_ONCE)]
    drawn = shared.select(slice_, part.alias("_part"), "_owners", *samples)
    names = [f"_{k}" for k in range(AT_ONCE)]
    owned = drawn.select(slice_, "_part", F.explode("_owners").alias("_owner"), *names)
    least = owned.groupBy(slice_, "_owner", "_part").agg(*(F.min(n).alias(n) for n in names))
    row = F.struct(F.col("_owner").bitwiseAND(3).cast("int").alias("in"), F.col("_part").alias("part"), F.array(*names).alias("a"))
    rows = least.select(slice_, F.shiftright("_owner", 2).alias(key), row.alias("_row"))
    found = rows.groupBy(slice_, key).agg(F.collect_list("_row").alias("_rows"))
    return found.select(slice_, key, _fingerprint(F.col("_rows"), FIRST).alias("first"), _fingerprint(F.col("_rows"), SECOND).alias("second"))


def _fingerprint(rows: Column, version: int) -> Column:
    """16 bits of each sample in hex, from the smallest ln a of a version's words."""
    empty, none = F.xxhash64(F.lit("")), F.array_repeat(F.lit(float("inf")), AT_ONCE)
    digits = lambda x: F.lpad(F.lower(F.hex(F.xxhash64(x).bitwiseAND(65535))), 4, "0")
    parts = []
    for part in range(SAMPLES // AT_ONCE):
        mine = F.filter(rows, lambda r: (r["part"] == part) & (r["in"].bitwiseAND(version) != 0) & r["a"][0].isNotNull())  # noqa: B023
        least = F.aggregate(mine, none, lambda acc, r: F.zip_with(acc, r["a"], lambda x, y: F.least(x, y)))
        blank = F.array(*(_sample(empty, F.lit(part), k, F.lit(0.0)) for k in range(AT_ONCE)))
        parts.append(F.transform(F.when(F.size(mine) > 0, least).otherwise(blank), digits))
    return F.array_join(F.concat(*parts), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints."""
    equal = [F.when(F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4), 1).otherwise(0) for k in range(SAMPLES)]
    total = equal[0]
    for e in equal[1:]:
        total = total + e
    return total / float(SAMPLES)


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """_td, _th: a document's key, never null: doc_id (0 for null), and a hash of the text and of whether doc_id is null."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_td"), F.xxhash64(whole("text"), F.col("doc_id").isNull()).alias("_th"), *more
    )


def chained(docs: DataFrame) -> DataFrame:
    """_td, _th, doc_id, n_chars, copies, next_td, next_th, prev_td, prev_th, prev_chars of every distinct document.

    Descending doc_id, in a ring. Keys are range-sorted and written; neighbours meet inside a range, and the ranges' ends
    (two rows a range) close the ring.
    """
    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.length(whole("text")).cast("long").alias("n_chars"))
    rows = rows.groupBy("_td", "_th", "doc_id").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_th").desc()]
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = table(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ring")
    me = F.struct("_td", "_th", "n_chars")
    inside = Window.partitionBy("_range").orderBy(*order)
    ranged = ranged.withColumn("_next", F.lead(me).over(inside)).withColumn("_prev", F.lag(me).over(inside))
    ends = ranged.where("_next is null or _prev is null").select(
        "_range", F.when(F.col("_prev").isNull(), me).alias("_first"), F.when(F.col("_next").isNull(), me).alias("_last")
    )
    ends = ends.groupBy("_range").agg(F.max("_first").alias("_first"), F.max("_last").alias("_last"))
    across = Window.partitionBy(F.lit(0)).orderBy("_range")
    every = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "_range", F.coalesce(F.lead("_first").over(across), F.first("_first").over(every)).alias("_after"),
        F.coalesce(F.lag("_last").over(across), F.last("_last").over(every)).alias("_before"),
    )
    joined = ranged.join(ends, "_range")
    next_, prev = F.coalesce("_next", "_after"), F.coalesce("_prev", "_before")
    return joined.select(
        "_td", "_th", "doc_id", "n_chars", "copies", next_["_td"].alias("next_td"), next_["_th"].alias("next_th"),
        prev["_td"].alias("prev_td"), prev["_th"].alias("prev_th"), prev["n_chars"].alias("prev_chars"),
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text's last third is replaced by the first as many characters of the next document, descending doc_id.
    """
    key = ["_td", "_th"]
    ring = table(chained(docs), "ring-links")
    n_chars, n_rows, copies = ring.agg(F.sum("n_chars"), F.count("*"), F.max("copies")).first()
    slices = max(1, math.ceil(max((n_chars or 0) / SLICE_CHARS, n_rows / SLICE_ROWS)))
    all_keys = ["_slice", *key]

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows in the slice of their key, a partition each: the joins and sums below need no further shuffle."""
        return rows.withColumn("_slice", F.pmod(F.xxhash64(*key), F.lit(slices)).cast("int")).repartitionById(slices, F.col("_slice"))

    texts = dealt(keyed(docs, whole("text").alias("text")))
    if (copies or 0) > 1:
        texts = texts.dropDuplicates(all_keys)
    third = lambda n: F.expr(f"{n} div 3").cast("int")
    numbered = F.row_number().over(Window.partitionBy("_slice").orderBy(*key)).cast("long").alias("_no")
    links = dealt(ring.select(*key, "n_chars", "prev_td", "prev_th", "prev_chars")).select("*", numbered)
    base = texts.join(links, all_keys)
    heads = base.select(F.col("prev_td").alias("_td"), F.col("prev_th").alias("_th"), F.left("text", third("prev_chars")).alias("_head"))
    kept = (F.col("n_chars") - third("n_chars")).cast("int")
    both = base.select(*all_keys, "_no", "text", "n_chars").join(dealt(heads), all_keys)
    both = both.select(*all_keys, "_no", "text", kept.alias("_kept"), F.concat(F.left("text", kept), F.col("_head")).alias("edited"))
    # up to the last white space before the cut both versions have the same words
    parts = both.withColumn("_same", F.length(F.regexp_extract(F.left("text", F.col("_kept")), r"(?s)^.*[\x20\x09-\x0D]", 0)))
    after = lambda text: F.expr(f"substring({text}, _same + 1)")
    segments = parts.select("_slice", "_no", F.posexplode(F.array(after("text"), after("edited"), F.expr("left(text, _same)"))).alias("_at", "text"))
    signed = signatures(segments.select("_slice", "_no", (F.col("_at") + 1).alias("_in"), "text"), "_no", "_slice")
    digests = both.select(*all_keys, "_no", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    found = signed.join(digests, ["_slice", "_no"]).withColumnsRenamed({"first": "fingerprint", "second": "edited_fingerprint"})
    found = table(found.drop("_slice", "_no"), "fingerprints")

    ring = ring.select(*key, "doc_id", "n_chars", "copies", "next_td", "next_th")
    nexts = found.select(F.col("_td").alias("next_td"), F.col("_th").alias("next_th"), F.col("fingerprint").alias("_next"))
    joined = found.join(ring, key).join(nexts, ["next_td", "next_th"])
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"),
    ).drop("_copy")

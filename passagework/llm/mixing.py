"""Mixing sources to target weights by weighted fair queueing.

A source's documents wait in a shuffled order (md5 of doc_id, a pass at a time) and are served in packets: a document
whole, or in packets of QUANTUM words and a rest where it is longer, as a fair queue does with long packets. A packet
that ends after c of its source's words has the virtual finish time c / target. All packets are range-sorted by it, over
the whole corpus, and the mix ends when the total budget is spent; at most the one packet at that end is split. A source
so gets its target to within some QUANTUM words.

The range sort: virtual time is cut into slices, about as many as a slice has packets. The slices' sums tell in which one
the budget ends; the slices before it are served, those after it aren't, and only that one need be sorted.

Targets: the budget is shared by weight; a source takes at most `max_repeats` times its words, the excess is shared
again by weight until none is above. That fixed point is min(max_repeats * size, level * weight) with one level.

Nulls: a null text has no words; a null source is a source of its own, the last. Documents without words take none.
Ties of md5 (repeated doc_ids) go by doc_id, size and row, ties of virtual finish by source and place. Empty tables give
empty results. Further columns pass through `mix`.
One row a source and one row a slice (not a document) go through a single window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, bit_filter, buckets_for, n_words, never_null, running_total, table, whole, whole_row, with_maybe

#: Words of the longest packet.
QUANTUM = 256


def source_targets(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """From rows of (source, size): source, source_no, source_size, weight, target, cut (the target in whole words)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    sizes = sizes.withColumn("source_no", F.row_number().over(listed) - 1)
    sizes = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int")))
    every = Window.partitionBy(F.lit(0))
    full = max_repeats * F.col("source_size")
    first = every.orderBy(full / F.col("weight"), "source_no")
    above = first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    below = first.rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(full).over(below), F.lit(0))
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    # The level if the sources before this one take their bound and no other does. The first that its source can take
    # is the true one, and the later ones are lower.
    levels = sizes.withColumn("_full", full).withColumn("_level", (budget - spent) / F.sum("weight").over(above))
    fits = F.col("_level") * F.col("weight") <= F.col("_full")
    levels = levels.withColumn("_chosen", F.max(F.when(fits, F.col("_level"))).over(every))
    bound = F.col("_full").cast("double")
    targets = levels.withColumn("target", F.when(F.col("_chosen").isNull(), bound).otherwise(F.least(bound, F.col("_chosen") * F.col("weight"))))
    return targets.select("source", "source_no", "source_size", "weight", "target", F.floor("target").cast("long").alias("cut"))


def schedule(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, first_start (its source's words before it in a
    pass), taken (words the mix takes, repeats counted), text_hash."""
    text_hash = F.xxhash64(whole("text"))
    rows = docs.select("doc_id", "source", n_words("text").alias("size"), text_hash.alias("text_hash"), F.monotonically_increasing_id().alias("row_id"))
    rows = table(rows, "mix-rows")
    targets = table(source_targets(rows, weights, share, max_repeats).coalesce(1), "mix-targets")
    budget = targets.agg(F.sum("cut")).first()[0] or 0

    n_rows = rows.count()
    digits = buckets_for(n_rows)
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    named = targets.withColumnRenamed("source", "_source")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, digits))
    order = [F.col("_digest"), F.col("doc_id"), F.col("size"), F.col("row_id")]
    rows = running_total(rows, ["source_no"], "_bucket", order, F.col("size"), "first_start").drop("_digest", "_bucket")
    rows = table(rows, "mix-queued")

    # a packet's first word in its document, before that its document's pass
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(QUANTUM)))
    packets = rows.where("size > 0").select("row_id", "size", "first_start", "source_size", "source_no", "target", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("_pass"))
    packets = packets.select("*", starts.alias("_at")).withColumn("_words", F.least(F.lit(QUANTUM), F.col("size") - F.col("_at")))
    start = F.col("first_start") + F.col("_pass") * F.col("source_size") + F.col("_at")
    packets = packets.select("row_id", "source_no", start.alias("_start"), "_words", F.try_divide(start + F.col("_words"), F.col("target")).alias("virtual_finish"))
    # the budget ends near virtual time 1; far beyond it nothing need be told apart
    slices = 16 ** buckets_for((rows.agg(F.sum("size")).first()[0] or 0) // QUANTUM + n_rows)
    packets = packets.withColumn("_slice", F.least(F.floor(F.col("virtual_finish") * slices), F.lit(4 * slices)))
    sums = packets.groupBy("_slice").agg(F.sum("_words").alias("_total"))
    sums = sums.select("_slice", "_total", (F.sum("_total").over(Window.partitionBy(F.lit(0)).orderBy("_slice")) - F.col("_total")).alias("_base"))
    last = sums.where(F.col("_base") < budget).agg(F.max(F.struct("_slice", "_base")).alias("_")).select("_.*").first()
    end, served = (-1, 0) if last[0] is None else last
    before = packets.where(F.col("_slice") < end).groupBy("row_id").agg(F.sum("_words").alias("taken"))
    order = [F.col("virtual_finish"), F.col("source_no"), F.col("_start"), F.col("row_id")]
    within = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    there = packets.where(F.col("_slice") == end).withColumn("_before", F.sum("_words").over(within) - F.col("_words"))
    there = there.select("row_id", F.greatest(F.lit(0), F.least(F.col("_words"), F.lit(budget - served) - F.col("_before"))).alias("taken"))
    taken = before.unionByName(there).groupBy("row_id").agg(F.sum("taken").alias("taken"))
    rows = rows.join(taken, "row_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return rows.select("doc_id", "source", "size", "source_size", "target", "first_start", "taken", "text_hash")


def mix_table(docs: DataFrame, weights: Sequence[float] = (3, 1, 2)) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return schedule(docs, weights).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """The mix as documents, whole ones only: each comes as often as its taken words fill it, rounded to the nearest
    (none, once, or up to max_repeats times). Rows of the same document share what their words were given, in the order
    of a hash of their other columns; rows that are equal in all columns are folded before they are shuffled.

    Which whole documents a source gives is a matter of one digest a pass, which the scan compares; only documents with that
    very digest, where the passes end, are joined with the plan."""
    key = ["_doc", "_source", "_size", "_hash"]
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    plan = schedule(docs, weights, share, max_repeats)
    plan = table(plan.select(never_null("doc_id").alias("_doc"), never_null("source").alias("_source"), F.col("size").alias("_size"), F.col("text_hash").alias("_hash"), "taken", "first_start", "source_size", digest.alias("_digest")), "mix-schedule")
    # a source's words are taken from the front of its queue, pass by pass: up to a digest whole documents, beyond it none
    served = plan.groupBy("_source").agg(F.sum("taken").alias("_served"))
    passes = [f"_end{p}" for p in range(max_repeats)]
    left = lambda p: (F.col("_size") > 0) & (F.col("first_start") + F.col("_size") > F.col("_served") - p * F.col("source_size"))
    ends = plan.join(served, "_source").groupBy("_source").agg(*(F.min(F.when(left(p), F.col("_digest"))).alias(name) for p, name in enumerate(passes)))
    ends = table(ends, "mix-ends")
    at_an_end = lambda row: sum((F.coalesce(row == F.col(e), F.lit(False)).cast("int") for e in passes), F.lit(0)) > 0
    every = docs.select(whole_row(docs), "text", never_null("doc_id").alias("_doc"), never_null("source").alias("_source"), digest.alias("_digest")).join(ends, "_source")
    whole_passes = sum(((F.col("_digest") < F.coalesce(F.col(e), F.lit("~"))).cast("long") for e in passes), F.lit(0).cast("long"))
    plain = every.where(~at_an_end(F.col("_digest")) & F.rlike(whole("text"), F.lit(WORD))).select("_row", whole_passes.alias("_n"))
    plan = plan.join(ends, "_source").where(at_an_end(F.col("_digest")))
    copies = F.when(F.col("_size") > 0, F.floor(F.col("taken") / F.col("_size") + 0.5)).otherwise(0)
    plan = table(plan.groupBy(*key).agg(F.sum(copies).cast("long").alias("_copies"), F.count("*").alias("_rows")), "mix-plan")
    rows = every.where(at_an_end(F.col("_digest"))).select("_row", "_doc", "_source", n_words("text").alias("_size"), F.xxhash64(whole("text")).alias("_hash"))
    again = bit_filter(plan.where("_rows > 1"), F.struct(*key))
    rows = with_maybe(rows, F.struct(*key), again)
    once = rows.where("not _maybe").join(plan, key).withColumn("_n", F.col("_copies"))
    alike = rows.where("_maybe").groupBy(*key, F.xxhash64("_row").alias("_alike")).agg(F.first("_row").alias("_row"), F.count("*").alias("_same"))
    upto = F.sum("_same").over(Window.partitionBy(*key).orderBy("_alike"))
    share_of = lambda n: F.floor(n * F.col("_copies") / F.col("_rows"))
    several = alike.withColumn("_upto", upto).join(plan, key).withColumn("_n", share_of(F.col("_upto")) - share_of(F.col("_upto") - F.col("_same")))
    given = plain.unionByName(once.select("_row", "_n")).unionByName(several.select("_row", "_n")).where("_n > 0")
    return given.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")

"""A Merkle manifest of a dataset, with a proof of inclusion for every row, by coordinate lookup.

A leaf is the SHA-256 of a row's encoded fields: null is `-`, a value its UTF-8 byte count, a colon and itself. Leaves of a
group (a tree) stand in the order of their ids; while a tree has several nodes, every FAN_OUT consecutive ones become the
SHA-256 of their digests' hex text. What remains is the tree's root; the trees' roots, in the groups' order, are the
leaves of one more tree, whose root is the manifest's.

Nodes have coordinates: tree, level, run (the number of a family of FAN_OUT siblings). A row's index says which runs its
proof needs: exploded to one coordinate a level, joined with the materialised node table, put in order, concatenated and
folded. Rows of the same run need the same coordinates above it, so a run asks for them once. Levels of at most
BROADCAST_RUNS runs are broadcast, because all rows ask for their few runs; of a level with more, no run is asked for by
more than one in BROADCAST_RUNS of the rows.

Leaves are numbered in ranges of (tree, id), so that no task holds a tree. Texts are read in one scan and never shuffled.

Nulls: a null group is a tree of its own, the first; null ids come first in a tree, and their rows aren't tampered with.
Ties and repeated rows: equal ids follow in the order of their leaves; equal leaves get one place each. An empty table
gives an empty result. Further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, table

FAN_OUT = 8
#: A level of so many runs at most (some 600 bytes each) is broadcast.
BROADCAST_RUNS = 4_096
#: No table has more levels: FAN_OUT ** 20 rows.
MOST_LEVELS = 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """The digest of a row's encoded fields."""

    def encoded(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return sha256(F.concat(*map(encoded, fields)))


def tree_key(group: Column) -> Column:
    """A group's name that is never null and sorts as groups do, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds pos (from 0 in the tree, by the given columns) and n (the tree's size) to rows with a column `tree`."""
    keys = ["tree", *order, "_salt"]
    salted = table(rows.withColumn("_salt", F.monotonically_increasing_id()), "unordered")  # repeated rows can part, too
    ranged = table(salted.repartitionByRange(*keys).withColumn("_bucket", F.spark_partition_id()), "ranges")
    drop(salted)
    tree = Window.partitionBy("tree")
    counts = ranged.groupBy("tree", "_bucket").agg(F.count("*").alias("_count"))
    base = counts.select("tree", "_bucket", (F.sum("_count").over(tree.orderBy("_bucket")) - F.col("_count")).alias("_base"), F.sum("_count").over(tree).alias("n"))
    within = F.row_number().over(Window.partitionBy("tree", "_bucket").orderBy(*keys[1:]))
    placed = table(ranged.join(base, ["tree", "_bucket"]).withColumn("pos", F.col("_base") + within - 1).drop("_bucket", "_base", "_salt"), "numbered")
    drop(ranged)
    return placed


def _upwards(index: str, levels: Column) -> Column:
    """The index of a node's ancestor so many levels above it."""
    return F.floor(F.col(index) / F.pow(F.lit(float(FAN_OUT)), levels)).cast("long")


@dataclass(frozen=True)
class Level:
    """The runs of one level: tree, run, n (the tree's nodes on this level), digests."""

    runs: DataFrame
    size: int


@dataclass(frozen=True)
class Forest:
    """The node table of all trees by level, and the trees' roots (tree, root)."""

    levels: list[Level]
    roots: DataFrame

    def lookups(self, asking: DataFrame, first: int) -> DataFrame:
        """The runs above nodes (tree, idx, depth) of level `first`: tree, idx, path (level, place, digests), upwards.

        `place` is where the node's own ancestor stands in the run. Nodes that are roots have no row."""
        level = F.explode(F.sequence(F.lit(first), F.col("depth") - 1)).alias("level")
        asked = asking.where(F.col("depth") > first).select("tree", "idx", level)
        up = F.col("level") - first
        asked = asked.select("tree", "idx", "level", _upwards("idx", up + 1).alias("run"), (_upwards("idx", up) % FAN_OUT).cast("int").alias("place"))
        found = []
        for few in (False, True):
            numbers = [i for i, x in enumerate(self.levels) if i >= first and (x.size <= BROADCAST_RUNS) == few]
            if numbers:
                runs = [self.levels[i].runs.select("tree", "run", "digests", F.lit(i).alias("level")) for i in numbers]
                nodes = runs[0]
                for more in runs[1:]:
                    nodes = nodes.unionByName(more)
                wanted = asked.where(F.col("level").isin(numbers))
                found.append(wanted.join(F.broadcast(nodes) if few else nodes, ["tree", "level", "run"]))
        if not found:
            return asked.select("tree", "idx", F.array().cast("array<struct<level:int,place:int,digests:array<string>>>").alias("path"))
        every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        return every.groupBy("tree", "idx").agg(F.array_sort(F.collect_list(F.struct("level", "place", "digests"))).alias("path"))


def depth_of(n: Column) -> Column:
    """How many levels of runs a tree of n leaves has."""
    return sum((n > FAN_OUT**k).cast("int") for k in range(MOST_LEVELS))


def forest(leaves: DataFrame) -> Forest:
    """From leaves (tree, pos, n, digest): every level's runs, materialised, and the roots."""
    nodes, levels, roots = leaves.select("tree", F.col("pos").alias("idx"), "n", "digest"), [], []
    while True:
        roots.append(nodes.where("n = 1").select("tree", F.col("digest").alias("root")))
        run = F.floor(F.col("idx") / FAN_OUT).alias("run")
        listed = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        grouped = nodes.where("n > 1").groupBy("tree", run, "n").agg(F.transform(listed, lambda x: x["digest"]).alias("digests"))
        runs = table(grouped, f"level{len(levels)}")
        size = runs.count()
        if not size:
            drop(runs)
            break
        levels.append(Level(runs, size))
        nodes = runs.select("tree", F.col("run").alias("idx"), F.ceil(F.col("n") / FAN_OUT).cast("long").alias("n"), sha256(F.array_join("digests", "")).alias("digest"))
    every = roots[0]
    for more in roots[1:]:
        every = every.unionByName(more)
    return Forest(levels, table(every, "roots"))


def _others(step: Column) -> Column:
    """The digests of a run but a node's own, joined."""
    return F.array_join(F.filter(step["digests"], lambda _, i: i != step["place"]), "")


def _with_own(step: Column, own: Column) -> Column:
    """The parent's digest, if a run's node at `place` had this digest."""
    return sha256(F.array_join(F.transform(step["digests"], lambda d, i: F.when(i == step["place"], own).otherwise(d)), ""))


def fold(digest: Column, path: Column) -> Column:
    """The root that a digest gives with a path (place, digests)."""
    return F.aggregate(path, digest, lambda own, step: _with_own(step, own))


#: A step of a proof: the level, the node's place in its run, and the digests of the whole run.
STEPS = "array<struct<level:int,place:int,digests:array<string>>>"


def proofs(leaves: DataFrame) -> DataFrame:
    """From leaves (tree, pos, n, digest, further columns): all of them with subroot, root and path, the proof of
    inclusion from the leaf up to the root."""
    trees = forest(leaves)
    tops = numbered(trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("root").alias("digest")), ["group"])
    top = forest(tops)
    over = top.lookups(tops.select("tree", F.col("pos").alias("idx"), depth_of(F.col("n")).alias("depth")), 0)
    known = tops.join(over.select("tree", F.col("idx").alias("pos"), F.col("path").alias("_over")), ["tree", "pos"], "left").join(F.broadcast(top.roots), "tree")
    known = table(known.select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "root", F.coalesce("_over", F.array().cast(STEPS)).alias("_over")), "trees")
    if not trees.levels:
        return leaves.join(known, "tree").withColumnRenamed("_over", "path")
    runs = trees.levels[0].runs
    above = trees.lookups(runs.select("tree", F.col("run").alias("idx"), depth_of(F.col("n")).alias("depth")), 1)
    runs = runs.select("tree", "run", "digests").join(above.select("tree", F.col("idx").alias("run"), F.col("path").alias("_above")), ["tree", "run"], "left")
    own = F.struct(F.lit(0).alias("level"), (F.col("pos") % FAN_OUT).cast("int").alias("place"), "digests")
    none = F.array().cast(STEPS)
    path = F.concat(F.when(F.col("digests").isNull(), none).otherwise(F.array(own).cast(STEPS)), F.coalesce("_above", none), "_over")
    asked = leaves.withColumn("run", F.floor(F.col("pos") / FAN_OUT))
    return asked.join(runs, ["tree", "run"], "left").join(known, "tree").withColumn("path", path).drop("run", "digests", "_above", "_over")


def proof_digest(path: Column) -> Column:
    """The digest of a proof: its siblings, left to right, from the leaf's level to the root."""
    return sha256(F.array_join(F.transform(path, _others), ""))


def leaves_of(docs: DataFrame, now: Sequence[Column] | None = None, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group: str = "lang") -> DataFrame:
    """tree, id, pos, n, digest of every row, and `now`, the digest of the fields as `now` has them (null: as they were)."""
    then = leaf_digest([F.col(f) for f in fields])
    rows = docs.select(tree_key(F.col(group)).alias("tree"), F.col(id_col).alias("id"), then.alias("digest"), (leaf_digest(now) if now else F.lit(None).cast("string")).alias("now"))
    return numbered(rows, ["id", "digest"])


def tampered_proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row's proof, checked against the row as it
    is after tampering. Of every third id, by its checksum, the text's A-Z are lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.when(hit & F.rlike("text", F.lit("[A-Z]")), lowered).otherwise(F.col("text"))
    found = proofs(leaves_of(docs, [F.col(f) if f != "text" else text for f in FIELDS]))
    folded = found.withColumn("folded_root", fold(F.coalesce("now", "digest"), F.col("path")))
    return folded.select(
        F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )

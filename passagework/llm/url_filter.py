"""URL filters: rules first, then a path-template tree by host.

Rules: one fits its host and all subdomains where the path starts with the rule's; the longest wins.

Templates, all in SQL functions, over distinct URLs (host and path), so that repeated rows change nothing:
- Generalise. Segments that vary by their form (numbers, long hex, dates, tokens with digits) become `*` and keep a file
  extension. Then level by level, to the end of the longest path, a node with WIDE children or more that each stand for
  fewer than RARE URLs on average has the children that stand for fewer become `*` too.
- Merge. At every node of the tree, the labelled branches whose share of good labels lies within Z standard errors of all
  of them are statistically similar and are merged: they pool their labels. Others stand alone.
- Reject. Purities are smoothed from the root to the leaf. A node's estimate is (the sum of its labelled branches' shares
  + ALPHA * its parent's estimate) / (labelled branches + ALPHA), the host's parent being PRIOR; a branch is one
  observation however many URLs it has, as labels below one branch hang together. A template's purity is (good + ALPHA *
  estimate) / (labelled + ALPHA) of its merged branch, or the estimate alone where that has no label. Below REJECT its
  URLs are blocked.

Labelled URLs are given as a column; without one the URLs that a rule decides are the labels (allow is good, block bad).

Nulls: a null URL, or one without "://", has an empty host and path and no rule. Repeated rows are judged each, and alike.
A URL labelled both ways counts once for either. Ties don't arise: nothing depends on an order. Empty tables give empty
results. Further columns aren't read. A host may hold a third of all rows: its URLs are spread by path when they are made
distinct and summed by shape before they are shuffled by host, and the join back by (host, shape) is split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: (verdict, host, path) of the production rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A node is wide with this many children or more, each of fewer than RARE URLs on average; those of fewer go.
WIDE, RARE = 24, 3.0
ALPHA, PRIOR, REJECT, Z = 4.0, 0.9, 0.5, 1.96

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments that vary by form, and an extension that stays.
VARIABLE = r"^(?:[0-9]+|[0-9a-fA-F]{8,}|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|(?=[^.]*[0-9])[\w~%-]{6,})(\.[A-Za-z]{1,5})?$"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shape_of(path: Column) -> Column:
    """A path's segments, with those that vary by form as wildcards."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), lambda s: F.regexp_replace(s, VARIABLE, r"*$1"))


def _level(shapes: DataFrame, at: int) -> DataFrame:
    """Turns the rare children of wide nodes at a level into wildcards."""
    node = F.xxhash64(F.slice("template", 1, at))
    rows = shapes.withColumn("_node", node).withColumn("_child", F.try_element_at("template", F.lit(at + 1)))
    children = rows.where("_child is not null").groupBy("host", "_node", "_child").agg(F.sum("n").alias("_seen"))
    literal = F.when(~F.col("_child").startswith("*"), F.col("_seen"))
    nodes = children.groupBy("host", "_node").agg(F.count(literal).alias("_children"), F.sum(literal).alias("_all"))
    wide = nodes.where((F.col("_children") >= WIDE) & (F.col("_all") < RARE * F.col("_children"))).select("host", "_node")
    gone = children.where((F.col("_seen") < RARE) & ~F.col("_child").startswith("*")).join(wide, ["host", "_node"], "left_semi")
    gone = gone.select("host", "_node", "_child", F.lit(True).alias("_gone"))
    general = F.transform("template", lambda s, i: F.when(i == at, F.regexp_replace(s, r"^.*?(\.[A-Za-z]{1,5})?$", r"*$1")).otherwise(s))
    joined = rows.join(gone, ["host", "_node", "_child"], "left")
    return joined.withColumn("template", F.when(F.col("_gone"), general).otherwise(F.col("template"))).select(*shapes.columns)


def templates(shapes: DataFrame) -> DataFrame:
    """Adds the template to distinct shapes (host, shape, n)."""
    # only where a host has many literal segments at a level can one of its nodes be wide there
    segments = shapes.select("host", F.posexplode("shape").alias("_at", "_segment")).where(~F.col("_segment").startswith("*"))
    levels = segments.groupBy("host", "_at").agg(F.countDistinct("_segment").alias("_n")).where(F.col("_n") >= WIDE).select("_at").distinct()
    shapes = shapes.withColumn("template", F.col("shape"))
    for (at,) in sorted(levels.collect()):
        shapes = table(_level(shapes, at), "templates")
    return shapes


def _nodes(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of templates (id, host, template, good, labelled): the nodes of their chains but the leaves, and the leaves; both id,
    host, good, labelled, parent, node, and _at, the node's depth.

    A node is known by its prefix: the exclusive or of the hashes of its segments with their places, running along the
    exploded template, so that a path of any length costs a row a segment. The host's node is 0."""
    rows = trees.select("id", "host", "good", "labelled", (F.size("template") - 1).alias("_last"), F.posexplode("template").alias("_at", "_segment"))
    along = Window.partitionBy("id").orderBy("_at")
    node = F.bit_xor(F.xxhash64("_at", "_segment")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = rows.withColumn("node", node).withColumn("parent", F.coalesce(F.lag("node").over(along), F.lit(0).cast("long")))
    steps = table(steps.select("id", "host", "good", "labelled", "parent", "node", (F.col("_at") + 1).alias("_at"), "_last"), "chains")
    leaves = steps.where("_at = _last + 1").select("id", "host", "good", "labelled", F.col("node").alias("parent"), F.xxhash64("node", F.lit("leaf")).alias("node"), (F.col("_at") + 1).alias("_at"))
    return steps.drop("_last"), leaves


def purities(shapes: DataFrame) -> DataFrame:
    """From (host, shape, n, good, labelled), n the URLs of a shape: host, shape, template, purity."""
    shapes = table(templates(shapes), "templates")
    by = shapes.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    by = table(by.withColumn("id", F.monotonically_increasing_id()), "tree")
    inside, leaves = _nodes(by)
    steps = inside.unionByName(leaves)
    branches = steps.where("labelled > 0").groupBy("host", "parent", "node").agg(F.sum("good").alias("_g"), F.sum("labelled").alias("_l"))
    share = F.col("_g") / F.col("_l")
    nodes = branches.groupBy("host", "parent").agg(F.sum("_g").alias("_pg"), F.sum("_l").alias("_pl"), F.sum(share).alias("_shares"), F.count("*").alias("_branches"))
    branches = branches.join(nodes, ["host", "parent"])
    pooled = (F.col("_pg") + ALPHA * PRIOR) / (F.col("_pl") + ALPHA)
    branches = branches.withColumn("_alike", F.abs(share - pooled) <= Z * F.sqrt(pooled * (1 - pooled) / F.col("_l")))
    kin = branches.where("_alike").groupBy("host", "parent").agg(F.sum("_g").alias("_kg"), F.sum("_l").alias("_kl"))
    merged = branches.where("_alike").join(kin, ["host", "parent"]).select("host", "parent", "node", F.col("_kg").alias("_g"), F.col("_kl").alias("_l"))
    merged = merged.unionByName(branches.where("not _alike").select("host", "parent", "node", "_g", "_l"))
    # the nodes of a template's chain, with what their branches say; then the fold from the host's to the last
    root = by.select("id", "host", F.lit(0).alias("_at"), F.lit(0).cast("long").alias("node"))
    walk = root.unionByName(inside.select("id", "host", "_at", "node"))
    walk = walk.join(nodes.select("host", F.col("parent").alias("node"), "_shares", "_branches"), ["host", "node"], "left")
    inner = walk.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_at", F.coalesce("_shares", F.lit(0.0)).alias("s"), F.coalesce("_branches", F.lit(0)).alias("k")))).alias("_path"))
    estimate = F.aggregate("_path", F.lit(PRIOR), lambda e, x: (x["s"] + ALPHA * e) / (x["k"] + ALPHA))
    found = inner.select("id", estimate.alias("_estimate")).join(leaves.select("id", "host", "parent", "node").join(merged, ["host", "parent", "node"], "left"), "id")
    good, labelled = F.coalesce("_g", F.lit(0)), F.coalesce("_l", F.lit(0))
    found = found.select("id", ((good + ALPHA * F.col("_estimate")) / (labelled + ALPHA)).alias("purity"))
    found = by.select("id", "host", "template").join(found, "id").drop("id")
    return shapes.select("host", "shape", "template").join(found, ["host", "template"])


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, label: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page. `label`: a column, 1 good, 0 bad, else null."""
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), *([F.col(label).cast("long").alias("_label")] if label else []))
    rows = rows.withColumn("_found", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path")))
    given = F.col("_label") if label else F.when(F.col("_found.verdict") == "allow", 1).when(F.col("_found.verdict") == "block", 0)
    # a URL that is labelled both ways counts once for either
    urls = rows.withColumn("_given", given).groupBy("host", "path").agg(
        F.max(F.when(F.col("_given") == 1, 1).otherwise(0)).alias("_good"), F.max(F.when(F.col("_given") == 0, 1).otherwise(0)).alias("_bad")
    )
    urls = urls.select("host", shape_of(F.col("path")).alias("shape"), "_good", "_bad")
    shapes = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.sum("_good").alias("good"), F.sum(F.col("_good") + F.col("_bad")).alias("labelled"))
    found = table(purities(table(shapes, "shapes")), "purities")
    verdict = F.coalesce(F.col("_found.verdict"), F.when(F.col("purity") < REJECT, "block").otherwise("allow"))
    joined = rows.join(found, ["host", "shape"])
    return joined.select("page_id", "host", "path", F.col("_found.rule").alias("rule"), verdict.alias("verdict"), F.concat_ws("/", F.array(F.lit("")), "template").alias("template"), "purity")

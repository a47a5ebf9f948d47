"""Merkle manifest of a dataset with nested-interval labels.

Every row is a leaf; the leaves of a source stand in the order of doc_id and
every run of ``FAN`` nodes becomes a node, level by level, until one is left,
the source's subroot; the subroots, ordered by source, give the root alike. A
node is labelled with the interval ``[lo, hi)`` of leaf ranks it covers, and
carries the intervals and digests of its children.

Ancestors are attached from the root down by one containment join a level:
nodes meet on the bucket ``lo div FAN ** level`` of their tree, the parent's
interval holds the child's, and the difference of the two intervals, left and
right of the child, names its siblings. A row's path is the list of
(digests to the left, digests to the right), one entry a level.

Levels are written tables, each a ``FAN``-th of the one below; a run is at
most ``FAN`` rows, so a source that holds most rows is many keys. The driver
learns the largest number of leaves of a tree, nothing else.

Defined cases: a null doc_id comes first and is not tampered with; rows that
share a doc_id are ordered by their digest, repeated rows are leaves of their
own; a null source is a tree of its own, ahead of the empty one; nulls in any
column are told from empty texts; a lone leaf is the subroot, a lone subroot
the root; an empty table gives no rows; columns beside the five are no part
of a leaf and are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import laid_out
from .text import written

FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values, concatenated."""
    return F.sha2(F.concat(*values), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: dict[str, Column]) -> Column:
    return digest(*(encoded(c) for c in columns.values()))


def leaves_of(docs: DataFrame) -> DataFrame:
    """doc_id, tree (the source), leaf and tampered: the leaf after tampering, null where nothing is done."""
    own = {c: F.col(c) for c in COLUMNS}
    touched = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    changed = own | {"text": F.translate("text", UPPER, LOWER)}
    return docs.select("doc_id", F.col("source").alias("tree"), leaf_digest(own).alias("leaf"),
                       F.when(touched, leaf_digest(changed)).alias("tampered"))


def _is_root(level: int) -> Column:
    """The tree ends at this level: one node covers all its ``n`` leaves, and none below did."""
    top = F.col("n") <= FAN ** level
    return top & (F.col("n") > FAN ** (level - 1)) if level else top


def levels_of(leaves: DataFrame) -> list[DataFrame]:
    """Nodes (tree, n, lo, hi, digest, kids) of every level; ``leaves`` has tree, n, lo, hi, digest and is level 0."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = [leaves]
    while most > FAN ** (len(levels) - 1):
        below, width = levels[-1].where(F.col("n") > FAN ** (len(levels) - 1)), FAN ** len(levels)
        nodes = (below.groupBy("tree", "n", F.expr(f"lo div {width}L").alias("run"))
                 .agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids"))
                 .select("tree", "n", F.element_at("kids", 1)["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"),
                         F.sha2(F.array_join("kids.digest", ""), 256).alias("digest"), "kids"))
        levels.append(written(nodes, f"merkle-level-{len(levels)}"))
    return levels


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """tree, digest of every tree's root."""
    return reduce(DataFrame.unionAll, (nodes.where(_is_root(i)).select("tree", "digest") for i, nodes in enumerate(levels)))


def paths(levels: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """Level 0 with subroot, root and path: per level the digests left and right of the row's ancestor.

    ``above`` (tree, up, top) continues the path of each tree's root.
    """
    path = "array<struct<left:string,right:string>>"
    parents = None
    for level in reversed(range(len(levels))):
        nodes = levels[level].drop("run")
        ends = nodes.where(_is_root(level)).withColumn("subroot", F.col("digest"))
        if above is None:
            ends = ends.withColumn("root", F.col("digest")).withColumn("path", F.array().cast(path))
        else:
            ends = (ends.join(above.withColumnRenamed("tree", "of"), F.col("tree").eqNullSafe(F.col("of")))
                    .withColumn("root", F.col("top")).withColumn("path", F.col("up").cast(path)).drop("of", "top", "up"))
        if parents is not None:
            width = FAN ** (level + 1)
            over = parents.select(F.col("tree").alias("p_tree"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"),
                                  F.col("kids").alias("p_kids"), F.col("path").alias("p_path"), "subroot", "root")
            inside = (F.col("tree").eqNullSafe(F.col("p_tree")) & (F.expr(f"lo div {width}L") == F.expr(f"p_lo div {width}L"))
                      & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi")))
            # the parent's interval less the node's own: [p_lo, lo) and [hi, p_hi)
            left = F.array_join(F.transform(F.filter("p_kids", lambda k: k["hi"] <= F.col("lo")), lambda k: k["digest"]), "")
            right = F.array_join(F.transform(F.filter("p_kids", lambda k: k["lo"] >= F.col("hi")), lambda k: k["digest"]), "")
            under = (nodes.where(F.col("n") > FAN ** level).join(over, inside)
                     .withColumn("path", F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("p_path")).cast(path))
                     .drop("p_tree", "p_lo", "p_hi", "p_kids", "p_path"))
            ends = under.unionByName(ends)
        parents = ends
    return parents


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda acc, x: digest(x["left"], acc, x["right"]))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, tampered, subroot, root and path of every row."""
    # written first: the ranges are found by a pass of their own, which must not hash the texts again
    leaves = laid_out(written(leaves_of(docs), "merkle-digests"), "tree", ["doc_id", "leaf"])
    leaves = written(leaves.select("tree", "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"),
                                   F.col("leaf").alias("digest"), "doc_id", "tampered"), "merkle-leaves")
    levels = levels_of(leaves)
    subroots = laid_out(roots_of(levels).select(F.lit(0).alias("all"), F.col("tree").alias("source"), "digest"), "all", ["source"])
    subroots = written(subroots.select(F.col("all").alias("tree"), "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"),
                                       "digest", "source"), "merkle-subroots")
    above = paths(levels_of(subroots)).select(F.col("source").alias("tree"), F.col("path").alias("up"), F.col("root").alias("top"))
    return paths(levels, above).select("doc_id", F.col("tree").alias("source"), F.col("digest").alias("leaf"), "tampered",
                                       "subroot", "root", "path")


def verify(manifest: DataFrame) -> DataFrame:
    """The manifest with proof_sha256, folded_root (from the tampered leaf where there is one) and verified."""
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    return (manifest.withColumn("proof_sha256", F.sha2(siblings, 256))
            .withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
            .withColumn("verified", F.col("folded_root") == F.col("root")))

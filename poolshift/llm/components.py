"""Connected components of a table of links, by star contraction.

Links are first contracted inside each partition by union-find (a partition
of links at a time, no group is ever gathered). Then in every round each node
finds its smallest neighbour by an aggregation with map-side minima, a join
links all its neighbours to that one, and links are dealt by their first node
and contracted again, so that a node's links to several hubs become one.
Rounds end when all links point from a node to the smallest of its
component; their number grows with the logarithm of the longest chain. Each
round is written to the shared folder, so lost executors cost one round.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import written

EDGE = "u long, v long, changed boolean"


def _find(parent: dict, x: int) -> int:
    root = x
    while (up := parent.get(root, root)) != root:
        root = up
    while (up := parent.get(x, x)) != root:
        parent[x], x = root, up
    return root


def _contract(batches):
    """Stars of a partition's links (u, v, changed): every node with its smallest reachable one."""
    parent: dict[int, int] = {}
    changed = False
    for batch in batches:
        changed = changed or bool(batch.column(2).true_count)
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = _find(parent, u), _find(parent, v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if _find(parent, x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([_find(parent, x) for x in nodes], pa.int64()),
                                      pa.array([changed] * len(nodes), pa.bool_())], ["u", "v", "changed"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v longs) that reaches a smaller node.

    ``component`` is the smallest node reachable (it has no row of its own).
    Links may repeat, point either way or to their own node.
    """
    u, v = F.col("u").cast("long"), F.col("v").cast("long")
    edges = links.select(u.alias("u"), v.alias("v"), F.lit(True).alias("changed")).where("u <> v")
    edges = written(edges.repartition("u").mapInArrow(_contract, EDGE), "links")
    while not edges.where("changed").isEmpty():
        both = (edges.select(F.col("u").alias("k"), F.col("v").alias("o"))
                .unionByName(edges.select(F.col("v").alias("k"), F.col("u").alias("o"))))
        least = both.groupBy("k").agg(F.min("o").alias("m")).select("k", F.least("k", "m").alias("m"))
        moved = both.join(least, "k").select(
            F.when(F.col("o") == F.col("m"), F.col("k")).otherwise(F.col("o")).alias("u"), F.col("m").alias("v"),
            # in finished stars the smallest neighbour of either end is the smaller end
            (F.col("m") != F.least("k", "o")).alias("changed")).where("u <> v")
        edges = written(moved.repartition("u").mapInArrow(_contract, EDGE), "links")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts``, a result of ``components``, after further ``links`` (u, v): only links between components are contracted."""
    for end in ("u", "v"):
        links = links.join(parts.select(F.col("node").alias(end), "component"), end, "left").select(
            *[F.coalesce("component", end).alias(end) if c == end else c for c in ("u", "v")])
    top = components(links)
    to = top.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return parts.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")).unionByName(top)

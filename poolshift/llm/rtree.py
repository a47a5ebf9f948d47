"""Hard-negative mining with STR-packed R-trees.

Vectors become integers, ``floor(scale * x)``. They are dealt by ranges of
(label, then the coordinates of largest variance), and each run of ``TILE``
rows in that order is packed into one tree by sort-tile-recursive: slabs by
the coordinate that varies most in the tile, tiles by the next, ``LEAF``
vectors a leaf box, ``FAN`` leaves a node. A box holds the least and largest
value of every coordinate and of the label.

For an anchor, a box gives an interval of inner products: coordinate j
contributes between ``min(q_j lo_j, q_j hi_j)`` and the larger of the two.
A queue takes boxes best first, by the upper end held to the window; boxes
with an interval outside the score window, with no label wanted, or strictly
below the k-th score found so far are pruned (a box level with the k-th may
hold a tie with a smaller vec_id). A shard is a small forest, about
``TREES`` trees; anchors are packed in blocks that meet every shard, in two searches: the ``positives`` first, then for
each anchor and positive the window its score defines. Lists are merged as a
tree and hold at most ``topk.FAN * k`` entries.

Bounds and scores are exact while sums stay below 2**53; beyond that, boxes
are not pruned and scores are Python integers, held to 64 bits.

Defined cases: rows with a null vec_id, a null label, a null vector or a null
or non-finite component take no part; components missing against a longer
vector count as 0; rows of an anchor's vec_id are no partners of it; of
several anchor rows under one vec_id the one with the least (label, vector)
counts; repeated rows (same vec_id and score) count once; ties go to the
smaller vec_id; an anchor without other rows of its label, and a positive
without rows in its window, give no rows; extra columns do not matter.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import topk
from .text import written

SCALE = 256
TILE = 4096
BLOCK = 256
LEAF = 64
FAN = 8
TREES = 8
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: One row: a tree (kind 0) or a block of anchors (kind 1; ``asks``: the scores that define each anchor's windows).
PACKED = ("kind int, width int, ids array<long>, labels array<long>, matrix binary, leaves array<int>, boxes binary, "
          "spans array<long>, asks array<array<long>>")
LISTS = "query_id long, ask int, part int, best array<struct<score:long,vec_id:long>>"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: F.abs(x) < float("inf"))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")))


def widest_coordinates(rows: DataFrame, most: int = 2) -> list[int]:
    """The coordinates of largest variance, from sums a batch; one row for a coordinate reaches the driver at most."""
    def sums(batches):
        for batch in batches:
            _, vectors = topk._vectors(batch.column(0))
            width = max(map(len, vectors), default=0)
            m = _padded(vectors, width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(m.sum(0), pa.float64()),
                                              pa.array((m * m).sum(0), pa.float64())], ["at", "one", "two"])

    n = rows.count()
    found = rows.select("v").mapInArrow(sums, "at int, one double, two double").groupBy("at").agg(F.sum("one").alias("one"), F.sum("two").alias("two"))
    spread = F.col("two") / max(n, 1) - F.pow(F.col("one") / max(n, 1), F.lit(2.0))
    return [r[0] for r in found.orderBy(spread.desc(), "at").limit(most).collect()]


def _padded(vectors: list[np.ndarray], width: int) -> np.ndarray:
    m = np.zeros((len(vectors), width))
    for row, v in zip(m, vectors, strict=True):
        row[:len(v)] = v
    return m


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


def sort_tile(m: np.ndarray, labels: np.ndarray, leaf: int) -> tuple[np.ndarray, list[int]]:
    """Order of the rows and the sizes of the leaves: slabs by (label, widest coordinate), in each tiles by (label, next coordinate)."""
    n = len(m)
    by = np.argsort(-m.var(axis=0), kind="stable")[:2] if m.shape[1] else []
    first = m[:, by[0]] if len(by) else np.zeros(n)
    second = m[:, by[1]] if len(by) > 1 else first
    order = np.lexsort((first, labels))
    slab = leaf * int(np.ceil(np.sqrt(-(-n // leaf))))
    runs = [order[i:i + slab] for i in range(0, n, slab)]
    runs = [run[np.lexsort((second[run], labels[run]))] for run in runs]
    sizes = [len(run[i:i + leaf]) for run in runs for i in range(0, len(run), leaf)]
    return np.concatenate(runs), sizes


def _packed(kind, ids, labels, m, leaves=(), boxes=b"", spans=(), asks=()):
    kinds = dict(kind=pa.int32(), width=pa.int32(), ids=pa.list_(pa.int64()), labels=pa.list_(pa.int64()), matrix=pa.binary(),
                 leaves=pa.list_(pa.int32()), boxes=pa.binary(), spans=pa.list_(pa.int64()), asks=pa.list_(pa.list_(pa.int64())))
    values = [kind, m.shape[1], ids, labels, m.tobytes(), leaves, boxes, spans, asks]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds.values(), strict=True)], list(kinds))


def _rows(batches):
    for batch in batches:
        at, vectors = topk._vectors(batch.column("v"))
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != "v"}
        for i, v in zip(at.tolist(), vectors, strict=True):
            yield v, {n: c[i] for n, c in columns.items()}


def _taken(batches, most):
    held = []
    for row in _rows(batches):
        held.append(row)
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held


def _matrix(held, scale):
    return np.floor(_padded([v for v, _ in held], max(len(v) for v, _ in held)) * float(scale))


def pack_trees(scale: int = SCALE, tile: int = TILE, leaf: int = LEAF):
    """A task that packs sorted rows (vec_id, label, v) into trees."""
    def run(batches):
        for held in _taken(batches, tile):
            m, labels = _matrix(held, scale), np.array([r["label"] for _, r in held], np.int64)
            ids = np.array([r["vec_id"] for _, r in held], np.int64)
            order, sizes = sort_tile(m, labels, leaf)
            m, labels, ids = m[order], labels[order], ids[order]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
            least, most = (f.reduceat(m, starts, axis=0) if m.shape[1] else np.zeros((len(sizes), 0)) for f in (np.minimum, np.maximum))
            spans = np.concatenate([np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)])
            yield _packed(0, ids, labels, m, sizes, least.tobytes() + most.tobytes(), spans)

    return run


def pack_anchors(scale: int = SCALE, block: int = BLOCK):
    """A task that packs anchors (vec_id, label, v, asks) into blocks."""
    def run(batches):
        for held in _taken(batches, block):
            rows = [r for _, r in held]
            yield _packed(1, [r["vec_id"] for r in rows], [r["label"] for r in rows], _matrix(held, scale), asks=[r["asks"] for r in rows])

    return run


class Forest:
    """The trees of a shard, their boxes side by side: leaves, and nodes of ``FAN`` leaves."""

    def __init__(self, trees: list[dict]):
        width = max(t["width"] for t in trees)
        self.ids = np.concatenate([np.array(t["ids"], np.int64) for t in trees])
        self.labels = np.concatenate([np.array(t["labels"], np.int64) for t in trees])
        self.m = np.concatenate([_widened(_floats(t["matrix"], len(t["ids"]), t["width"]), width) for t in trees])
        sizes = [len(t["leaves"]) for t in trees]
        ends = np.cumsum(np.concatenate([t["leaves"] for t in trees]).astype(int))
        self.ends, self.starts = ends, np.concatenate([[0], ends[:-1]])
        boxes = [_floats(t["boxes"], 2 * n, t["width"]) for t, n in zip(trees, sizes, strict=True)]
        self.least = np.concatenate([_widened(b[:n], width) for b, n in zip(boxes, sizes, strict=True)])
        self.most = np.concatenate([_widened(b[n:], width) for b, n in zip(boxes, sizes, strict=True)])
        spans = [np.array(t["spans"], np.int64) for t in trees]
        self.low_label = np.concatenate([s[:n] for s, n in zip(spans, sizes, strict=True)])
        self.high_label = np.concatenate([s[n:] for s, n in zip(spans, sizes, strict=True)])
        first = np.concatenate([np.arange(0, n, FAN) + at for n, at in zip(sizes, np.cumsum([0, *sizes[:-1]]), strict=True)]).astype(int)
        self.first, self.last = first, np.concatenate([first[1:], [len(ends)]])
        self.node_least = np.minimum.reduceat(self.least, first, axis=0) if width else self.least[first]
        self.node_most = np.maximum.reduceat(self.most, first, axis=0) if width else self.most[first]
        self.node_low_label = np.minimum.reduceat(self.low_label, first)
        self.node_high_label = np.maximum.reduceat(self.high_label, first)


def _floats(raw: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, float).reshape(rows, width) if width else np.zeros((rows, 0))


def intervals(q: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product that each row of ``q`` can have with a vector of each box."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ least.T + down @ most.T, up @ most.T + down @ least.T


def search(k: int, same: bool, window=None):
    """A task over rows of :data:`PACKED` by shard, trees first: per anchor and ask the k best of the shard.

    ``same``: partners have the anchor's label, or any other. ``window(ask)``
    gives the least and largest score of an ask; None: one ask, all scores.
    """
    def of_block(block: dict, forest: Forest, shard: int):
        width = max(block["width"], forest.m.shape[1])
        q = _widened(_floats(block["matrix"], len(block["ids"]), block["width"]), width)
        for name in ("m", "least", "most", "node_least", "node_most"):
            setattr(forest, name, _widened(getattr(forest, name), width))
        exact = np.abs(q).sum(axis=1).max(initial=0) * np.abs(forest.m).max(initial=0) < topk.EXACT
        if exact:
            bounds = intervals(q, forest.node_least, forest.node_most), intervals(q, forest.least, forest.most)
        out = []
        for a, (query, label) in enumerate(zip(block["ids"], block["labels"], strict=True)):
            def wanted(low, high):
                return (low <= label) & (label <= high) if same else (low != label) | (high != label)

            kinds = [wanted(forest.node_low_label, forest.node_high_label), wanted(forest.low_label, forest.high_label)]
            ends = [(low[a], high[a]) for low, high in bounds] if exact else [(np.full(len(x), -np.inf), np.full(len(x), np.inf)) for x in kinds]
            known: dict[int, tuple] = {}

            def partners(leaf):
                """Scores and vec_ids of a leaf's rows that may be partners, each leaf once an anchor."""
                if leaf not in known:
                    rows = slice(forest.starts[leaf], forest.ends[leaf])
                    scores = (forest.m[rows] @ q[a]).astype(np.int64) if exact else topk._product(q[a:a + 1], forest.m[rows])[0]
                    ids = forest.ids[rows]
                    may = (ids != query) & ((forest.labels[rows] == label) == same)
                    known[leaf] = scores[may], ids[may]
                return known[leaf]

            for ask, value in enumerate(block["asks"][a] if window else [None]):
                low, high = window(value) if window else (LOWEST, HIGHEST)
                if low <= high:
                    s, i = best_first(forest, ends, kinds, partners, low, high, k)
                    if len(s):
                        out.append((query, ask, shard, [{"score": x, "vec_id": y} for x, y in zip(s.tolist(), i.tolist(), strict=True)]))
        return out

    def run(batches):
        shard, trees, forest = None, [], None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                if row["shard"] != shard:
                    shard, trees, forest = row["shard"], [], None
                if row["kind"] == 0:
                    trees.append(row)
                elif trees or forest:
                    if forest is None:
                        forest, trees = Forest(trees), []
                    found = of_block(row, forest, shard)
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))]
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate(kinds)], ["query_id", "ask", "part", "best"])

    return run


def best_first(forest: Forest, ends, kinds, partners, low: int, high: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, vec_id) of a forest with scores from ``low`` to ``high``.

    ``ends`` and ``kinds``: for nodes and for leaves, the ends of their score
    intervals and whether they may hold a wanted label.
    """
    least, most = ends[0]
    open_ = np.flatnonzero(kinds[0] & (most >= low) & (least <= high))
    queue = [(-min(most[i], high), 0, i) for i in open_.tolist()]
    heapq.heapify(queue)
    scores, ids = np.empty(0, np.int64), np.empty(0, np.int64)
    while queue:
        reach, kind, i = heapq.heappop(queue)
        if len(scores) == k and -reach < scores[-1]:
            break
        if kind == 0:
            least, most = ends[1]
            for leaf in range(forest.first[i], forest.last[i]):
                if kinds[1][leaf] and most[leaf] >= low and least[leaf] <= high:
                    heapq.heappush(queue, (-min(most[leaf], high), 1, leaf))
            continue
        s, v = partners(i)
        floor = max(low, int(scores[-1])) if len(scores) == k else low
        fit = (s >= floor) & (s <= high)
        if fit.any():
            scores, ids = topk._merge(np.concatenate([scores, s[fit]]), np.concatenate([ids, v[fit]]), k)
    return scores, ids


def index(vectors: DataFrame, scale: int = SCALE, tile: int = TILE, leaf: int = LEAF) -> DataFrame:
    """Trees over all ``vectors`` (vec_id, label, v), a written table of :data:`PACKED`."""
    spark = vectors.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.coalesce(F.get("v", F.lit(c)), F.lit(0.0)).alias(f"c{n}") for n, c in enumerate(widest_coordinates(vectors))]
    order = ["label", *(f"c{n}" for n in range(len(by))), "vec_id"]
    dealt = vectors.select("*", *by).repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("vec_id", "label", "v")
    return written(dealt.mapInArrow(pack_trees(scale, tile, leaf), PACKED), "rtree")


def best_of(trees: DataFrame, anchors: DataFrame, k: int, same: bool, window=None, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, ask, best: for each of ``anchors`` (vec_id, label, v, asks) and each ask its k best partners in all trees."""
    shards = max(1, -(-trees.count() // TREES))
    own = trees.withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int"))
    blocks = anchors.mapInArrow(pack_anchors(scale, block), PACKED).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = own.unionByName(blocks).repartition("shard").sortWithinPartitions("shard", "kind")
    lists = topk._merged(met.mapInArrow(search(k, same, window), LISTS), ["query_id", "ask", "part"], k)
    fans = lists.select("query_id", "ask", F.floor(F.col("part") / topk.FAN).cast("int").alias("part"), "best")
    return topk._merged(topk._merged(fans, ["query_id", "ask", "part"], k), ["query_id", "ask"], k)


def share_window(least: int, most: int):
    """Scores from ``least`` to ``most`` hundredths of an ask."""
    return lambda score: (-(-least * score // 100), most * score // 100)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, k: int = 10, least: int = 30, most: int = 90,
                   scale: int = SCALE, tile: int = TILE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Both tables have vec_id, label and embedding; the positives of an anchor
    are its best rows of the same label, the negatives of a positive the best
    rows of other labels that score ``least`` to ``most`` hundredths of it.
    """
    rows = usable(vectors)
    trees = index(rows, scale, tile, leaf)
    asked = usable(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("own")).select("vec_id", "own.label", "own.v")
    asked = written(asked, "rtree-anchors")
    none = F.array().cast("array<long>")
    found = written(best_of(trees, asked.withColumn("asks", none), positives, True, None, scale, block), "rtree-positives")
    with_asks = (asked.join(found.select(F.col("query_id").alias("vec_id"), "best"), "vec_id")
                 .select("vec_id", "label", "v", F.col("best.score").alias("asks")))
    missed = best_of(trees, with_asks, k, False, share_window(least, most), scale, block)
    pos = found.select(F.col("query_id").alias("anchor_id"), F.posexplode("best").alias("at", "hit"))
    return (missed.join(pos, (F.col("query_id") == F.col("anchor_id")) & (F.col("ask") == F.col("at")))
            .select("anchor_id", F.col("hit.vec_id").alias("positive_id"), F.col("hit.score").alias("positive_score"),
                    F.posexplode("best").alias("rank", "other"))
            .select("anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"),
                    F.col("other.vec_id").alias("negative_id"), "positive_score", F.col("other.score").alias("negative_score")))

"""Exact top-k search by tiled matrix products.

Vectors are turned to integers, ``floor(1024 * x)``, and packed into tiles of
``TILE`` rows; queries are packed into blocks of ``BLOCK``. Every query block is
dealt to each of ``shards`` groups of tiles; in a group each block meets each
tile in one matrix product, and a partial selection keeps the k best of the
tile for every query (the query set in blocks against all rows). Lists are
merged as a tree: within a task, then by query and a ``FAN``-th of the shards,
then by query. No list is longer than ``FAN * k`` entries.

Products are taken in double precision, which is exact while all partial sums
stay below 2**53 (checked by the largest norms of the two sides); larger
values take Python integers. Scores beyond 64 bits are held at the limits.

Defined cases: vectors that are null, or hold a null or non-finite component,
take no part; components missing against a longer vector count as 0; an empty
vector scores 0 everywhere; a query's own row is every row with its vec_id;
rows with equal vec_id and equal score for a query count once, as do
repeated queries (same vec_id and vector: different vectors under one vec_id
are pooled as one query with the higher score of each row); null vec_ids take
no part; extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 4096
BLOCK = 512
FAN = 16
K = 10
EXACT = 1 << 53
_LIMIT = (1 << 63) - 1
LISTS = "query_id long, part int, best array<struct<score:long,vec_id:long>>"


def _vectors(col: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that take part, and their components as doubles."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lists = col.cast(pa.list_(pa.float64()))
    values = np.asarray(lists.values.to_numpy(zero_copy_only=False), float)  # nulls become nan
    offsets = lists.offsets.to_numpy()
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    whole = (bad[offsets[1:]] == bad[offsets[:-1]]) & ~lists.is_null().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(whole)
    return rows, [values[offsets[i]:offsets[i + 1]] for i in rows]


def _pack(rows: int):
    """A task that packs vectors (vec_id, embedding) into matrices of ``rows`` vectors of one length."""
    def run(batches):
        held: dict[int, tuple[list, list]] = {}

        def tile(width):
            ids, vectors = held.pop(width)
            m = np.floor(np.stack(vectors) * 1024.0) if width else np.zeros((len(ids), 0))
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())],
                                              ["width", "ids", "matrix"])

        for batch in batches:
            at, vectors = _vectors(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, v in zip(at.tolist(), vectors, strict=True):
                if ids[i] is None:
                    continue
                own = held.setdefault(len(v), ([], []))
                own[0].append(ids[i])
                own[1].append(v)
                if len(own[0]) >= rows:
                    yield tile(len(v))
        for width in list(held):
            yield tile(width)

    return run


def _product(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of q and t, held to 64 bits."""
    width = min(q.shape[1], t.shape[1])
    q, t = q[:, :width], t[:, :width]
    if not width:
        return np.zeros((len(q), len(t)), np.int64)
    largest = np.abs(q).sum(axis=1).max(initial=0) * np.abs(t).max(initial=0)
    if largest < EXACT:
        return (q @ t.T).astype(np.int64)
    big = np.array([[int(x) for x in row] for row in q.tolist()], object) @ np.array([[int(x) for x in row] for row in t.tolist()], object).T
    return np.vectorize(lambda x: max(-_LIMIT - 1, min(_LIMIT, x)), otypes=[np.int64])(big)


def _merge(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct (score, vec_id), highest score first, ties to the smaller id; one entry for a vec_id and score."""
    order = np.lexsort((ids, -scores.astype(object) if (scores == -_LIMIT - 1).any() else -scores))
    s, i = scores[order], ids[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (i[1:] != i[:-1])]) if len(s) else np.empty(0, bool)
    return s[new][:k], i[new][:k]


def _best(scores: np.ndarray, ids: np.ndarray, query: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Partial selection of one query's row of a tile."""
    other = ids != query
    scores, ids = scores[other], ids[other]
    want = 4 * k
    if len(scores) > want:
        least = np.partition(scores, len(scores) - want)[len(scores) - want]
        kept = scores >= least
        s, i = _merge(scores[kept], ids[kept], k)
        if len(s) == k or kept.all():
            return s, i
    return _merge(scores, ids, k)


def _search(k: int):
    def run(batches):
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            part, qw, qids, qm, tw, tids, tm = (batch.column(i) for i in range(7))
            for r in range(batch.num_rows):
                q = np.frombuffer(qm[r].as_py(), float).reshape(-1, qw[r].as_py()) if qw[r].as_py() else np.zeros((len(qids[r]), 0))
                t = np.frombuffer(tm[r].as_py(), float).reshape(-1, tw[r].as_py()) if tw[r].as_py() else np.zeros((len(tids[r]), 0))
                ids = np.array(tids[r].as_py(), np.int64)
                for row, query in zip(_product(q, t), qids[r].as_py(), strict=True):
                    s, i = _best(row, ids, query, k)
                    old = best.get((query, part[r].as_py()))
                    if old is not None:
                        s, i = _merge(np.concatenate([old[0], s]), np.concatenate([old[1], i]), k)
                    best[query, part[r].as_py()] = s, i
            if len(best) > 50_000:
                yield _lists(best)
                best = {}
        if best:
            yield _lists(best)

    return run


def _lists(best):
    rows = [[{"score": a, "vec_id": b} for a, b in zip(s.tolist(), i.tolist(), strict=True)] for s, i in best.values()]
    return pa.RecordBatch.from_arrays([pa.array([q for q, _ in best], pa.int64()), pa.array([p for _, p in best], pa.int32()),
                                       pa.array(rows, pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())])))],
                                      ["query_id", "part", "best"])


def _merged(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    """One level of the tree: lists of equal keys become one of at most k."""
    better = (lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
              .when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0))
    return lists.groupBy(*keys).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best"))), better), 1, k).alias("best"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, tile: int = TILE, block: int = BLOCK, shards: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of ``vectors`` for each of ``queries`` (both vec_id, embedding)."""
    shards = shards or vectors.sparkSession.sparkContext.defaultParallelism * 4
    packed = "width int, ids array<long>, matrix binary"

    def pairs(df):
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    tiles = pairs(vectors).mapInArrow(_pack(tile), packed).select(
        (F.abs(F.xxhash64("matrix", "ids")) % shards).cast("int").alias("shard"), *(F.col(c).alias(f"t_{c}") for c in ("width", "ids", "matrix")))
    blocks = pairs(queries).mapInArrow(_pack(block), packed).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), *(F.col(c).alias(f"q_{c}") for c in ("width", "ids", "matrix")))
    met = tiles.join(blocks, "shard").select("shard", "q_width", "q_ids", "q_matrix", "t_width", "t_ids", "t_matrix")
    lists = met.mapInArrow(_search(k), LISTS)
    lists = _merged(lists, ["query_id", "part"], k)
    fans = lists.select("query_id", F.floor(F.col("part") / FAN).cast("int").alias("part"), "best")
    lists = _merged(_merged(fans, ["query_id", "part"], k), ["query_id"], k)
    return lists.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))

import math
import random

import numpy as np
import pytest

from poolshift.llm import rtree


@pytest.fixture(scope="module")
def make(spark):
    # columns named like outputs and inner columns
    return lambda rows: spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<float>, label int, rank int, v string, ask int")


def mined(rows, positives, k, least=30, most=90, scale=256):
    """Every pair scored; rows as (vec_id, embedding, label)."""
    fine = [(i, [math.floor(scale * float(np.float32(x))) for x in v], c) for i, v, c in rows
            if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, c in fine:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (c, v)), (c, v))
    out = []
    for i, (c, v) in anchors.items():
        scored = {(-sum(a * b for a, b in zip(v, w, strict=False)), j, d == c) for j, w, d in fine if j != i}
        for ps, p in sorted({(s, j) for s, j, same in scored if same})[:positives]:
            fit = sorted({(s, j) for s, j, same in scored if not same and 30 * -ps <= 100 * -s <= most * -ps and least * -ps <= 100 * -s})
            out += [(i, p, r + 1, j, -ps, -s) for r, (s, j) in enumerate(fit[:k])]
    return sorted(out)


def run(make, rows, positives=3, k=4, **kw):
    df = make(rows)
    got = rtree.hard_negatives(df, df.where("vec_id % 100 = 0"), positives, k, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def test_matches_brute_force_over_many_trees(make):
    rnd = random.Random(5)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = [(i, [x + rnd.gauss(0, 0.3) for x in centres[i % 4]], rnd.choice([i % 4, rnd.randrange(4)])) for i in range(700)]
    want = mined(rows, 3, 4)
    assert want and run(make, rows, tile=32, leaf=4, block=3) == want
    assert run(make, rows) == want


def test_ties_at_the_kth_score_go_to_the_smaller_id(make):
    rows = [(i, [1.0, 0.0], 0) for i in (0, 5, 3, 9)] + [(i, [0.5, 0.25 * (i % 2)], 1) for i in range(300, 340)]
    want = mined(rows, 2, 5)
    assert [r[3] for r in want if r[0] == 0][:5] == [300, 301, 302, 303, 304]
    assert run(make, rows, 2, 5, tile=8, leaf=2) == want


def test_nulls_repeats_lengths_and_labels(make):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (100, [2.0], 2), (100, [1.0], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5], 2),
            (3, None, 1), (4, [nan, 1.0], 1), (5, [inf], 1), (6, [None, 1.0], 2), (7, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (8, [], 1),
            (9, [0.5, 0.25, 7.0], 3), (200, [], 3), (300, [1.0], 77), (10, [-1.0, 0.0], 2), (11, [0.25, 0.25], 2)]
    assert run(make, rows, 5, 10) == mined(rows, 5, 10)


def test_scores_beyond_double_precision(make):
    rows = [(0, [2.0**24, 1.0], 0), (1, [2.0**16, 1.0], 0), (2, [2.0**15, 0.5], 1), (3, [2.0**15, 0.75], 1), (4, [2.0**14, 0.0], 1)]
    want = mined(rows, 1, 2)
    assert [r[3] for r in want] == [3, 2] and want[0][5] - want[1][5] == 256 * 64
    assert run(make, rows, 1, 2) == want


def test_empty(make):
    assert run(make, []) == []
    assert run(make, [(0, [1.0], 1)]) == []


def test_boxes_hold_their_products_and_prune():
    rnd = np.random.default_rng(1)
    q, box = rnd.integers(-9, 9, (5, 6)).astype(float), rnd.integers(-9, 9, (40, 6)).astype(float)
    low, high = rtree.intervals(q, box.min(axis=0)[None], box.max(axis=0)[None])
    assert ((q @ box.T).min(axis=1) >= low[:, 0]).all() and ((q @ box.T).max(axis=1) <= high[:, 0]).all()
    m = np.concatenate([rnd.normal(c, 1, (64, 2)) for c in ([0, 0], [90, 0], [0, 90], [90, 90])])
    order, sizes = rtree.sort_tile(m, np.zeros(len(m), int), 16)
    assert sorted(order) == list(range(len(m))) and sum(sizes) == len(m) and max(sizes) <= 16
    ids, forest_rows, visited = np.arange(len(m)), m[order], []
    ends = np.cumsum(sizes)
    starts = ends - sizes
    tree = dict(width=2, ids=ids[order].tolist(), labels=[0] * len(m), matrix=forest_rows.tobytes(), leaves=sizes,
                boxes=np.minimum.reduceat(forest_rows, starts).tobytes() + np.maximum.reduceat(forest_rows, starts).tobytes(), spans=[0] * 2 * len(sizes))
    forest = rtree.Forest([tree])
    q = np.array([1.0, 0.5])

    def partners(leaf):
        visited.append(leaf)
        rows = slice(forest.starts[leaf], forest.ends[leaf])
        return np.floor(forest.m[rows] @ q).astype(np.int64), forest.ids[rows]

    sides = [tuple(x[0] for x in rtree.intervals(q[None], a, b)) for a, b in ((forest.node_least, forest.node_most), (forest.least, forest.most))]
    every = [np.ones(len(forest.first), bool), np.ones(len(ends), bool)]
    s, _ = rtree.best_first(forest, sides, every, partners, -10**6, 10**6, 3)
    assert s.tolist() == sorted(np.floor(m @ q).astype(int).tolist())[::-1][:3]
    assert len(visited) < len(ends) / 2

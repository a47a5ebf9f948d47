import random

import pytest

from poolshift.llm import topk

from .brute import top_k


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def run(make, rows, k=3, **kw):
    df = make([(i, v, "x") for i, v in rows])
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), k, **kw)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def test_matches_brute_force_over_many_tiles(make):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([0.5, -0.25, 1.0, 0.001, -0.7]) for _ in range(6)]) for i in range(420)]
    want = sorted(top_k(rows, [r for r in rows if r[0] % 100 == 0], 3))
    assert run(make, rows, tile=16, block=2, shards=40) == want


def test_nulls_ties_repeats_and_lengths(make):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]),
            (6, [None, 9.0]), (None, [5.0, 5.0]), (7, [2.0]), (8, []), (1, [1.0, 0.0]), (100, [])]
    want = sorted(top_k([(i, v) for i, v in rows], [(0, [1.0, 1.0]), (100, [])], 10))
    assert run(make, rows, k=10) == want


def test_scores_beyond_double_precision(make):
    rows = [(0, [2.9e6, 1.0]), (1, [2.9e6, 0.001]), (2, [2.9e6, 0.002]), (3, [1e38, 0.0])]
    got = run(make, rows, k=3)
    assert [r[2] for r in got] == [3, 2, 1]
    assert got[0][3] == (1 << 63) - 1
    assert got[1][3] == int(2.9e6 * 1024) ** 2 + 1024 * 2


def test_empty(make):
    assert run(make, []) == []
    assert run(make, [(0, [1.0])]) == []

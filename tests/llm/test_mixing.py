import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from poolshift.llm import mixing

ROW = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("source", T.StringType()),
                                                     ("size", T.StringType()), ("taken", T.StringType()), ("src", T.StringType()), ("n", T.StringType()))])


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: spark.createDataFrame([(*r, "size", "taken", "src", "n") for r in rows], ROW)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shares(sizes):
    """{source: target} by resharing the excess round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    held = {}
    while True:
        free = [s for s in names if s not in held]
        left = sum(sizes.values()) - sum(held.values())
        if not free:
            return held
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if 3 * sizes[s] < level * weight[s]]
        if not full:
            return held | {s: level * weight[s] for s in free}
        held |= {s: 3.0 * sizes[s] for s in full}


def want(rows):
    sizes, laid = defaultdict(int), defaultdict(list)
    for i, t, s in rows:
        sizes[s] += words(t)
        laid[s].append((hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, words(t)))
    out = []
    for s, target in shares(sizes).items():
        stream = [n for n, (_, _, size) in enumerate(sorted(laid[s])) for _ in range(size)] * 3
        taken = stream[:min(int(target + 0.5), len(stream))]
        for n, (_, i, size) in enumerate(sorted(laid[s])):
            out.append((i, s, size, sizes[s], round(target, 6), taken.count(n)))
    return sorted(out, key=repr)


def run(df):
    return sorted(((-1 if r.doc_id is None else r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mixed(df).collect()), key=repr)


def test_targets_are_met_to_the_word(make):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randrange(40), rnd.choice(["big"] * 6 + ["b", "c", "é", "", "\U0001F600", None])) for i in range(260)]
    rows += [(1000, "only three words", "tiny"), (1001, "", "void"), (1002, None, "void"), (1003, "x " * 3000, "big")]
    assert run(make(rows)) == want(rows)
    again = make(rows).repartition(5)
    assert run(again) == want(rows)


def test_blocks_longer_and_shorter_than_documents(make, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.randrange(30), "abcdefg"[min(6, int(rnd.expovariate(0.7)))]) for i in range(150)]
    for block in (7, 64, 4096):
        monkeypatch.setattr(mixing, "block_words", lambda total, b=block: b)
        assert run(make(rows)) == want(rows)


def test_schedule_spreads_every_source(make):
    rows = [(i, "w " * 20, "abc"[i % 3]) for i in range(300)]
    _, pieces = mixing.mix(make(rows))
    placed = defaultdict(list)
    for r in pieces.collect():
        placed[r.src].append((r.at, r.taken))
    total = sum(n for v in placed.values() for _, n in v)
    assert total == 6000
    for v in placed.values():
        v.sort()
        share, half = sum(n for _, n in v) / total, sum(n for at, n in v if at < v[-1][0] / 2)
        assert abs(half / (total / 2) - share) < 0.02


def test_points_all_differ(spark):
    for bits, slots in ((1, 2), (5, 32), (18, 1 << 18)):
        got = [r.point for r in mixing.golden_points(spark, slots, bits).collect()]
        assert sorted(got) == list(range(1 << bits))
    far = mixing.golden_points(spark, 1, 40).selectExpr("max(point)").first()[0]
    assert far == 0


def test_repeats_nulls_and_empty(make):
    rows = [(1, "a b", "s")] * 12 + [(None, "a b c", None), (None, "a", None), (2, "", None)]
    assert run(make(rows)) == want(rows)
    assert run(make([])) == []
    assert run(make([(1, None, "s"), (2, " ", None)])) == [(1, "s", 0, 0, 0.0, 0), (2, None, 0, 0, 0.0, 0)]

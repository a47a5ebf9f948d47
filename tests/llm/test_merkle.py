import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from poolshift.llm import merkle

ROW = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("source", T.StringType()), ("lang", T.StringType()), ("n_chars", T.LongType()), ("text", T.StringType()),
    ("leaf", T.StringType()), ("root", T.StringType()), ("tree", T.StringType()), ("n", T.StringType()), ("lo", T.StringType()))])


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: spark.createDataFrame([(*r, "leaf", "root", "tree", "n", "lo") for r in rows], ROW)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tampered(row):
    if row[0] is None or zlib.crc32(str(row[0]).encode()) % 5 or row[4] is None:
        return row
    return (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def runs(tree, i):
    """Per level the digests left and right of node i's ancestor."""
    for level in tree[:-1]:
        first = i // 16 * 16
        yield level[first:i], level[i + 1:first + 16]
        i //= 16


def want(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in by_source[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, r in enumerate(by_source[s]):
            path = [*runs(trees[s], i), *runs(top, at)]
            fold = leaf(tampered(r))
            for left, right in path:
                fold = H(*left, fold, *right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], H(*(d for left, right in path for d in left + right)), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


def run(df):
    got = merkle.verify(merkle.manifest(df)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(map(tuple, got.collect()), key=repr)


def test_matches_a_plain_tree(make):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["hot"] * 9 + [f"s{j}" for j in range(20)] + ["", None, "é"]), rnd.choice(["en", None]), rnd.choice([None, 0, -3, 12345]),
             rnd.choice([None, "", "Some Text", "lower only", "ÀÉ Upper"])) for i in rnd.sample(range(100_000), 900)]
    assert run(make(rows)) == want(rows)
    assert not all(r[-1] for r in want(rows))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 273])
def test_runs_full_and_short(make, n):
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(n)]
    assert run(make(rows)) == want(rows)


def test_repeated_rows_and_null_ids(make):
    rows = [(7, "s", "en", 1, "A")] * 40 + [(None, "s", None, None, None), (None, None, None, None, "B"), (7, "s", "en", 1, "C")]
    assert run(make(rows)) == want(rows)


def test_a_null_differs_from_its_mark_and_fields_from_their_joint(make):
    rows = [(1, "a", "-", None, "x"), (1, "a", None, None, "x"), (2, "ab", "c", 1, ""), (2, "a", "bc", 1, "")]
    assert len({r[1] for r in run(make(rows))}) == 4


def test_empty_table(make):
    assert run(make([])) == []


def test_siblings_are_the_rest_of_the_parents_interval(make):
    rows = [(i, "s", None, None, None) for i in range(40)]
    path = {r.doc_id: r.path for r in merkle.manifest(make(rows)).collect()}
    assert [(len(p["left"]) // 64, len(p["right"]) // 64) for p in path[20]] == [(4, 11), (1, 1)]
    assert [(len(p["left"]) // 64, len(p["right"]) // 64) for p in path[39]] == [(7, 0), (2, 0)]

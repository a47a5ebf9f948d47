import math
from collections import Counter

import pytest

from poolshift.llm import lm_score as L

from .brute import LOWER, WORD


def plain(docs, target, slots=None):
    """(n, target loss, background loss) per row, with exact pair counts."""
    read = lambda t: WORD.findall((t or "").translate(LOWER))
    counts = {"ours": (Counter(), Counter(), Counter()), "every": (Counter(), Counter(), Counter())}
    vocabulary = set()
    for i, t in docs:
        w = read(t)
        vocabulary |= set(w)
        for side in ("every", "ours") if i in target else ("every",):
            words, pairs, contexts = counts[side]
            for a, b in zip([None, *w], w):
                words[b] += 1
                pairs[a, b] += 1
                contexts[a] += 1
    size = len(vocabulary) + 2
    out = []
    for i, t in docs:
        w, means = read(t), []
        for side in ("ours", "every"):
            words, pairs, contexts = counts[side]
            total, tokens = 0.0, sum(words.values())
            for a, b in zip([None, *w], w):
                base = (words[b] + 1) / (tokens + size)
                lam = L.LAMBDA if contexts[a] else 0
                total -= math.log(lam * pairs[a, b] / max(contexts[a], 1) + (1 - lam) * base)
            means.append(total / max(len(w), 1))
        out.append((i, len(w), *means, means[1] - means[0]))
    return out


DOCS = [(i, "the sea is old and the wind is new" if i % 3 else "buy now cheap cheap offer buy now") for i in range(30)] + [
    (50, None), (51, ""), (52, "The SEA\tis cheap"), (None, "buy the sea"), (3, "another row of one id"), (60, "long " * 20_000)]


@pytest.mark.parametrize("target", [[1, 2, 4, 5, 52], []])
def test_matches_plain_counts(spark, make_docs, target):
    ids = spark.createDataFrame([(i,) for i in [*target, *target, None]], "doc_id long")
    got = L.score_documents(make_docs(DOCS), ids).collect()
    want = plain(DOCS, set(target))
    key = lambda r: (str(r[0]), r[1], round(r[4], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)


def test_target_like_text_scores_higher(spark, make_docs):
    got = {r["doc_id"]: r["score"] for r in L.score_documents(make_docs(DOCS), spark.createDataFrame([(1,), (2,), (4,)], "doc_id long")).collect()}
    assert got[5] > 0 > got[6]


def test_small_vocabulary_and_empty_table(spark, make_docs):
    ids = spark.createDataFrame([(1,)], "doc_id long")
    assert L.score_documents(make_docs(DOCS), ids, vocabulary_size=2, slots=8).count() == len(DOCS)
    assert L.score_documents(make_docs([]), ids).collect() == []


@pytest.mark.parametrize(("vocabulary_size", "slots", "bucket"), [(2, 8, 1 << 20), (30, 40, 50), (1, 1, 7)])
def test_bounds_of_what_is_sent_change_no_score(spark, make_docs, vocabulary_size, slots, bucket):
    docs = DOCS + [(100 + i, f"rare{i} rare{i % 3} the rare{i % 2} rare{i} sea") for i in range(12)]
    ids = spark.createDataFrame([(i,) for i in (1, 2, 52, 101, 104)], "doc_id long")
    got = L.score_documents(make_docs(docs), ids, vocabulary_size=vocabulary_size, slots=slots, bucket=bucket).collect()
    key = lambda r: (str(r[0]), r[1], round(r[4], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(plain(docs, {1, 2, 52, 101, 104}), key=key), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)


@pytest.mark.parametrize(("block", "bucket"), [(1, 7), (3_000, 100), (8 << 20, 1)])
def test_blocks_and_buckets_change_no_score(spark, make_docs, block, bucket):
    docs = DOCS + [(100 + i, f"rare{i} rare{i % 3} the rare{i % 2} rare{i} sea") for i in range(200)]
    ids = spark.createDataFrame([(i,) for i in (1, 2, 52, 101, 104)], "doc_id long")
    got = L.score_documents(make_docs(docs), ids, block=block, bucket=bucket).collect()
    key = lambda r: (str(r[0]), r[1], round(r[4], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(plain(docs, {1, 2, 52, 101, 104}), key=key), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)


def test_packed_columns_come_back():
    import numpy as np

    columns = [np.array(x, np.uint64) for x in ([0, 255], [256, 3], [0, 0], [1 << 40, 2**64 - 1])]
    assert [x.tolist() for x in L.unpacked(L.packed(*columns), 4)] == [x.tolist() for x in columns]
    assert [len(x) for x in L.unpacked(L.packed(np.empty(0, int), np.empty(0, int)), 2)] == [0, 0]


def test_more_target_ids_than_are_broadcast(spark, make_docs, monkeypatch):
    monkeypatch.setattr(L, "THIN", 4)
    ids = spark.createDataFrame([(i,) for i in (1, 2, 4, 5, 52, 60)], "doc_id long")
    got = L.score_documents(make_docs(DOCS), ids).collect()
    key = lambda r: (str(r[0]), r[1], round(r[4], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(plain(DOCS, {1, 2, 4, 5, 52, 60}), key=key), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)

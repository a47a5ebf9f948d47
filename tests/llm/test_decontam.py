import random

import numpy as np
import pytest

from poolshift.llm import decontam as D

from .brute import tiles


def test_tiling_equals_the_definition():
    rnd = random.Random(8)
    for _ in range(60):
        a = [rnd.randint(0, 5) for _ in range(rnd.randint(1, 24))]
        b = [rnd.randint(0, 5) for _ in range(rnd.randint(1, 40))]
        got = D.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert sum(t[2] for t in got) == tiles(a, b, 3)
        for i, j, n in got:
            assert a[i:i + n] == b[j:j + n]


def test_repetitive_texts_stay_fast():
    import time
    item, doc = np.array([1, 2] * 15, np.uint64), np.array([1, 2] * 100_000, np.uint64)
    start = time.perf_counter()
    assert D.tile(item, doc, 3) == [(0, 0, 30)]
    assert sum(t[2] for t in D.tile(np.array([1, 2, 3] * 20, np.uint64), doc, 2)) == 40
    assert time.perf_counter() - start < 5


def corpus():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rnd.randint(20, 40)))) for i in range(12)] + [(20, "short one"), (21, ""), (22, None)]
    docs = []
    for i in range(60):
        words = [word() for _ in range(rnd.randint(0, 80))]
        _, item = items[rnd.randrange(12)]
        w = item.split()
        kind = i % 4
        if kind == 1:
            words[5:5] = [x.upper() + "," for x in w]
        elif kind == 2:  # three pieces, out of order
            n = len(w) // 3
            words = w[2 * n:] + words + w[:n] + ["q"] + w[n:2 * n]
        elif kind == 3:
            words += w[:len(w) // 2]
        docs.append((i, " ".join(words)))
    return docs + [(90, None), (91, ""), (92, "a short one here"), (None, items[0][1]), (1, docs[1][1])], items


@pytest.mark.parametrize("block_words", [1 << 20, 30])
def test_matches_brute_force(make_docs, make_items, block_words):
    docs, items = corpus()
    got = D.leaks(make_docs(docs), make_items(items), block_words=block_words)
    leaked = {}
    for r in got.collect():
        leaked.setdefault(r["doc_id"], set()).update(r["items"])
    want = {}
    for i, t in docs:
        own = want.setdefault(i, set())
        for n, item in items:
            a, b = D.words_of(item), D.words_of(t)
            if a and tiles(a, b, min(3, len(a))) / len(a) >= D.THRESHOLD:
                own.add(n)
    assert leaked == want
    assert any(want[i] for i in range(2, 60, 4)) and not any(want[i] for i in range(0, 60, 4))
    kept = D.decontaminate(make_docs(docs), make_items(items), block_words=block_words)
    assert kept.columns == make_docs([]).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((i for i, _ in docs if not want[i]), key=str)


def test_empty_tables(make_docs, make_items):
    docs = make_docs([(1, "a b c d e")])
    assert D.leaks(make_docs([]), make_items([(1, "a b c d")])).collect() == []
    assert [tuple(r) for r in D.leaks(docs, make_items([])).select("doc_id", "items").collect()] == [(1, [])]
    assert D.decontaminate(docs, make_items([])).count() == 1


def test_one_row_per_document_at_any_benchmark_size(make_docs, make_items):
    docs, items = corpus()
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    whole, blocks = (sorted(map(tuple, D.leaks(make_docs(docs), make_items(items), block_words=n).collect()), key=key) for n in (1 << 20, 30))
    assert len(blocks) == len(docs) and blocks == whole

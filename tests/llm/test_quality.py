import random
import zlib

import numpy as np

from poolshift.llm import quality as Q
from poolshift.llm.labels import training_ids


def corpus(n=400):
    rnd = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.6
        words = [rnd.choice(["the", "sea", "Wind", "over", "old", "hills"]) for _ in range(rnd.randint(5, 80))]
        docs.append((i, " ".join(words) + "." if good else " | ".join(words) + " $$$ ###"))
        if i % 4:
            labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_rows_are_scored_right(make_docs, make_labels):
    docs, labels = corpus()
    truth = {i: q for i, q, _ in labels}
    got = Q.score_quality(make_docs(docs), make_labels(labels)).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert held and np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)


def test_edges(make_docs, make_labels):
    docs, labels = corpus(60)
    odd = [(900, None), (901, ""), (None, "x"), (902, "y" * 200_000), (0, docs[0][1])]
    got = Q.score_quality(make_docs(docs + odd), make_labels(labels + [(None, 1, 0), (3, None, 1), (1, 0, 0), (1, 1, 0)])).collect()
    assert len(got) == 65 and all(r["score"] is not None for r in got)
    for few in ([], [(1, 1, 0), (2, 1, 1)]):
        assert len({r["score"] for r in Q.score_quality(make_docs(docs), make_labels(few)).collect()}) == 1
    assert Q.score_quality(make_docs([]), make_labels(labels)).collect() == []


def test_sample_is_bounded_and_never_held_out(make_labels):
    rows = training_ids(make_labels([(i, i % 2, 0) for i in range(500)]), "quality", 5, 0, 50).collect()
    assert len(rows) == 100 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


def test_flat_trees_equal_a_walk():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(500, len(Q.STATS)))
    y = (x[:, 2] * x[:, 5] + 0.3 * x[:, 1] > 0).astype(float)
    f = Q.fit(x, y, trees=12)
    total = np.full(500, f.base)
    for t in range(12):
        for r in range(500):
            node = 0
            while f.feature[t, node] >= 0:
                node = 2 * node + 1 + int(x[r, f.feature[t, node]] > f.limit[t, node])
            total[r] += f.value[t, node]
    assert np.allclose(f.score(x), 1 / (1 + np.exp(-total)))
    assert ((f.score(x) > 0.5) == y).mean() > 0.9


def test_a_smaller_sample_keeps_the_class_mix(make_docs, make_labels):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choice(["the", "sea", "Wind", "over"]) for _ in range(rnd.randint(5, 40)))) for i in range(900)]
    labels = make_labels([(i, int(rnd.random() < 0.85), 0) for i in range(900)])
    rows = training_ids(labels, "quality", 5, 0, 60).collect()
    assert len(rows) == 120 and len({r["weight"] for r in rows}) == 2
    mean = [np.mean([r["score"] for r in Q.score_quality(make_docs(docs), labels, per_class=n).collect()]) for n in (60, 10_000)]
    assert abs(mean[0] - mean[1]) < 0.08 and mean[1] > 0.8


def test_fit_does_not_depend_on_the_order_of_repeated_ids(make_docs, make_labels):
    rows = [(i % 40, ("good words in a row. " if i % 3 else "x1 x2 !!! ") * (i % 7 + 1)) for i in range(120)]
    labels = make_labels([(i, int(i % 3 > 0), 0) for i in range(40)])
    one, other = (sorted(map(tuple, Q.score_quality(make_docs(r), labels).collect())) for r in (rows, rows[::-1]))
    assert one == other

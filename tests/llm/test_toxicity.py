import random
import zlib

import numpy as np
import pytest

from poolshift.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rnd = random.Random(1)
    words = ["idiot", "moron", "scum", "worthless", "pathetic", "worth"]
    lexicon = T.Lexicon(words, ["stupi"], frozenset(["idiom"]))
    for _ in range(4000):
        w = list(rnd.choice([*words, "stupid", "stu", "idiom", "other"]))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(w))
            w[at:at + rnd.randint(0, 1)] = rnd.choice(["", "x", "t", "i"])
        w = "".join(w)
        near = [d for t in words if (d := distance(w, t)) <= T.edits_allowed(t)]
        best = min(near, default=None)
        if best == 0:
            want = ("word", 0)
        elif w.startswith("stupi"):
            want = ("stem", 0)
        else:
            want = ("word", best) if best and w != "idiom" else None
        assert lexicon.find(w) == want, w


def corpus(n=300):
    rnd = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice("the sea wind over old hills and river".split()) for _ in range(rnd.randint(10, 60))]
        toxic = i % 3 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rnd.randint(0, len(words)), rnd.choice(["snarfle", "grumbolt", "veckless"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def data():
    return corpus()


def test_held_out_rows_are_scored_right(make_docs, make_labels, data):
    docs, labels = data
    truth = {i: t for i, _, t in labels}
    got = T.score_toxicity(make_docs(docs), make_labels(labels)).collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"]]) > 0.97


def test_misspelt_quoted_and_odd_rows(make_docs, make_labels, data):
    docs, labels = data
    scorer = T.train(make_docs(docs), make_labels(labels))
    hits = lambda t: dict(zip(T.FEATURES, T.measure(t, scorer.lexicon)))
    assert hits("you snnarfle, grumb0lt")["misspelt"] > 0 and hits("you grumb0lt")["exact"] > 0
    assert hits('he said "you snarfle" today') | {"addressed": 0} == {k: 0 for k in T.FEATURES} | {"quoted": np.log1p(1)}
    odd = [(900, None), (901, ""), (None, "snarfle " * 4), (902, "snarfle " * 40_000), (0, docs[0][1])]
    got = T.score_toxicity(make_docs(docs + odd), make_labels(labels + [(None, 1, 1), (4, 1, 1), (5, 1, None)])).collect()
    assert len(got) == len(docs) + 5 and all(r["score"] is not None for r in got)
    assert {r["doc_id"]: r["predicted"] for r in got}[None] == 1


def test_filter_keeps_clean_rows_and_columns(make_docs, make_labels, data):
    docs, labels = data
    kept = T.without_toxic(make_docs(docs), make_labels(labels))
    assert kept.columns == make_docs([]).columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {i for i, _, t in labels if not t} <= ids and len(ids & {i for i, _, t in labels if t}) <= 3


def test_without_labels_or_documents(make_docs, make_labels, data):
    docs, labels = data
    for few in ([], [(1, 1, 0), (2, 1, 0)]):
        assert len({r["score"] for r in T.score_toxicity(make_docs(docs[:20]), make_labels(few)).collect()}) == 1
    assert T.score_toxicity(make_docs([]), make_labels(labels)).collect() == []


def test_a_smaller_sample_keeps_the_class_mix(make_docs, make_labels):
    docs, _ = corpus(600)
    # of the toxic rows, half hold no toxic word
    toxic = {i for i in range(600) if i % 6 == 0 or i % 12 == 1}
    docs = [(i, t if i % 6 == 0 else " ".join(w for w in t.split() if w not in ("snarfle", "grumbolt", "veckless"))) for i, t in docs]
    labels = make_labels([(i, 1, int(i in toxic)) for i, _ in docs])
    mean = [np.mean([r["score"] for r in T.score_toxicity(make_docs(docs), labels, per_class=n).collect()]) for n in (40, 5_000)]
    assert abs(mean[0] - mean[1]) < 0.06

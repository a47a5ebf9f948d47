import random

import pytest

from poolshift.llm import substrings as S

from .brute import repeats


def texts(window, seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passages = [[rnd.choice(vocab) for _ in range(n)] for n in (window - 1, window, window + 1, 3 * window, 7 * window)]
    rows = []
    for i in range(50):
        words = []
        for _ in range(rnd.randint(1, 4)):
            words += [rnd.choice(vocab) for _ in range(rnd.randint(0, window))]
            p = rnd.choice(passages)
            words += p[rnd.randint(0, len(p) // 3):]
        rows.append((i, "  ".join(words)))
    return rows + [(60, rows[3][1]), (61, rows[3][1] + " w1"), (62, "x " * 5 * window), (63, "x " * 3 * window), (64, "x y " * 2 * window)]


def check(got, rows, window):
    assert sorted(map(tuple, got), key=str) == sorted(repeats(rows, window), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(make_docs, seed):
    rows = texts(50, seed)
    check(S.remove_repeats(make_docs(rows)).collect(), rows, 50)


def test_small_windows_branch_often(make_docs):
    rows = texts(8, 3)
    check(S.remove_repeats(make_docs(rows), window=8, k=3).collect(), rows, 8)


def test_edges(make_docs):
    text = " ".join(f"v{i}" for i in range(120))
    rows = [(1, None), (2, ""), (3, " \n "), (5, text), (5, text), (4, text.replace(" ", "\t")), (6, "start " + text), (6, "other " + text),
            (7, text[:100]), (None, text), (None, None)]
    check(S.remove_repeats(make_docs(rows)).collect(), rows, 50)
    assert S.remove_repeats(make_docs([])).collect() == []

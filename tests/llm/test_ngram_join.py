import random

import numpy as np
import pytest

from poolshift.llm import ngram_join as N

from .brute import near_duplicates


def texts(seed=5):
    """Groups of near copies by chains of edits, with a frequent passage, and texts of their own."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    common = " ".join(word() for _ in range(20))
    rows, i = [], 0
    for _ in range(14):
        base = [word() for _ in range(rnd.randint(3, 70))]
        for _ in range(rnd.randint(1, 9)):
            rows.append((i, " ".join([*base, common] if rnd.random() < 0.7 else base)))
            i += rnd.randint(1, 3)
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(base))
                base = base[:at] + [word()] * rnd.randint(0, 2) + base[at + 1:] or [word()]
    rnd.shuffle(rows)
    return rows


def check(got, rows):
    want = near_duplicates(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len(got) == len(rows)


@pytest.mark.parametrize("kw", [{}, {"tile": 3}, {"frequent": 5}])
def test_matches_brute_force(make_docs, kw):
    rows = texts()
    check(N.near_duplicates(make_docs(rows), **kw).collect(), rows)


def test_edges(make_docs):
    long = " ".join(str(i % 977) for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "ONE  two"), (6, "one"), (7, "a b c d e"), (8, "A b\tc d e"),
            (9, "É b c d e"), (10, "é b c d e"), (11, long), (12, long + " end")]
    check(N.near_duplicates(make_docs(rows)).collect(), rows)


def test_repeated_rows_null_ids_and_empty_tables(make_docs):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "zz"), (None, None)]
    got = sorted(map(tuple, N.near_duplicates(make_docs(rows)).collect()), key=str)
    assert got == sorted([(3, 2, 3), (3, 2, 3), (5, 2, 3), (None, 2, 3), (None, 1, None), (None, 0, None)], key=str)
    assert N.near_duplicates(make_docs([])).collect() == []


def test_one_of_each_keeps_columns(make_docs):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (4, "x y"), (None, "q")]
    kept = N.one_of_each(make_docs(rows))
    assert kept.columns == make_docs([]).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 4, None]


def test_one_of_each_keeps_columns_named_like_inner_ones(spark):
    names = ["sig", "_sig", "SIG_", "component_id", "row", "n", "rows"]
    rows = [(i, t, *names) for i, t in [(1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, "z"), (None, "z"), (None, "")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = N.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3], rows[5]], key=str)


def test_pairing_rounds_meet_other_components_only():
    import pyarrow as pa
    rnd = np.random.default_rng(2)
    for task, most in ((N._meetings, N.MEETINGS), (N._crossing, 40)):
        sizes, comp = np.sort(rnd.integers(10, 14, 40)), rnd.integers(0, 3, 40)
        cols = [np.full(40, 7), np.zeros(40, int), sizes, np.arange(40), np.zeros(40, int), comp]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["token", "tile", "n", "sig", "pos", "component"])
        pairs = {p for out in task([batch]) for p in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
        assert pairs and all(a < b and comp[a] != comp[b] for a, b in pairs)
        bound = {(a, b) for b in range(40) for a in range(b) if comp[a] != comp[b] and 4 * sizes[a] >= 3 * sizes[b]
                 and sizes[a] >= -(-3 * (sizes[a] + sizes[b]) // 7)}
        assert pairs <= bound and (pairs == bound if task is N._crossing else len(pairs) <= most * 40)


def test_counts_in_bounded_memory():
    rnd = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([[5, 6], rnd.integers(10, 1 << 40, 30)])).astype(np.uint64) for _ in range(200)]
    for most in (1 << 20, 100):
        counts = N.Counts(most)
        for i in range(0, 200, 7):
            counts.add(sets[i:i + 7])
            assert counts.rows <= most + 7 * 32
        h, n = counts.often()
        assert dict(zip(h.tolist(), n.tolist(), strict=True)) == {5: 200, 6: 200}
    empty = N.Counts()
    empty.add([])
    assert len(empty.often()[0]) == 0


def test_trie_agrees_with_set_arithmetic():
    rnd = np.random.default_rng(1)
    order = rnd.permutation(60).astype(np.uint64)
    sets = [(i, order[np.sort(rnd.choice(60, rnd.integers(1, 30), replace=False))]) for i in range(80)]
    for _, s in sets[:20]:
        want = sorted(i for i, o in sets if 100 * len(set(s) & set(o)) >= 75 * len(set(s) | set(o)))
        assert sorted(N.Trie(sets).linked(np.sort(s))) == want


def test_a_common_token_meets_all_pairs_of_tiles():
    tiles = {sig: {t for _, t in N._tiles_of(np.array([10]), sig, 3)} for sig in range(12)}
    assert all(tiles[a] & tiles[b] for a in tiles for b in tiles)


def test_texts_of_one_doc_id_are_one_document(make_docs):
    a, b, c = ("a b c d e f g", "k l m n o p q", "r s t u v w x")
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (8, c), (9, ""), (11, ""), (12, b + " r")]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in N.near_duplicates(make_docs(rows)).collect()}
    assert got == {(3, 3): 3, (5, 3): 3, (7, 3): 3, (9, 3): 8, (8, 3): 8, (9, 0): 8, (11, 0): 11, (12, 4): 3}


def test_one_of_each_of_repeated_rows_and_null_ids(make_docs):
    a, b, c = ("a b c d e f g", "k l m n o p q", "r s t u v w x")
    rows = [(1, a), (1, a), (1, b), (2, a), (None, a), (None, c), (None, c), (None, None), (4, ""), (4, ""), (6, "z"), (6, "")]
    kept = N.one_of_each(make_docs(rows)).collect()
    ids = sorted((r["doc_id"] for r in kept), key=str)
    assert ids == [1, 4, 6, None, None]
    assert [r["text"] for r in kept if r["doc_id"] == 6] == ["z"] and {r["text"] for r in kept if r["doc_id"] is None} == {c, None}


def test_sets_that_share_many_shingles_are_paired_once_and_those_that_share_too_few_never():
    import pyarrow as pa
    rnd = random.Random(4)
    shared = {sig: sorted(rnd.sample(range(30), 24)) for sig in range(12)} | {sig: [5] for sig in (12, 13)}
    rows = []
    for sig, tokens in shared.items():
        for pos, token in enumerate(tokens):
            before = [tokens[pos - k] if pos >= k else token for k in (1, 2, 3)]
            rows.append((token, 0, 100, sig, pos, sig, len(tokens), *before))
    rows.sort()
    names = ["token", "tile", "n", "sig", "pos", "component", "held", "before1", "before2", "before3"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
    pairs = [p for x in N._crossing([batch]) for p in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
    first = {(a, b): min(set(shared[a]) & set(shared[b])) for a in range(12) for b in range(a + 1, 12)}
    # bounds of position hold at the first common shingle or the pair can't link
    fits = {p for p, t in first.items() if max(shared[p[0]].index(t), shared[p[1]].index(t)) <= 100 - N.needed(100, 100)}
    assert set(pairs) >= fits and all(a < 12 and b < 12 for a, b in pairs)
    met = sum(len(i) for _, i, _ in N._apart([batch], N._every_pair))
    assert met <= 1.2 * len(fits)


def test_further_links_join_components(spark):
    from poolshift.llm.components import components, joined
    rnd = random.Random(9)
    for _ in range(2):
        links = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)]
        df = spark.createDataFrame(links, "u long, v long")
        some = components(df.limit(0).unionByName(spark.createDataFrame(links[:50], "u long, v long")))
        got = sorted(map(tuple, joined(some, spark.createDataFrame(links[50:], "u long, v long")).collect()))
        assert got == sorted(map(tuple, components(df).collect()))


def test_links_of_many_hubs_become_one_a_node(spark, monkeypatch):
    from poolshift.llm import components as C
    held, before = [], {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    monkeypatch.setattr(C, "written", lambda df, name, f=C.written: held.append(f(df, name)) or held[-1])
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rnd = random.Random(3)
        hubs = sorted(rnd.sample(range(10**6), 60))
        links = [(h, i) for i in rnd.sample(range(10**6), 1500) for h in rnd.sample(hubs, 4)]
        got = C.components(spark.createDataFrame(links, "u long, v long"))
        nodes = {x for pair in links for x in pair}
        assert {tuple(r) for r in got.collect()} == {(n, min(nodes)) for n in nodes - {min(nodes)}}
        assert 2 * held[1].count() < held[0].count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

import zlib
from collections import Counter

from poolshift.llm import shards as S


def want(rows, n):
    """{(doc_id, crc): sorted shards, ...} by laying all rows out in key order."""
    keyed = sorted((zlib.crc32((t or "").encode()), -(1 << 63) if i is None else i, len((t or "").encode()) + 1) for i, t in rows)
    total, below, out, used = sum(k[2] for k in keyed), 0, [], Counter()
    for crc, i, size in keyed:
        shard = below * n // total
        out.append((i, size, crc, shard, used[shard]))
        used[shard] += 1
        below += size
    return sorted(out)


def check(df, rows, n=8, **kw):
    got = S.shard_documents(df, n, **kw)
    assert set(got.columns) == set(df.columns) | set(S.ADDED)
    got = got.collect()
    assert sorted((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == want(rows, n)
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    for shard, slots in Counter(r["shard"] for r in got).items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(slots))


def test_hot_texts_are_cut_to_the_row(make_docs):
    rows = [(i, f"text {i} " + "x" * (i * 7 % 90)) for i in range(300)] + [(1000 + 3 * i, "the same text") for i in range(200)]
    check(make_docs(rows), rows)
    check(make_docs(rows), rows, n=3, max_share=8)


def test_far_apart_ids_and_one_text_only(make_docs):
    rows = [(i * (1 << 61) - (1 << 62) + j, "same") for i in range(4) for j in range(40)]
    check(make_docs(rows), rows, max_share=16)


def test_repeated_rows_and_edges(make_docs):
    rows = [(1, "a")] * 30 + [(2, None), (3, ""), (None, "é"), (None, None), (4, "z" * 100_000), (5, "a")]
    check(make_docs(rows), rows)
    rows = [(7, "copy")] * 50
    check(make_docs(rows), rows)


def test_columns_named_like_inner_ones_are_kept(spark):
    names = ["cell", "cell_id", "cell_row", "cell_bytes", "cell_rows", "cell_below", "cell_shard", "cell_slot", "first_id", "ids_each", "other_columns", "a.b"]
    rows = [(1000 + 3 * i, "the same text" if i % 4 else f"text {i}", *(f"{n} {i}" for n in names)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for max_share in (S.MAX_SHARE, 8):  # with few shares, the hot text is split by id
        got = S.shard_documents(df, 3, max_share=max_share)
        assert got.columns == [*df.columns, *S.ADDED]
        got = got.collect()
        assert sorted(tuple(r)[:len(df.columns)] for r in got) == sorted(rows)
        assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == want([r[:2] for r in rows], 3)


def test_empty_table(make_docs):
    assert S.shard_documents(make_docs([])).collect() == []


def test_no_python_in_the_plan(make_docs):
    plan = S.shard_documents(make_docs([(i, str(i)) for i in range(50)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

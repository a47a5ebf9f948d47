import pytest
from pyspark.sql import functions as F

from poolshift.operators import search as SE
from poolshift.operators.filters import search_rows
from poolshift.session import scratch_path


@pytest.fixture(scope="module")
def table(spark):
    n = F.col("id")
    df = spark.range(20_000).select(
        n.alias("row_ord"), F.concat(F.lit("svc."), n.cast("string")).alias("psm"),
        F.when(n % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("Größe "), (n % 7).cast("string"))).alias("note"),
        (n % 5).cast("double").alias("x"))
    path = scratch_path(spark, "t-search")
    SE.write_search_table(df, path, ["row_ord"], block_rows=16)
    return df, path


@pytest.mark.parametrize("text", ["svc.1234", "SVC 19999", "größe 6 .77", "7", "", "x y", "svc", "nowhere", "svc.5 nowhere",
                                  "12 34", "0.0", "vc.", "   ", "1.0 svc.100"])
def test_answer_is_that_of_a_plain_search(spark, table, text):
    df, path = table
    got = sorted(map(tuple, SE.search_table(spark, path, text).drop(SE.RANK).collect()))
    assert got == sorted(map(tuple, search_rows(df, text).collect()))


def test_a_rare_word_names_few_blocks(spark, table):
    _, path = table
    assert SE.candidate_blocks(spark, path, "svc.19777 0.0").count() <= 30
    blocks = {r["block"] for r in SE.candidate_blocks(spark, path, "svc.19777").collect()}
    assert 19777 // 16 in blocks and len(blocks) < 1250 / 10
    plan = SE.search_table(spark, path, "svc.19777")._jdf.queryExecution().toString()
    assert f"GreaterThanOrEqual({SE.RANK}," in plan.split("PushedFilters")[-1]
    assert SE.candidate_blocks(spark, path, "7 ab") is None


def test_many_blocks_are_joined_instead(spark, table, monkeypatch):
    df, path = table
    monkeypatch.setattr(SE, "NAMED_BLOCKS", 1)
    got = SE.search_table(spark, path, "svc.1999")
    assert "LeftSemi" in got._jdf.queryExecution().toString()
    assert sorted(r["psm"] for r in got.collect()) == sorted(r["psm"] for r in search_rows(df, "svc.1999").collect())


def test_bitmaps_of_more_than_one_bucket(spark):
    df = spark.range(70_000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("k"), "id")
    path = scratch_path(spark, "t-search")
    SE.write_search_table(df, path, ["id"], ["k"], block_rows=1)
    for i in (0, 1, 32767, 32768, 65535, 65536, 69999):
        word = f"k{i:06d}"
        assert i in {r["block"] for r in SE.candidate_blocks(spark, path, word).collect()}
        assert [r["id"] for r in SE.search_table(spark, path, word).collect()] == [i]


def test_empty_table_and_null_rows(spark):
    for rows in ([], [(None, None), ("abc", None)]):
        df = spark.createDataFrame(rows, "a string, b long")
        path = scratch_path(spark, "t-search")
        SE.write_search_table(df, path, ["a"])
        for text in ("abc", "zz", ""):
            assert SE.search_table(spark, path, text).count() == search_rows(df, text).count()


def test_runs_hold_every_block():
    blocks = [0, 1, 2, 9, 10, 40, 41, 90]
    assert SE._runs(blocks) == [(0, 2), (9, 10), (40, 41), (90, 90)]
    assert SE._runs(blocks, 2) == [(0, 41), (90, 90)]
    assert SE._runs([5], 1) == [(5, 5)]


def test_index_holds_no_trigram_across_columns(spark, table):
    df, path = table
    held = {r["gram"] for r in spark.read.parquet(f"{path}/grams").select("gram").distinct().collect()}
    assert held and not [g for g in held if " " in g]
    assert {"svc", "öße", ".12"} <= held


def test_rows_are_ranked_by_one_shuffle(spark):
    from poolshift.operators.results import write_pages
    df = spark.range(5_000).select(((F.col("id") * 37) % 5_000).alias("row_ord"), (F.col("id") % 3).alias("x"))
    path = scratch_path(spark, "t-ranks")
    write_pages(df, path, ["x"], tiebreak="row_ord")
    got = spark.read.parquet(path).orderBy("page_rank").collect()
    assert [r["page_rank"] for r in got] == list(range(5_000))
    assert [(r["x"], r["row_ord"]) for r in got] == sorted((r["x"], r["row_ord"]) for r in got)
    from poolshift.operators.results import ranked_rows
    import contextlib
    import io
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        ranked_rows(df, ["x"], tiebreak="row_ord").explain()
    assert "row_number" not in out.getvalue()

import pytest
from pyspark.sql import functions as F

from poolshift.functions import exprs as X


def one_col(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_number_coercion_null_to_zero(spark):
    vals = [" 12 ", "1e3", "nan", "", "n/a", "1,000", None, "+5", ".5", "12d", "-3.5"]
    got = one_col(spark, vals, X.number_or_zero)
    assert got == [12.0, 1000.0, 0.0, 0.0, 0.0, 0.0, 0.0, 5.0, 0.5, 0.0, -3.5]


def test_number_coercion_keeps_null(spark):
    got = one_col(spark, ["7", "x", None, "  "], X.coerce_number)
    assert got == [7.0, None, None, None]


def test_detail_truncates_summary_does_not(spark):
    assert one_col(spark, ["23.5", "-0.5", "bad"], X.count_or_zero) == [23, 0, 0]
    assert one_col(spark, ["23.5"], X.number_or_zero) == [23.5]


def test_pool_key_null_parts(spark):
    df = spark.createDataFrame([("A", "b"), (None, "default"), ("A", None)],
                               "physical_cluster string, iaas_cluster string")
    assert [r[0] for r in df.select(X.pool_key()).collect()] == ["A/b", "nan/default", "A/nan"]


@pytest.mark.parametrize("text,bare,expected", [
    ("A/b", "error", ("A", "b")),
    (" A / b ", "error", ("A", "b")),
    ("A", "default", ("A", "default")),
    ("A/b/c", "default", ("A/b/c", "default")),
    ("A", "any", ("A", None)),
    ("A/b/c", "any", ("A/b/c", None)),
])
def test_parse_pool_text(text, bare, expected):
    assert X.parse_pool_text(text, bare) == expected


@pytest.mark.parametrize("text", ["A", "A/b/c", ""])
def test_parse_pool_text_error(text):
    with pytest.raises(ValueError):
        X.parse_pool_text(text, "error")


def test_split_pool_column(spark):
    df = spark.createDataFrame([("A/b",), (" A / b ",), ("A",), ("A/b/c",)], "p string")
    ok, p, i = X.split_pool(F.col("p"))
    got = [tuple(r) for r in df.select(ok, p, i).collect()]
    assert got == [(True, "A", "b"), (True, "A", "b"), (False, None, None), (False, None, None)]


def test_business_line(spark):
    df = spark.createDataFrame([("D1", "/x/y/"), ("D1", "//z"), (None, None), ("D", "w")],
                               "dept_level1 string, dept_level2 string")
    got = [r[0] for r in df.select(X.business_line()).collect()]
    assert got == ["D1/x/y", "D1/z", "/", "D/w"]


def test_dash_if_blank(spark):
    assert one_col(spark, ["", None, "x", " "], X.dash_if_blank) == ["-", "-", "x", " "]


def test_split_list_and_size(spark):
    df = spark.createDataFrame([(" a, b ,,c ",), ("",), (None,)], "s string")
    got = [tuple(r) for r in df.select(X.split_list("s"), X.list_size("s")).collect()]
    assert got == [(["a", "b", "c"], 4), ([], 0), ([], 0)]  # blank items are not listed, but counted


def test_number_formats(spark):
    df = spark.createDataFrame([(999.0,), (1234.5,), (1250.0,), (2_500_000.0,), (12.25,)], "x double")
    got = [tuple(r) for r in df.select(X.short_number("x"), X.one_decimal("x"),
                                       F.format_number("x", 2)).collect()]
    assert got == [("999", "999.0", "999.00"), ("1.2K", "1234.5", "1,234.50"),
                   ("1.3K", "1250.0", "1,250.00"), ("2.5M", "2500000.0", "2,500,000.00"),
                   ("12.25", "12.3", "12.25")]


def test_one_line(spark):
    assert one_col(spark, ["a\nb", "c\r\nd"], X.one_line) == ["a b", "c d"]


def test_all_words_present(spark):
    df = spark.createDataFrame([("Alpha", "x1"), ("beta", "ALPHA"), ("gamma", None)], "a string, b string")
    got = [r[0] for r in df.filter(X.all_words_present(["a", "b"], "alpha")).select("a").collect()]
    assert sorted(got) == ["Alpha", "beta"]
    got = [r[0] for r in df.filter(X.all_words_present(["a", "b"], "beta alpha")).select("a").collect()]
    assert got == ["beta"]

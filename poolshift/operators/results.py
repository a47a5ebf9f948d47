"""Tools over any result table: paging, number formatting, row padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import one_decimal, short_number
from ..session import cut_lineage, shuffle_tasks

# Row groups of a table written for paging: small, as a page reads whole ones.
PAGE_GROUP_BYTES = 8 << 20


def page_rows(df: DataFrame, order_by: list[str], page: int = 0, size: int = 25,
              descending: bool = False, tiebreak: str | None = None) -> DataFrame:
    """Rows of page ``page`` (0-based) under a total order.

    The order is the chosen columns (nulls last) followed by ``tiebreak``
    (a unique column) so that pages neither overlap nor skip rows.
    """
    return df.orderBy(*_total_order(order_by, descending, tiebreak)).offset(page * size).limit(size)


def _total_order(order_by: list[str], descending: bool, tiebreak: str | None) -> list[Column]:
    keys = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last()
            for c in order_by]
    if tiebreak:
        keys.append(F.col(tiebreak).asc_nulls_last())
    return keys


def ranked_rows(df: DataFrame, order_by: list[str], descending: bool = False,
                tiebreak: str | None = None, rank: str = "page_rank") -> DataFrame:
    """``df`` with each row's place in the total order (from 0).

    Order statistics: rows are dealt by ranges of the order and sorted in
    them, the ranges are counted, and a row's place is the rows of the ranges
    before its own plus its place inside, so no task sees more than its range
    and rows are shuffled once. The result is in rank order inside each range,
    and a range is a task's. Rows that are
    equal in the whole order are placed among each other in any way; without
    a unique ``tiebreak`` they should be few, as they share a range.
    """
    spark = df.sparkSession
    keys = _total_order(order_by, descending, tiebreak)
    # the increasing id holds the range above 33 bits, the place inside below
    sorted_ranges = df.repartitionByRange(shuffle_tasks(spark), *keys).sortWithinPartitions(*keys)
    ranged = cut_lineage(sorted_ranges.withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    front = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for a range
    before = (ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
              .select("_range", F.coalesce(F.sum("_rows").over(front), F.lit(0)).alias("_before")))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (ranged.join(F.broadcast(before), "_range")
            .withColumn(rank, (F.col("_before") + place).cast("bigint")).drop("_at", "_range", "_before"))


def write_pages(df: DataFrame, path: str, order_by: list[str], descending: bool = False,
                tiebreak: str | None = None, rank: str = "page_rank") -> None:
    """Write ``df`` with its ranks, in rank order inside each file, so that a
    page is found by the statistics of files, row groups and their pages."""
    (ranked_rows(df, order_by, descending, tiebreak, rank)
     .write.option("parquet.block.size", PAGE_GROUP_BYTES).parquet(path))


def read_page(spark: SparkSession, path: str, page: int, size: int = 25, rank: str = "page_rank") -> DataFrame:
    """Page ``page`` (from 0) of a table written by :func:`write_pages`: a
    pushed-down test on the rank, whatever the page; no sort of the table, no offset."""
    at = F.col(rank)
    return spark.read.parquet(path).filter((at >= page * size) & (at < (page + 1) * size))


def format_numbers(df: DataFrame, columns: list[str], decimals: int = 2) -> DataFrame:
    """Three display forms per numeric column: grouped with ``decimals``
    places (``1,234.50``), abbreviated (``1.2K``, ``3.4M``) and ``%.1f``."""
    out = [F.col(c) for c in df.columns]
    for c in columns:
        out += [F.format_number(F.col(c).cast("double"), decimals).alias(f"{c}_fmt"),
                short_number(c).alias(f"{c}_short"),
                one_decimal(c).alias(f"{c}_1f")]
    return df.select(*out)


def pad_rows(df: DataFrame, empty_rows: int = 1, order_col: str = "row_ord",
             ordered: bool = False) -> DataFrame:
    """After every row insert ``empty_rows`` rows whose columns are all null.

    Each input row becomes ``empty_rows + 1`` rows via ``explode(sequence)``,
    a narrow operation (no shuffle). ``pad_index`` 0 is the original row;
    the output order is ``(order_col, pad_index)``, applied with ``ordered``
    (a range-partitioned sort, so written part files follow it).
    """
    if empty_rows < 0:
        raise ValueError("empty_rows must be >= 0")
    i = F.col("pad_index")
    exploded = df.withColumn("pad_index", F.explode(F.sequence(F.lit(0), F.lit(empty_rows))))
    cols = [F.when(i == 0, F.col(c)).alias(c) for c in df.columns if c != order_col]
    out = exploded.select(F.col(order_col), i, *cols)
    return out.orderBy(order_col, "pad_index") if ordered else out

"""Ranks and running sums in an order within groups, no group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import written


def laid_out(rows: DataFrame, group: str, order: list[str], sizes: str | None = None) -> DataFrame:
    """``rows`` with ``rank`` (from 0, long) in the order ``order`` within
    their ``group`` (nulls are a group, nulls come first), ``n`` (rows of the
    group) and, where ``sizes`` names a column of longs, ``before`` (its sum
    over the rows in front) and ``total`` (its sum over the group).

    The rows are dealt by ranges of (group, order) and written, so a group is
    spread over as many tasks as its share of the rows asks for; sums of each
    (group, range) are added up and handed to the rows of that range. Rows
    equal in all of ``order`` are spread too, their order among each other is
    free. The names ``part_``, ``spread_``, ``rank``, ``n``, ``before`` and
    ``total`` must not be among the columns.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (rows.withColumn("spread_", F.rand(7)).repartitionByRange(tasks, group, *order, "spread_")
              .drop("spread_").withColumn("part_", F.spark_partition_id()))
    placed = written(placed, "ranks")
    size = F.col(sizes) if sizes else F.lit(0).cast("long")
    parts = placed.groupBy(F.col(group).alias("group_"), F.col("part_").alias("of_")).agg(F.count(F.lit(1)).alias("rows_"), F.sum(size).alias("sum_"))
    whole = Window.partitionBy("group_")
    front = whole.orderBy("of_").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    parts = parts.select("group_", "of_", F.coalesce(F.sum("rows_").over(front), none).alias("rows_"),
                         F.coalesce(F.sum("sum_").over(front), none).alias("sum_"),
                         F.sum("rows_").over(whole).alias("n"), F.sum("sum_").over(whole).alias("total"))
    inside = Window.partitionBy(group, "part_").orderBy(*order)
    out = (placed.join(parts, F.col(group).eqNullSafe(F.col("group_")) & (F.col("part_") == F.col("of_")))
           .withColumn("rank", F.col("rows_") + F.row_number().over(inside) - 1)
           .withColumn("before", F.col("sum_") + F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - size)
           .drop("group_", "of_", "part_", "rows_", "sum_"))
    return out if sizes else out.drop("before", "total")

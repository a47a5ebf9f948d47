"""Plan shape: no Python in the hot path, no cartesian products, filters at
the scan, and the expected number of shuffles."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from poolshift.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_udf_no_cartesian(spark, key):
    p = plan(E.queries()[key](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct",
                "BroadcastNestedLoopJoin"):
        assert bad not in p, f"{key}: {bad}"


def test_site_filter_prunes_partitions_and_pool_filter_reaches_scan(spark):
    p = plan(E.queries()["migration_detail"](spark, SF))
    assert "PartitionFilters: [idc" in p and "IN (BUILDING,MACHINERY)]" in p
    assert "In(physical_cluster, [ASIA,EUROPE])" in p
    assert "EqualTo(cluster_name,default)" in p and "EqualTo(iaas_cluster,default)" in p


def test_fixture_derivation_pushes_site_filter(spark):
    from poolshift.operators.migration import migration
    from poolshift.sources.inventory import inventory
    m = migration(inventory(spark, SF, materialize=False), "EUROPE/default", "ASIA/default",
                  ["BUILDING", "MACHINERY"], package=True)
    assert "PushedFilters: [In(c_mktsegment, [BUILDING,MACHINERY])" in plan(m.detail)


def test_scan_reads_only_needed_columns(spark):
    p = plan(E.queries()["pool_key"](spark, SF))
    # the pool count reads the two pool columns only
    assert "ReadSchema: struct<physical_cluster:string,iaas_cluster:string>" in p
    from poolshift.sources.inventory import inventory
    p = plan(inventory(spark, SF, materialize=False).select("physical_cluster"))
    li = [line for line in p.splitlines() if line.startswith("ReadSchema: struct<l_orderkey")]
    assert li and all("l_extendedprice" not in s and "l_shipdate" not in s for s in li)


def test_migratable_has_no_join_on_service(spark):
    p = plan(E.queries()["migratable_services"](spark, SF))
    assert p.count("hashpartitioning(psm") == 2  # two aggregation levels, no join


def test_join_back_is_salted_and_summary_pre_aggregates(spark):
    p = plan(E.queries()["migration_summary"](spark, SF))
    assert "_salt" in p and "xxhash64(row_ord" in p
    # the summary aggregate is partial before its own exchange
    assert "partial_sum" in p


def test_per_candidate_top_rows_limited_before_shuffle(spark):
    p = plan(E.queries()["candidate_detail_top"](spark, SF))
    assert "WindowGroupLimit" in p


@pytest.mark.parametrize("key", ["migration_detail", "migration_summary", "migration_batch",
                                 "candidate_detail"])
def test_salting_keeps_results(spark, key):
    q = E.queries()[key]
    srt = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    base = srt(q(spark, SF).collect())
    spark.conf.set("poolshift.skew.rowsPerTask", "2")
    try:
        salted = srt(q(spark, SF).collect())
    finally:
        spark.conf.unset("poolshift.skew.rowsPerTask")
    assert salted == base


def test_hot_service_rows_spread_over_tasks(spark):
    """A service holding a third of the rows is split across tasks in the join back."""
    from pyspark.sql import functions as F
    from poolshift.operators.skew import join_per_key
    rows = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id").cast("string")))
        .alias("psm"), F.col("id").alias("row_ord"))
    per_key = rows.groupBy("psm").agg(F.count(F.lit(1)).alias("_rows"), F.max("row_ord").alias("m"))
    joined = join_per_key(rows, per_key, ["psm"], "_rows", rows_per_task=100)
    hot_parts = (joined.filter(F.col("psm") == "hot")
                 .select(F.spark_partition_id().alias("p")).distinct().count())
    assert joined.count() == 3000
    assert hot_parts > 1


def test_derivation_deals_lines_by_order_key_once(spark):
    from poolshift.sources.inventory import inventory_from_tables
    p = plan(inventory_from_tables(spark, SF))
    dealt = [s for s in p.splitlines() if s.startswith("Arguments: hashpartitioning(l_")]
    # once for the place in the line and the join with orders (parts and suppliers of this size are broadcast)
    assert len(dealt) == 1 and dealt[0].startswith("Arguments: hashpartitioning(l_orderkey#") and "l_linenumber" not in dealt[0]


def test_shuffles_begin_with_the_partitions_that_the_rows_need(spark):
    from poolshift.session import INITIAL_PARTITIONS, ROWS_PER_SHUFFLE_TASK, shuffle_tasks, size_shuffles
    fixed = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        size_shuffles(spark, fixed * ROWS_PER_SHUFFLE_TASK)
        assert shuffle_tasks(spark) == fixed and spark.conf.get(INITIAL_PARTITIONS, None) is None
        size_shuffles(spark, 50 * ROWS_PER_SHUFFLE_TASK + 1)
        assert shuffle_tasks(spark) == 51
        size_shuffles(spark, 1)  # never lowered
        assert shuffle_tasks(spark) == 51
    finally:
        spark.conf.unset(INITIAL_PARTITIONS)


def test_exports_are_compressed(spark):
    import os

    from poolshift.plans.catalog import _export
    for fmt in ("csv", "json"):
        names = [n for n in os.listdir(_export(spark, SF, fmt, ["psm", "idc"])) if n.startswith("part-")]
        assert names and all(n.endswith(f".{fmt}.gz") for n in names)

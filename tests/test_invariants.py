"""Invariants from the test strategy, on the sf0.001 test tables."""

import pytest
from pyspark.sql import functions as F

from poolshift.operators import batch as B
from poolshift.operators import candidates as C
from poolshift.operators import migration as M1
from poolshift.operators import results as R
from poolshift.sources.inventory import inventory

SF = "/root/testdata/sf0.001"
P1, P2, SITES = "EUROPE/default", "ASIA/default", ["BUILDING", "MACHINERY"]


@pytest.fixture(scope="module")
def inv(spark):
    return inventory(spark, SF)


@pytest.fixture(scope="module")
def mig(inv):
    return M1.migration(inv, P1, P2, SITES, package=True, ordered=False)


def test_detail_services_are_the_intersection(inv, mig):
    rows = inv.filter(F.col("idc").isin(SITES) & (F.col("cluster_name") == "default"))
    key = F.concat_ws("/", "physical_cluster", "iaas_cluster")
    a = {r[0] for r in rows.filter(key == P1).select("psm").distinct().collect()}
    b = {r[0] for r in rows.filter(key == P2).select("psm").distinct().collect()}
    assert {r[0] for r in mig.detail.select("psm").distinct().collect()} == a & b


def test_every_matched_service_has_both_roles(mig):
    roles = (M1.with_role(mig.detail, P1, P2).groupBy("psm")
             .agg(F.collect_set("role").alias("r")).collect())
    assert roles and all(sorted(r["r"]) == ["lender", "receiver"] for r in roles)


def test_summary_totals_equal_coerced_detail_without_null_packages(inv, spark):
    m = M1.migration(inv, P1, P2, SITES, package=False, ordered=False)
    s = m.summary.agg(F.sum("instance_num"), F.sum("cpu_limit"), F.sum("mem_limit")).first()
    st = m.stats.first()
    assert (s[0], s[1], s[2]) == (st["total_instances"], st["total_cpu"], st["total_memory"])


def test_candidate_count_equals_single_migration(inv, mig):
    cmp = C.compare_candidates(inv, P1, [P2, "AFRICA/gpu"], SITES)
    ov = {r["candidate_pool"]: r["matching_psm_count"] for r in cmp.overview.collect()}
    assert ov[P2] == mig.stats.first()["psm_count"] == 19
    single = M1.migration(inv, P1, "AFRICA/gpu", SITES, package=True)
    assert ov["AFRICA/gpu"] == single.stats.first()["psm_count"]


def test_batch_of_one_equals_single_call(inv, mig, spark):
    req = spark.createDataFrame([("r", ",".join(SITES), P1, P2)],
                                "request_id string, idc string, pool1 string, pool2 string")
    b = B.migration_batch(inv, req)
    assert sorted((tuple(r) for r in b.detail.drop("request_id").collect()), key=repr) == \
        sorted((tuple(r) for r in mig.detail.collect()), key=repr)


def test_padding_length(inv):
    rows = inv.filter(F.col("physical_cluster") == "EUROPE").select("row_ord", "psm")
    n = rows.count()
    for k in (0, 1, 3):
        assert R.pad_rows(rows, k).count() == (k + 1) * n


def test_row_ord_is_a_unique_bigint_in_line_order(inv):
    assert dict(inv.dtypes)["row_ord"] == "bigint"
    assert inv.select("row_ord").distinct().count() == inv.count()

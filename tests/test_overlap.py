"""Pools compared by bitmaps of service numbers."""

from poolshift.operators import batch as B
from poolshift.operators import overlap as OV

from .helpers import make_inventory


def test_dense_ids_number_distinct_values_in_order(spark):
    values = [f"s{i:03}" for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values * 3] + [(None,)], "psm string")
    got = sorted((r.id, r.psm) for r in OV.dense_ids(df, "psm").collect())
    assert got == [(i + 1, v) for i, v in enumerate(values)]
    assert OV.dense_ids(df.limit(0), "psm").collect() == []


def test_counts_and_shared_services_equal_sets(spark):
    rows = [{"psm": f"s{i % 13}" if i % 17 else None, "physical_cluster": ["A", "B", None][i % 3], "iaas_cluster": ["default", "gpu"][i % 2],
             "idc": ["S1", "S2", "S3"][i // 3 % 3], "cluster_name": "other" if i % 19 == 0 else "default"} for i in range(90)]
    inv = make_inventory(spark, rows)
    asked = [("q1", "A/default", "B/gpu", "S1,S2"), ("q2", "A/gpu", "nan/default", ""), ("q3", "B/default", "Z/none", "S3"), ("q4", "A/default", "B/gpu", "S2,S1")]
    requests = spark.createDataFrame([(i, s, a, b) for i, a, b, s in asked], "request_id string, idc string, pool1 string, pool2 string")
    # numbers far apart: several blocks
    ids = OV.dense_ids(inv, "psm").selectExpr("psm", "id * 20000 as id")
    classes, members = B.request_classes(B.asked_pools(requests))
    blocks = OV.class_bitmaps(OV.pool_bitmaps(inv, ids), classes)
    counts = {r.request_id: r for r in OV.class_counts(blocks).collect()}
    shared = {}
    for r in OV.shared_services(blocks, ids).collect():
        shared.setdefault(r.request_id, set()).add(r.psm)
    class_of = {r.request_id: r.class_id for r in members.collect()}
    assert class_of["q1"] == class_of["q4"] and len(set(class_of.values())) == 3
    for i, lender, receiver, sites in asked:
        def services(pool):
            return {r["psm"] for r in rows if r["psm"] and r["cluster_name"] == "default" and (not sites or r["idc"] in sites.split(","))
                    and f"{r['physical_cluster'] or 'nan'}/{r['iaas_cluster']}" == pool}  # noqa: B023
        a, b, r = services(lender), services(receiver), counts[class_of[i]]
        assert (r.target_psm_count, r.psm_count, r.matching_psm_count) == (len(a), len(b), len(a & b))
        assert shared.get(class_of[i], set()) == a & b

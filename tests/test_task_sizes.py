"""What a task holds, and what is shuffled, must not grow with the input or the number of requests."""

import json
import re

from poolshift.operators import batch as B
from poolshift.operators import candidates as C
from poolshift.operators import migratable as M3
from poolshift.operators import overlap as OV
from poolshift.operators.skew import join_per_key
from poolshift.session import ADVISORY, SPLIT, TASK_BYTES, bound_tasks, size_in_bytes
from poolshift.sources.requests import BODIES_PER_TASK, mixed_bodies

from .helpers import make_inventory


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _inventory(spark):
    return make_inventory(spark, [{"psm": f"s{i}", "physical_cluster": c, "idc": s, "instance_num": str(i)}
                                  for i in range(6) for c in "AB" for s in ("S1", "S2")])


def _requests(spark):
    bodies = [{"request_id": f"q{i}", "idc": s, "pool1": "A/default", "pool2": "B/default", "pool": "A/default",
               "target_pool": "A/default", "candidate_pools": "B/default"} for i, s in enumerate(["S1", "S1", "", "S9"])]
    return B.parse_requests(spark.createDataFrame([(json.dumps(b),) for b in bodies], "body string"))


def test_tasks_are_bounded_and_never_enlarged(spark):
    before = {k: spark.conf.get(k) for k in TASK_BYTES}
    try:
        bound_tasks(spark)
        assert {k: size_in_bytes(spark.conf.get(k)) for k in TASK_BYTES} == TASK_BYTES
        spark.conf.set(ADVISORY, "1m")
        spark.conf.set(SPLIT, "2MB")
        bound_tasks(spark)
        assert (spark.conf.get(ADVISORY), spark.conf.get(SPLIT)) == ("1m", "2MB")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_are_not_dealt_by_pool(spark):
    """The pools asked for are few: dealing rows by them puts a pool into one task."""
    classes, _ = B.request_classes(B.asked_pools(_requests(spark)))
    plan = _plan(B.pool_profile(_inventory(spark), B.pool_parts(classes)))
    assert not re.search(r"hashpartitioning\(req_physical#\d+, req_iaas#\d+, \d+\)", plan)


def test_rows_are_shuffled_before_they_are_handed_to_classes(spark):
    detail = B.migration_batch(_inventory(spark), _requests(spark)).detail
    assert "hashpartitioning(request_id" not in _plan(detail)
    assert sorted({(r["request_id"], r["idc"]) for r in detail.collect()}) == [
        ("q0", "S1"), ("q1", "S1"), ("q2", "S1"), ("q2", "S2")]


def test_hot_keys_split_with_several_rows_a_key(spark):
    rows = spark.createDataFrame([("s", "A", i) for i in range(50)] + [("s", "B", 50), ("t", "A", 51)],
                                 "psm string, pool string, row_ord long")
    per_key = spark.createDataFrame([("s", "A", "q1", 51), ("s", "A", "q2", 50), ("s", "B", "q1", 51), ("t", "A", "q2", 1)],
                                    "psm string, pool string, request_id string, n long")
    got = join_per_key(rows, per_key, ["pool", "psm"], "n", rows_per_task=7, hot_by=["psm"])
    want = rows.join(per_key, ["pool", "psm"])
    columns = sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_bodies_are_read_once_and_in_several_tasks(spark, tmp_path):
    n = 2 * BODIES_PER_TASK + 1
    spark.range(n).selectExpr("id as c_custkey", "cast(id % 2 as int) as c_nationkey", "'BUILDING' as c_mktsegment") \
        .coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(0, "ASIA"), (1, "EAST ASIA"), (2, "EUROPE")], "r_regionkey int, r_name string") \
        .write.parquet(str(tmp_path / "region.parquet"))
    bodies = mixed_bodies(spark, str(tmp_path))
    assert bodies.count() == n == bodies.select("c_custkey").distinct().count()
    assert "REPARTITION_BY_NUM" in _plan(bodies)
    cands, classes = C.candidate_questions(B.parse_requests(bodies))
    assert cands.count() > 0
    for df in (cands, classes):
        assert "parse_json" not in _plan(df) and "customer" not in _plan(df)


def test_bitmaps_are_built_in_one_task_each(spark):
    inv = _inventory(spark)
    plan = _plan(OV.pool_bitmaps(inv, OV.dense_ids(inv, "psm")))
    last, first = plan.index("functions=[bitmap_construct_agg"), plan.index("functions=[partial_bitmap_construct_agg")
    assert "Exchange" not in plan[last:first]


def test_migratable_batch_shuffles_nothing_for_a_request(spark):
    out = M3.migratable_flat(M3.migratable_batch(_inventory(spark), _requests(spark)))
    assert "hashpartitioning(request_id" not in _plan(out)
    got = sorted((r["request_id"], r["psm"], r["other_pools"], r["other_pool_cluster_count"]) for r in out.collect())
    assert got == sorted([(f"q{q}", f"s{i}", "B/default", n) for q, n in ((0, 1), (1, 1), (2, 2)) for i in range(6)])

"""Typed request bodies, and requests answered by classes."""

import json

import pytest

from poolshift.operators import batch as B
from poolshift.operators import candidates as C

from .helpers import make_inventory


@pytest.fixture(scope="module")
def bodies(spark):
    return lambda values: spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, body string")


def read(bodies, values):
    out = B.parse_requests(bodies(values), keep=["n"])
    assert out.columns == ["n", *B.REQUEST_SCHEMA.names, "sites", "candidates", "faults"]
    return sorted(out.collect())


def test_text_and_list_give_the_same_items(bodies):
    text = {"request_id": "a", "idc": " MY, SH ", "target_pool": "P/d", "candidate_pools": "Q/d,R/d"}
    as_list = text | {"idc": ["MY", " SH", None], "candidate_pools": ["Q/d", "R/d"]}
    one, two = read(bodies, [json.dumps(text), json.dumps(as_list)])
    assert one.sites == two.sites == ["MY", "SH"]
    assert one.candidates == two.candidates == ["Q/d", "R/d"]
    assert (one.idc, two.idc) == (" MY, SH ", "MY,SH")
    assert one.faults == two.faults == []


def test_every_fault_is_named(bodies):
    rows = read(bodies, [None, "", "{cut", "[1]", "7", "{}", '{"request_id": " "}', '{"request_id": null, "idc": ""}', '{"request_id": 12, "min_save_cores": 5.5}',
                         '{"request_id": "x", "idc": {"a": 1}, "pool1": ["A/d"], "candidate_pools": ["A/d", 1]}', '{"request_id": true}',
                         '{"request_id": "y", "idc": [], "candidate_pools": null, "other": [[1]]}', '{"request_id": "z", "idc": [["MY"]]}'])
    lists = "is neither text nor a list of texts"
    assert [r.faults for r in rows] == [
        [B.UNREADABLE], [B.UNREADABLE], [B.UNREADABLE], [B.NO_OBJECT], [B.NO_OBJECT], [B.NO_ID], [B.NO_ID], [B.NO_ID], [],
        [f"idc {lists}", "pool1 is not text", f"candidate_pools {lists}"], ["request_id is not text"], [], [f"idc {lists}"]]
    assert (rows[8].request_id, rows[8].min_save_cores) == ("12", "5.5")
    assert rows[9].idc is None and rows[9].pool1 is None and rows[9].candidates == []
    assert rows[11].sites == [] and rows[11].candidates == []


def test_a_list_item_may_hold_a_comma(bodies):
    assert read(bodies, ['{"request_id": "a", "idc": ["MY,1", "SH"]}'])[0].sites == ["MY,1", "SH"]


def test_errors_are_told_apart(bodies):
    req = B.parse_requests(bodies([
        None, '{"request_id": "a", "pool1": "A/d", "pool2": "B/d", "idc": ["S1"]}', '{"request_id": "b", "pool1": 3, "pool2": "B/d"}',
        '{"pool1": "A/d", "pool2": "B/d"}', "oops", '{"request_id": "c", "pool1": "A/d"}', '{"request_id": "c", "pool1": "A/d", "pool2": "B/d"}']))
    got = sorted((r.request_id or "", sorted(r.errors), r.valid) for r in B.validate_requests(req).collect())
    assert got == sorted([("", [B.UNREADABLE], False), ("", [B.UNREADABLE], False), ("", [B.NO_ID], False), ("a", [], True), ("b", ["pool1 is not text"], False),
                          ("c", ["missing pool", "repeated request_id"], False), ("c", ["repeated request_id"], False)])


def test_no_bodies(spark, bodies):
    assert B.parse_requests(spark.createDataFrame([], "body string")).collect() == []


def inventory(spark):
    return make_inventory(spark, [{"psm": f"s{i % 7}" if i % 11 else None, "physical_cluster": "ABC"[i % 3], "iaas_cluster": ["default", "gpu"][i % 2],
                                   "idc": ["S1", "S2", "S3"][i // 3 % 3], "instance_num": str(i), "package": ["", "p", None][i % 3]} for i in range(120)])


def test_list_bodies_are_answered_like_text(spark, bodies):
    inv = inventory(spark)
    text = {"request_id": "t", "idc": "S1, S3", "pool1": "A/default", "pool2": "B/gpu", "target_pool": "A/default", "candidate_pools": "B/gpu,C/default"}
    listed = text | {"request_id": "l", "idc": ["S3", "S1", "S1"], "candidate_pools": ["B/gpu", "C / default"]}
    req = B.parse_requests(bodies([json.dumps(text), json.dumps(listed), '{"request_id": "w", "idc": 4, "pool1": "A/default", "pool2": "B/gpu"}']))
    batch = B.migration_batch(inv, req)
    for rows in (batch.detail, batch.summary, C.candidate_batch(inv, req)):
        found = {"t": [], "l": []}
        for r in rows.collect():
            found[r.request_id].append(tuple(r)[1:])
        assert found["t"] and sorted(found["t"], key=repr) == sorted(found["l"], key=repr)


@pytest.mark.parametrize("rank_by", ["last", "sum", "max"])
def test_repeated_questions_are_evaluated_once(spark, rank_by):
    inv = inventory(spark)
    asked = [("S1,S2", "A/default", "B/gpu"), ("", "A/default", "B/gpu"), ("S2", "C/gpu", "A/gpu"), ("S2,S1,S2", "A/default", "B/gpu")]
    schema = "request_id string, idc string, pool1 string, pool2 string"
    once = spark.createDataFrame([(f"q{i}", *a) for i, a in enumerate(asked)], schema)
    many = spark.createDataFrame([(f"q{i}.{j}", *a) for i, a in enumerate(asked) for j in range(100)], schema)
    for requests, members in ((once, 4), (many, 400)):
        classes, given = B.request_classes(B.asked_pools(requests))
        assert (classes.count(), given.count()) == (3, members)
        # what the first aggregation reads and makes does not know the requests
        assert B.pool_profile(inv, B.pool_parts(classes), rank_by).count() == B.pool_profile(inv, B.request_pools(once), rank_by).count()
    few, lots = (B.migration_batch(inv, r, rank_by=rank_by) for r in (once, many))
    for name in ("detail", "summary", "services"):
        want = sorted((tuple(r) for r in getattr(few, name).collect()), key=repr)
        got = getattr(lots, name).collect()
        assert len(got) == 100 * len(want)
        assert sorted(((r.request_id.split(".")[0], *tuple(r)[1:]) for r in got if r.request_id.endswith(".7")), key=repr) == want


def test_profile_is_aggregated_before_requests_are_joined(spark):
    inv = inventory(spark)
    req = spark.createDataFrame([("q", "", "A/default", "B/gpu")], "request_id string, idc string, pool1 string, pool2 string")
    classes, _ = B.request_classes(B.asked_pools(req))
    plan = B.class_services(inv, classes)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    first_join = next(i for i, x in enumerate(lines) if "Join Inner" in x)
    assert any("Aggregate [req_physical" in x for x in lines[first_join:])
    assert not any("Join Inner" in x for x in lines[next(i for i, x in enumerate(lines) if "Aggregate [req_physical" in x):])

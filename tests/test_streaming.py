import json
import os
import tempfile

from poolshift.operators.batch import migration_batch
from poolshift.streaming.requests import answer_requests, read_answers

from .helpers import make_inventory


def test_stream_answers_each_file_once(spark):
    inv = make_inventory(spark, [
        {"psm": "s", "physical_cluster": "A", "instance_num": "3"},
        {"psm": "s", "physical_cluster": "B"},
        {"psm": "t", "physical_cluster": "A"},
    ])
    root = tempfile.mkdtemp(prefix="poolshift-stream-")
    src, sink, ckpt = (os.path.join(root, d) for d in ("in", "out", "ckpt"))
    os.makedirs(src)
    reqs = [{"request_id": "q1", "pool1": "A/default", "pool2": "B/default"},
            {"request_id": "q2", "pool1": "A/default", "pool2": "A/default"},
            {"request_id": "q3", "pool1": "B/default", "pool2": "A/default", "idc": "S9"}]
    for i, r in enumerate(reqs):
        with open(os.path.join(src, f"r{i}.json"), "w") as f:
            f.write(json.dumps(r) + "\n")
    answer_requests(spark, lambda: inv, src, sink, ckpt).awaitTermination()
    # a second run with the same checkpoint finds nothing new: no duplicates
    answer_requests(spark, lambda: inv, src, sink, ckpt).awaitTermination()
    detail = read_answers(spark, sink, "detail")
    got = sorted((r["request_id"], r["pool_identifier"]) for r in detail.collect())
    assert got == [("q1", "A/default"), ("q1", "B/default")]
    checked = {r["request_id"]: r["valid"] for r in read_answers(spark, sink, "requests").collect()}
    assert checked == {"q1": True, "q2": False, "q3": True}
    batch = migration_batch(inv, spark.createDataFrame(
        [("q1", None, "A/default", "B/default")],
        "request_id string, idc string, pool1 string, pool2 string"))
    assert sorted(tuple(r) for r in batch.detail.collect()) == \
        sorted(tuple(r) for r in detail.drop("batch_id").collect())


def test_stream_answers_all_request_kinds(spark):
    inv = make_inventory(spark, [
        {"psm": "s", "physical_cluster": "A", "instance_num": "3", "save_cores": "4"},
        {"psm": "s", "physical_cluster": "B", "save_cores": "1"},
        {"psm": "t", "physical_cluster": "A", "save_cores": "x"},
    ])
    root = tempfile.mkdtemp(prefix="poolshift-stream-")
    src, sink = os.path.join(root, "in"), os.path.join(root, "out")
    os.makedirs(src)
    reqs = [{"request_id": "m1", "pool1": "A/default", "pool2": "B/default"},
            {"request_id": "p1", "idc": "S1", "pool": "A/default", "min_save_cores": "0"},
            {"request_id": "p2", "pool": "A/default"}]
    with open(os.path.join(src, "r.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in reqs) + "\n")
    answer_requests(spark, lambda: inv, src, sink).awaitTermination()
    rec = sorted((r["request_id"], r["psm"], r["save_cores"])
                 for r in read_answers(spark, sink, "recommend").collect())
    assert rec == [("p1", "s", 4)]
    mig = sorted((r["request_id"], r["psm"], r["other_pools"])
                 for r in read_answers(spark, sink, "migratable").collect())
    assert mig == [("p1", "s", ["B/default"]), ("p1", "t", [])]
    bad = {r["request_id"]: r["valid"] for r in read_answers(spark, sink, "requests_scale_down").collect()}
    assert bad == {"p1": True, "p2": False}
    assert {r["request_id"] for r in read_answers(spark, sink, "detail").collect()} == {"m1"}

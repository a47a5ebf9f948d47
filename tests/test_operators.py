"""Hand-made cases for each analysis (FIXTURES §6) and cross-analysis invariants."""

from pyspark.sql import functions as F

from poolshift.operators import batch as B
from poolshift.operators import candidates as C
from poolshift.operators import migratable as M3
from poolshift.operators import migration as M1
from poolshift.operators import results as R
from poolshift.operators import scaling as M2
from poolshift.operators import filters as FL

from .helpers import make_inventory


def test_last_lender_row_wins(spark):
    inv = make_inventory(spark, [
        {"psm": "s", "physical_cluster": "A", "instance_num": "5"},
        {"psm": "s", "physical_cluster": "A", "instance_num": "2"},
        {"psm": "s", "physical_cluster": "B", "instance_num": "9"},
    ])
    m = M1.migration(inv, "A/default", "B/default")
    assert {r["sort_key"] for r in m.detail.collect()} == {2}
    assert M1.lender_rank(M1.pool_rows(inv, [("A", "default"), ("B", "default")]),
                          "A/default", "B/default", rank_by="sum").first()["sort_key"] == 7
    assert M1.lender_rank(M1.pool_rows(inv, [("A", "default"), ("B", "default")]),
                          "A/default", "B/default", rank_by="max").first()["sort_key"] == 5


def test_null_package_row_in_detail_not_in_summary(spark):
    inv = make_inventory(spark, [
        {"psm": "s", "physical_cluster": "A", "package": "p"},
        {"psm": "s", "physical_cluster": "A", "package": None},
        {"psm": "s", "physical_cluster": "B", "package": ""},
    ])
    m = M1.migration(inv, "A/default", "B/default")
    assert m.package is True
    assert m.detail.count() == 3
    keys = sorted((r["pool_identifier"], r["package"]) for r in m.summary.collect())
    assert keys == [("A/default", "p"), ("B/default", "")]


def test_package_gate_off_when_all_blank(spark):
    inv = make_inventory(spark, [
        {"psm": "s", "physical_cluster": "A", "package": None},
        {"psm": "s", "physical_cluster": "B", "package": ""},
    ])
    m = M1.migration(inv, "A/default", "B/default")
    assert m.package is False
    assert "package" not in m.detail.columns
    assert m.summary.count() == 2


def test_detail_truncates_summary_sums(spark):
    inv = make_inventory(spark, [
        {"psm": "s", "physical_cluster": "A", "instance_num": "23.5"},
        {"psm": "s", "physical_cluster": "B", "instance_num": "bad"},
    ])
    m = M1.migration(inv, "A/default", "B/default")
    assert sorted(r["instance_num"] for r in m.detail.collect()) == [0, 23]
    assert sorted(r["instance_num"] for r in m.summary.collect()) == [0.0, 23.5]


def test_same_pool_twice_degenerates(spark):
    inv = make_inventory(spark, [{"psm": "s", "physical_cluster": "A"},
                                 {"psm": "t", "physical_cluster": "B"}])
    m = M1.migration(inv, "A/default", "A/default")
    assert [r["psm"] for r in m.detail.collect()] == ["s"]


def test_migration_pool_format_error(spark):
    inv = make_inventory(spark, [{"psm": "s", "physical_cluster": "A"}])
    import pytest
    with pytest.raises(ValueError):
        M1.migration(inv, "A", "B/default")


def test_save_cores_chain(spark):
    vals = ["0.9", "-0.5", "nan", "", " 3 ", None, "7.6"]
    inv = make_inventory(spark, [{"psm": f"s{i}", "physical_cluster": "A", "save_cores": v}
                                 for i, v in enumerate(vals)])
    got = {r["psm"]: r["save_cores"] for r in M2.recommend_scale_down(inv, None, "A", 0).collect()}
    assert got == {"s0": 0, "s1": 0, "s4": 3, "s6": 7}


def test_save_cores_derived_when_absent(spark):
    inv = make_inventory(spark, [{"psm": "s", "physical_cluster": "A", "cpu_limit": "10",
                                  "cpu_request": "2.5"}], drop=("save_cores",))
    assert M2.recommend_scale_down(inv, None, "A/default").first()["save_cores"] == 7


def test_recommend_stats_and_display(spark):
    inv = make_inventory(spark, [
        {"psm": "a", "physical_cluster": "A", "save_cores": "12", "package": ""},
        {"psm": "b", "physical_cluster": "A", "save_cores": "3", "cluster_id": None},
    ])
    rec = M2.recommend_scale_down(inv, "", "A/default")
    st = M2.recommend_stats(rec).first()
    assert (st["total_cpu"], st["total_clusters"], st["clusters_over_10"]) == (15, 2, 1)
    disp = {r["psm"]: r for r in M2.recommend_display(rec).collect()}
    assert disp["a"]["package"] == "-" and disp["a"]["priority"] is True
    assert disp["b"]["cluster_id"] == "-" and disp["b"]["priority"] is False


def test_other_pools_order_and_count(spark):
    inv = make_inventory(spark, [
        {"psm": "s", "physical_cluster": "M", "instance_num": "4"},
        {"psm": "s", "physical_cluster": "X", "iaas_cluster": "a"},
        {"psm": "s", "physical_cluster": "X", "iaas_cluster": "a"},
        {"psm": "s", "physical_cluster": "Y", "iaas_cluster": "b"},
        {"psm": "s", "physical_cluster": "M", "iaas_cluster": "gpu"},
    ])
    r = M3.migratable_services(inv, "", "M/default").first()
    assert r["other_pools"] == ["X/a", "Y/b"]
    assert r["other_pool_cluster_count"] == 3
    assert r["deployment_status"] == "多资源池"
    assert r["instance_num"] == 4.0
    st = M3.migratable_stats(M3.migratable_services(inv, "", "M/default")).first()
    assert (st["total_psm"], st["migratable_psm"], st["total_clusters"]) == (1, 1, 4)
    assert [x["pool"] for x in M3.available_pools(M3.migratable_services(inv, "", "M")).collect()] \
        == ["X/a", "Y/b"]


def test_migratable_no_exact_pool_row(spark):
    inv = make_inventory(spark, [{"psm": "s", "physical_cluster": "M", "iaas_cluster": "gpu"}])
    r = M3.migratable_services(inv, None, "M/default").first()
    assert r["instance_num"] is None and r["deployment_status"] == "单资源池"
    assert r["other_pools"] == []


def test_batch_of_one_equals_single_call(spark):
    rows = [{"psm": f"s{i % 4}", "physical_cluster": "AB"[i % 2], "instance_num": str(i),
             "idc": ["S1", "S2"][i % 3 == 0]} for i in range(20)]
    inv = make_inventory(spark, rows)
    single = M1.migration(inv, "A/default", "B/default", ["S1"], package=True, ordered=False)
    req = spark.createDataFrame([("r1", "S1", "A/default", "B/default")],
                                "request_id string, idc string, pool1 string, pool2 string")
    batch = B.migration_batch(inv, req)
    a = sorted(tuple(r) for r in single.detail.collect())
    b = sorted(tuple(r)[1:] for r in batch.detail.collect())
    assert a == b
    assert sorted(tuple(r) for r in single.summary.collect()) == \
        sorted(tuple(r)[1:] for r in batch.summary.collect())


def test_validate_requests(spark):
    req = spark.createDataFrame([("1", "A/x", "B/y"), ("2", "A/x", "A/x"), ("3", "A", "B/y"),
                                 ("4", " ", "B/y")],
                                "request_id string, pool1 string, pool2 string")
    got = {r["request_id"]: (r["valid"], r["errors"]) for r in B.validate_requests(req).collect()}
    assert got["1"] == (True, [])
    assert got["2"] == (False, ["pool1 equals pool2"])
    assert got["3"] == (False, ["pool1 is not physical/iaas"])
    assert got["4"] == (False, ["missing pool"])


def test_candidate_rules(spark):
    req = spark.createDataFrame([("T/a", "B/b, C/c"), ("T/a", "B/b,B/b"), ("T/a", "T/a"), ("", "")],
                                "target_pool string, candidate_pools string")
    errs = [r["errors"] for r in B.validate_requests(req, "candidates").collect()]
    assert errs[0] == []
    assert errs[1] == ["duplicate candidate pools"]
    assert errs[2] == ["target among candidates"]
    assert errs[3] == ["missing target pool", "no candidate pools"]
    assert C.candidate_list(" B/b, ,C/c,B/b,T/a", "T/a") == ["B/b", "C/c"]


def test_candidates_equal_single_migrations(spark):
    rows = [{"psm": f"s{i % 5}", "physical_cluster": "ABC"[i % 3],
             "iaas_cluster": ["default", "gpu"][i % 2], "instance_num": str(i)} for i in range(40)]
    inv = make_inventory(spark, rows)
    cmp = C.compare_candidates(inv, "A/default", "B/gpu, C/default, Z/none, A/default")
    ov = {r["candidate_pool"]: r for r in cmp.overview.collect()}
    assert set(ov) == {"B/gpu", "C/default", "Z/none"}
    for cand in ["B/gpu", "C/default"]:
        m = M1.migration(inv, "A/default", cand, package=True)
        assert ov[cand]["matching_psm_count"] == m.stats.first()["psm_count"]
        assert ov[cand]["has_matches"] == (ov[cand]["matching_psm_count"] > 0)
    assert ov["Z/none"]["has_matches"] is False and ov["Z/none"]["psm_count"] == 0
    cnt = cmp.counts.first()
    assert cnt["candidates"] == 3 and cnt["matched"] + cnt["unmatched"] == 3
    top = C.detail_top(cmp.detail, 3)
    assert max(r["rank"] for r in top.collect()) <= 3


def test_pad_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "row_ord long, v string")
    out = R.pad_rows(df, 2).orderBy("row_ord", "pad_index").collect()
    assert len(out) == 9
    assert sum(1 for r in out if r["v"] is None) == 6
    assert [r["v"] for r in out][:3] == ["a", None, None]
    assert R.pad_rows(df, 0).count() == 3


def test_page_rows_cover_all_once(spark):
    df = spark.range(0, 53).withColumn("k", (F.col("id") % 5).cast("int"))
    seen = []
    for p in range(6):
        seen += [r["id"] for r in R.page_rows(df, ["k"], page=p, size=10, tiebreak="id").collect()]
    assert sorted(seen) == list(range(53))


def test_search_and_other_pool_filter(spark):
    df = spark.createDataFrame([("svc.1", ["EUROPE/default", "ASIA/gpu"]), ("svc.2", ["AFRICA/spot"])],
                               "psm string, other_pools array<string>")
    assert [r["psm"] for r in FL.filter_other_pools(df, "asia").collect()] == ["svc.1"]
    flat = df.withColumn("other_pools", F.array_join("other_pools", ", "))
    assert [r["psm"] for r in FL.search_rows(flat, "SVC africa").collect()] == ["svc.2"]


def test_format_numbers(spark):
    df = spark.createDataFrame([("a", 1500.0)], "k string, x double")
    r = R.format_numbers(df, ["x"]).first()
    assert (r["x_fmt"], r["x_short"], r["x_1f"]) == ("1,500.00", "1.5K", "1500.0")


def test_pools_with_missing_parts_join_by_their_key(spark):
    rows = [{"psm": f"s{i % 3}", "physical_cluster": ["A", "B", None][i % 3],
             "iaas_cluster": ["default", None][i % 2], "idc": ["S1", "S2", "S3"][i % 3],
             "instance_num": str(i)} for i in range(30)]
    inv = make_inventory(spark, rows)
    req = spark.createDataFrame(
        [("q1", "S1,S2", "A/default", "B/nan"), ("q2", "", "nan/default", "A/default"),
         ("q3", "S3", "B/default", "A/nan")],
        "request_id string, idc string, pool1 string, pool2 string")
    got = sorted((r["request_id"], r["row_ord"]) for r in B.batch_rows(inv, B.request_pools(req)).collect())
    pk = lambda r: f"{r['physical_cluster'] or 'nan'}/{r['iaas_cluster'] or 'nan'}"
    full = inv.collect()
    want = sorted((q["request_id"], r["row_ord"]) for q in req.collect() for r in full
                  if pk(r) in (q["pool1"], q["pool2"]) and (not q["idc"] or r["idc"] in q["idc"].split(",")))
    assert got == want


def test_batch_answers_pools_with_several_slashes(spark):
    """A name with two slashes is a bare physical cluster, in the batch as in the single call."""
    inv = make_inventory(spark, [{"psm": "s1", "physical_cluster": "A/b/c", "save_cores": "5"},
                                 {"psm": "s2", "physical_cluster": "A", "save_cores": "7"}])
    req = spark.createDataFrame([("q", "S1", "A/b/c", "0")],
                                "request_id string, idc string, pool string, min_save_cores string")
    assert [r["psm"] for r in M2.recommend_batch(inv, req).collect()] == ["s1"]
    assert [r["psm"] for r in M2.recommend_scale_down(inv, "S1", "A/b/c").collect()] == ["s1"]


def test_requests_that_share_an_id_are_flagged_and_not_merged(spark):
    rows = [{"psm": f"s{i % 4}", "physical_cluster": "AB"[i % 2], "instance_num": str(i)} for i in range(24)]
    rows += [{"psm": f"s{i % 4}", "physical_cluster": "BA"[i % 2], "instance_num": str(i)} for i in range(24)]
    inv = make_inventory(spark, rows)
    schema = "request_id string, idc string, pool1 string, pool2 string"
    req = spark.createDataFrame([("r1", "", "A/default", "B/default"), ("r1", "", "B/default", "A/default"),
                                 ("r2", "", "A/default", "B/default"), ("r3", "", "A/default", "A / default")], schema)
    errors = sorted((r["request_id"], r["errors"]) for r in B.validate_requests(req).collect())
    assert errors == [("r1", ["repeated request_id"]), ("r1", ["repeated request_id"]), ("r2", []), ("r3", ["pool1 equals pool2"])]
    assert {r["request_id"] for r in B.migration_batch(inv, req).detail.collect()} == {"r2"}


def test_candidates_in_one_spelling(spark):
    assert C.candidate_list("ASIA/default, ASIA / default,EUROPE / default\t,x", "EUROPE/default") == ["ASIA/default", "x"]
    rows = [{"psm": f"s{i % 5}", "physical_cluster": ["ASIA", "EUROPE"][i % 2]} for i in range(20)]
    inv = make_inventory(spark, rows)
    out = C.compare_candidates(inv, " EUROPE / default", "ASIA/default, ASIA / default, EUROPE / default")
    got = out.overview.collect()
    assert [(r["candidate_pool"], r["matching_psm_count"], r["psm_count"]) for r in got] == [("ASIA/default", 5, 5)]
    req = spark.createDataFrame([("q", "", "EUROPE/ default", "ASIA / default,ASIA/default,EUROPE/default")],
                                "request_id string, idc string, target_pool string, candidate_pools string")
    got = C.candidate_batch(inv, req).collect()
    assert [(r["candidate_pool"], r["matching_psm_count"], r["psm_count"]) for r in got] == [("ASIA/default", 5, 5)]


def test_recommend_and_migratable_batches_equal_single_calls(spark):
    rows = [{"psm": f"s{i % 5}", "physical_cluster": "ABC"[i % 3],
             "iaas_cluster": ["default", "gpu"][i % 2], "idc": ["S1", "S2", ""][i % 3],
             "save_cores": str(i - 3), "instance_num": str(i)} for i in range(45)]
    inv = make_inventory(spark, rows)
    reqs = [("q1", "S1", "A/default", "0"), ("q2", "", "B", "2"), ("q3", "S2", "C/gpu", "x"),
            ("q4", None, "A/", " 1 "), ("q5", "S9", "A/default", "0")]
    req = spark.createDataFrame(reqs, "request_id string, idc string, pool string, min_save_cores string")
    rb = M2.recommend_batch(inv, req).collect()
    mb = M3.migratable_batch(inv, req).collect()
    for rid, idc, pool, mc in reqs:
        try:
            n = int(mc)
        except ValueError:
            n = 0
        want = sorted((tuple(r) for r in M2.recommend_scale_down(inv, idc, pool, n, ordered=False)
                       .collect()), key=repr)
        got = sorted((tuple(r)[1:] for r in rb if r["request_id"] == rid), key=repr)
        assert got == want, rid
        want = sorted((tuple(r) for r in M3.migratable_services(inv, idc, pool, ordered=False,
                                                                 keep_order_key=True).collect()),
                      key=repr)
        got = sorted((tuple(r)[1:] for r in mb if r["request_id"] == rid), key=repr)
        assert got == want, rid


def test_min_cores_text(spark):
    df = spark.createDataFrame([(" 5 ",), ("+3",), ("5.0",), ("x",), (None,)], "m string")
    assert [r[0] for r in df.select(M2.min_cores_value("m")).collect()] == [5, 3, 0, 0, 0]


def test_candidate_batch_equals_single_comparisons(spark):
    rows = [{"psm": f"s{i % 5}", "physical_cluster": "ABC"[i % 3], "idc": ["S1", "S2"][i % 2],
             "iaas_cluster": ["default", "gpu"][i % 2], "instance_num": str(i)} for i in range(40)]
    inv = make_inventory(spark, rows)
    reqs = [("q1", "S1", "A/default", "B/gpu, C/default, B/gpu, A/default"),
            ("q2", "", "B/gpu", " ,A/default,Z/x"), ("q3", "S2", "bad", "A/default")]
    req = spark.createDataFrame(reqs, "request_id string, idc string, target_pool string, "
                                      "candidate_pools string")
    got = {(r["request_id"], r["candidate_pool"]): r for r in C.candidate_batch(inv, req).collect()}
    assert {k[0] for k in got} == {"q1", "q2"}
    for rid, idc, target, cands in reqs[:2]:
        ov = C.compare_candidates(inv, target, cands, idc or None).overview.collect()
        assert len(ov) == sum(1 for k in got if k[0] == rid)
        for o in ov:
            g = got[(rid, o["candidate_pool"])]
            for k in ("has_matches", "matching_psm_count", "psm_count", "total_instances"):
                assert g[k] == o[k], (rid, o["candidate_pool"], k)


def test_pages_by_rank_equal_pages_by_offset(spark, tmp_path):
    rows = [(i, float(i * 37 % 11) if i % 9 else None, f"v{i}") for i in range(137)]
    df = spark.createDataFrame(rows, "row_ord long, x double, v string").repartition(5)
    for descending in (True, False):
        path = str(tmp_path / f"pages-{descending}")
        R.write_pages(df, path, ["x"], descending, "row_ord")
        for page in (0, 3, 13, 14):
            want = [tuple(r) for r in R.page_rows(df, ["x"], page, 10, descending, "row_ord").collect()]
            got = R.read_page(spark, path, page, 10).orderBy("page_rank").collect()
            assert [tuple(r)[:3] for r in got] == want
            assert [r.page_rank for r in got] == list(range(page * 10, page * 10 + len(want)))
    plan = R.read_page(spark, path, 3, 10)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(page_rank,30)" in plan and "Exchange" not in plan and "Sort" not in plan
    empty = str(tmp_path / "empty")
    R.write_pages(df.limit(0), empty, ["x"], True, "row_ord")
    assert R.read_page(spark, empty, 0).collect() == []


def test_pad_rows_ordered(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "row_ord long, v string")
    out = [r["v"] for r in R.pad_rows(df, 1, ordered=True).collect()]
    assert out == ["a", None, "b", None, "c", None]


def test_strict_raises_on_empty_results(spark):
    import pytest
    inv = make_inventory(spark, [{"psm": "s", "physical_cluster": "A"}])
    assert M1.migration(inv, "A/default", "B/default").detail.count() == 0
    with pytest.raises(LookupError):
        M1.migration(inv, "A/default", "B/default", strict=True)
    assert M2.recommend_scale_down(inv, "S1", "Z/default").count() == 0
    with pytest.raises(LookupError):
        M2.recommend_scale_down(inv, "S1", "Z/default", strict=True)


def test_nulls_sort_last_both_directions(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0)], "row_ord long, x double")
    up = [r["row_ord"] for r in R.page_rows(df, ["x"], size=10, tiebreak="row_ord").collect()]
    down = [r["row_ord"] for r in R.page_rows(df, ["x"], size=10, descending=True,
                                               tiebreak="row_ord").collect()]
    assert up == [3, 2, 1] and down == [2, 3, 1]

"""Spark operators against the row-loop model on seeded random inventories."""

import random

import pytest

from poolshift.operators import migratable as M3
from poolshift.operators import migration as M1
from poolshift.operators import scaling as M2

from . import model
from .helpers import make_inventory

PHYS = ["A", "B", "C", None]
IAAS = ["default", "gpu", None]
NUMS = ["1", " 2 ", "3.5", "-0.5", "nan", "", "n/a", None, "1e1", "0.9", "7.6", "+4"]


def random_rows(seed, n=60):
    rnd = random.Random(seed)
    ords = list(range(n))
    rnd.shuffle(ords)
    rows = []
    for i in range(n):
        rows.append({
            "psm": rnd.choice(["s1", "s2", "s3", "s4", "s5", None]),
            "idc": rnd.choice(["S1", "S2"]),
            "cluster_name": rnd.choice(["default", "default", "canary"]),
            "cluster_id": f"c{i}",
            "physical_cluster": rnd.choice(PHYS),
            "iaas_cluster": rnd.choice(IAAS),
            "instance_num": rnd.choice(NUMS),
            "cpu_limit": rnd.choice(["4", "8", "2.5", "x"]),
            "mem_limit": rnd.choice(["16", "32", "1.5"]),
            "package": rnd.choice(["p1", "p2", "", None]),
            "save_cores": rnd.choice(NUMS),
            "row_ord": ords[i],
        })
    return rows


SEEDS = list(range(8))


def as_dicts(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("seed", SEEDS)
def test_migration_matches_model(spark, seed):
    rows = random_rows(seed)
    inv = make_inventory(spark, rows)
    detail, summary, n, package = model.migration(rows, "A/default", "B/gpu", ["S1"])
    m = M1.migration(inv, "A/default", "B/gpu", ["S1"], package="auto")
    assert m.package == package
    got = as_dicts(m.detail)
    want = [{k: v for k, v in d.items() if k != "_ord"} for d in detail]
    assert [(g["psm"], g["pool_identifier"], g["instance_num"], g["sort_key"]) for g in got] == \
        [(w["psm"], w["pool_identifier"], w["instance_num"], w["sort_key"]) for w in want]
    assert got == want
    assert as_dicts(m.summary) == summary
    assert m.stats.first()["psm_count"] == n


@pytest.mark.parametrize("seed", SEEDS)
def test_null_pool_part_is_a_pool(spark, seed):
    rows = random_rows(seed)
    inv = make_inventory(spark, rows)
    detail, _, n, _ = model.migration(rows, "nan/default", "A/nan", None)
    m = M1.migration(inv, "nan/default", "A/nan", None, package=True)
    assert m.stats.first()["psm_count"] == n
    assert len(m.detail.collect()) == len(detail)


@pytest.mark.parametrize("seed", SEEDS)
def test_recommend_matches_model(spark, seed):
    rows = random_rows(seed)
    inv = make_inventory(spark, rows)
    for pool, lo in [("A/default", 0), ("B", 1), ("C/gpu", -5)]:
        got = [(r["psm"], r["save_cores"]) for r in
               M2.recommend_scale_down(inv, "S2", pool, lo).collect()]
        assert got == model.recommend(rows, "S2", pool, lo)


@pytest.mark.parametrize("seed", SEEDS)
def test_migratable_matches_model(spark, seed):
    rows = random_rows(seed)
    inv = make_inventory(spark, rows)
    for pool in ["A/default", "B", "C/gpu"]:
        got = [(r["psm"], r["deployment_status"], r["other_pools"], r["other_pool_cluster_count"],
                r["instance_num"], r["package"], r["cluster_id"])
               for r in M3.migratable_services(inv, "S1", pool).collect()]
        assert got == model.migratable(rows, "S1", pool)


@pytest.mark.parametrize("seed", SEEDS[:4])
def test_candidates_equal_model_per_candidate(spark, seed):
    from poolshift.operators import candidates as C
    rows = random_rows(seed)
    inv = make_inventory(spark, rows)
    cands = ["B/gpu", "C/default", "A/gpu", "nan/default"]
    cmp = C.compare_candidates(inv, "A/default", ",".join(cands), ["S1"])
    detail = cmp.detail.drop("row_ord").collect()
    summary = cmp.summary.collect()
    for cand in cands:
        want_detail, want_summary, n, package = model.migration(rows, "A/default", cand, ["S1"])
        got = [r.asDict() for r in detail if r["candidate_pool"] == cand]
        assert len(got) == len(want_detail)
        key = lambda d: (d["psm"], d["pool_identifier"], d["instance_num"], d["sort_key"])
        assert sorted(map(key, got)) == sorted(map(key, want_detail))
        got_s = [r.asDict() for r in summary if r["candidate_pool"] == cand]
        skey = lambda d: (d["psm"], d["pool_identifier"], d.get("package") if package else None,
                          d["instance_num"], d["cpu_limit"], d["mem_limit"])
        assert sorted(map(skey, got_s), key=repr) == sorted(map(skey, want_summary), key=repr)

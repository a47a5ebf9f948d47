"""A plain-Python row-loop model of the analyses (a second reading of the
semantics, used to check the Spark operators on small random inventories)."""

import math
import re
from collections import defaultdict

NUM = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


def to_num(v):
    if v is None:
        return None
    s = str(v).strip()
    return float(s) if NUM.fullmatch(s) else None


def trunc_int(x):
    return int(math.trunc(x))


def key(r):
    return f"{r['physical_cluster'] if r['physical_cluster'] is not None else 'nan'}/" \
           f"{r['iaas_cluster'] if r['iaas_cluster'] is not None else 'nan'}"


def split2(pool):
    parts = pool.strip().split("/")
    return (parts[0].strip(), parts[1].strip()) if len(parts) == 2 else None


def migration(rows, pool1, pool2, idc=None):
    rows = sorted(rows, key=lambda r: r["row_ord"])
    rows = [r for r in rows if (not idc or r["idc"] in idc) and r["cluster_name"] == "default"]
    k1, k2 = "/".join(split2(pool1)), "/".join(split2(pool2))
    pools = defaultdict(set)
    for r in rows:
        if r["psm"] is not None:
            pools[r["psm"]].add(key(r))
    valid = {p for p, s in pools.items() if k1 in s and k2 in s}
    result = [r for r in rows if r["psm"] in valid and key(r) in (k1, k2)]
    package = any(r["package"] is not None for r in result) and \
        any(r["package"] not in (None, "") for r in result)
    rank = {}
    for r in result:
        if key(r) == k1:
            rank[r["psm"]] = trunc_int(to_num(r["instance_num"]) or 0.0)
    detail = []
    for r in result:
        d = {"psm": r["psm"], "pool_identifier": key(r), "physical_cluster": r["physical_cluster"],
             "iaas_cluster": r["iaas_cluster"],
             "instance_num": trunc_int(to_num(r["instance_num"]) or 0.0),
             "cpu_limit": to_num(r["cpu_limit"]), "mem_limit": to_num(r["mem_limit"]),
             "cluster_name": r["cluster_name"], "dept_level1": r.get("dept_level1"),
             "dept_level2": r.get("dept_level2"), "host_type": r.get("host_type"),
             "idc": r["idc"], "sort_key": rank.get(r["psm"], 0), "_ord": r["row_ord"]}
        if package:
            d["package"] = r["package"]
        detail.append(d)
    detail.sort(key=lambda d: (-d["sort_key"], d["psm"], d["pool_identifier"], d["_ord"]))
    groups = {}
    for r in result:
        if package and r["package"] is None:
            continue
        g = (r["psm"], key(r)) + ((r["package"],) if package else ())
        s = groups.setdefault(g, [0.0, 0.0, 0.0])
        for i, c in enumerate(("instance_num", "cpu_limit", "mem_limit")):
            s[i] += to_num(r[c]) or 0.0
    summary = []
    for g, s in groups.items():
        d = {"psm": g[0], "pool_identifier": g[1], "instance_num": s[0], "cpu_limit": s[1],
             "mem_limit": s[2], "sort_key": rank.get(g[0], 0)}
        if package:
            d["package"] = g[2]
        summary.append(d)
    summary.sort(key=lambda d: (-d["sort_key"], d["psm"], d["pool_identifier"],
                                d.get("package") or ""))
    return detail, summary, len(valid), package


def recommend(rows, idc, pool, min_cores=0):
    p = split2(pool)
    phys, iaas = p if p else (pool.strip(), "default")
    out = []
    for r in sorted(rows, key=lambda r: r["row_ord"]):
        if idc and r["idc"] != idc:
            continue
        if r["physical_cluster"] != phys or r["iaas_cluster"] != iaas:
            continue
        v = to_num(r["save_cores"])
        if v is None:
            continue
        v = trunc_int(v)
        if v < min_cores:
            continue
        out.append((v, r["row_ord"], r["psm"]))
    out.sort(key=lambda t: (-t[0], t[1]))
    return [(psm, v) for v, _, psm in out]


def migratable(rows, idc, pool):
    p = split2(pool)
    phys, iaas = p if p else (pool.strip(), None)
    iaas = iaas or None
    rows = sorted(rows, key=lambda r: r["row_ord"])
    rows = [r for r in rows if (not idc or r["idc"] == idc) and r["cluster_name"] == "default"]
    targets = []
    for r in rows:
        if r["physical_cluster"] == phys and r["psm"] is not None and r["psm"] not in targets:
            targets.append(r["psm"])
    out = []
    for psm in targets:
        data = [r for r in rows if r["psm"] == psm]
        main = [r for r in data if r["physical_cluster"] == phys]
        if iaas:
            main = [r for r in main if r["iaas_cluster"] == iaas]
        other = [r for r in data if r["physical_cluster"] != phys]
        pools = []
        for r in other:
            if key(r) not in pools:
                pools.append(key(r))
        first = main[0] if main else {}
        out.append((psm, "多资源池" if pools else "单资源池", pools, len(other),
                    to_num(first.get("instance_num")) if first else None,
                    first.get("package"), first.get("cluster_id")))
    return out

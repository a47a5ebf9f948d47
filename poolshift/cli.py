"""Command line: run one analysis on an inventory and write its report.

    python -m poolshift migration  --inventory PATH --pool1 A/x --pool2 B/y [--idc S1,S2] --out DIR
    python -m poolshift recommend  --inventory PATH --idc S1 --pool A/x [--min-save-cores 10] --out DIR
    python -m poolshift migratable --inventory PATH --idc S1 --pool A/x --out DIR
    python -m poolshift candidates --inventory PATH --target A/x --candidates B/y,C/z [--idc ...] --out DIR

Every report is a folder of tables (one sub-folder per table) in Parquet,
JSON, CSV or ORC, written by the executors; the command prints the folder
and the row count of each table.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from .functions.exprs import NULL_PART, parse_pool_text
from .operators import candidates as C
from .operators import migratable as M3
from .operators import migration as M1
from .operators import scaling as M2
from .session import build_session, cut_lineage
from .sinks.report import read_back, report_name, report_notes, write_report
from .sources.inventory import normalise_inventory, read_inventory, scan_condition


# One line of advice for each report's notes table.
ADVICE = {
    "migration": "check dependencies and compatibility of each service before moving it",
    "recommend": "scale clusters down step by step and watch their load",
    "migratable": "services found in several pools can move first",
}


def known_scan(args: argparse.Namespace):
    """Sites and pools that the arguments name, for the scan of the inventory."""
    if args.analysis == "recommend":
        return scan_condition(args.idc, [parse_pool_text(args.pool, bare="default")])
    if args.analysis == "migratable":  # also needs the services' other pools
        return scan_condition(args.idc, default_only=True)
    names = [args.pool1, args.pool2] if args.analysis == "migration" else [
        args.target, *C.candidate_list(args.candidates, args.target)]
    pools = [parse_pool_text(p, bare="any") for p in names]
    missing = any(NULL_PART in p for p in pools)  # "nan" stands for a missing part
    return scan_condition(_sites(args.idc), () if missing else pools, default_only=True)


def _sites(text: str | None) -> list[str] | None:
    items = [s.strip() for s in (text or "").split(",")]
    return [s for s in items if s] or None


def tables_for(args: argparse.Namespace, inv: DataFrame) -> tuple[str, dict[str, DataFrame]]:
    at = datetime.now()
    if args.analysis == "migration":
        m = M1.migration(inv, args.pool1, args.pool2, _sites(args.idc), materialize=True)
        name = report_name("migration", at, args.idc or "", args.pool1, "to", args.pool2)
        stats, notes = cut_lineage(m.stats), {"idc": args.idc or "", "pool1": args.pool1, "pool2": args.pool2}
        return name, {"summary": m.summary, "detail": m.detail, "stats": stats,
                      "totals": M1.migration_totals(m.detail, args.pool1),
                      "notes": report_notes(stats, notes | {"advice": ADVICE["migration"]}, at)}
    if args.analysis == "recommend":
        rec = cut_lineage(M2.recommend_scale_down(inv, args.idc, args.pool, args.min_save_cores))
        stats = cut_lineage(M2.recommend_stats(rec))
        name = report_name("recommend_scale_down", at, args.idc or "", args.pool)
        return name, {"detail": rec, "stats": stats,
                      "notes": report_notes(stats, {"idc": args.idc or "", "pool": args.pool, "advice": ADVICE["recommend"]}, at)}
    if args.analysis == "migratable":
        ms = cut_lineage(M3.migratable_services(inv, args.idc, args.pool))
        stats = cut_lineage(M3.migratable_stats(ms))
        name = report_name("migratable_clusters", at, args.idc or "", args.pool)
        return name, {"detail": M3.migratable_flat(ms), "stats": stats,
                      "available_pools": M3.available_pools(ms),
                      "notes": report_notes(stats, {"idc": args.idc or "", "pool": args.pool, "advice": ADVICE["migratable"]}, at)}
    cmp = C.compare_candidates(inv, args.target, args.candidates, _sites(args.idc))
    name = report_name("candidates", at, args.idc or "", args.target)
    return name, {"overview": cmp.overview, "summary": cmp.summary,
                  "detail": cmp.detail.drop("row_ord"), "pool_stats": cmp.pool_stats}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="poolshift", description=__doc__.split("\n")[0])
    sub = p.add_subparsers(dest="analysis", required=True)
    for name in ("migration", "recommend", "migratable", "candidates"):
        s = sub.add_parser(name)
        s.add_argument("--inventory", required=True, help="inventory file or folder")
        s.add_argument("--format", default="parquet", choices=["parquet", "csv", "json", "orc"])
        s.add_argument("--out", required=True, help="folder that receives the report")
        s.add_argument("--out-format", default="parquet", choices=["parquet", "csv", "json", "orc"])
        s.add_argument("--idc", default=None)
        s.add_argument("--scratch", default=None, help="folder shared by all executors (spark.checkpoint.dir)")
        if name == "migration":
            s.add_argument("--pool1", required=True)
            s.add_argument("--pool2", required=True)
        elif name == "candidates":
            s.add_argument("--target", required=True)
            s.add_argument("--candidates", required=True)
        else:
            s.add_argument("--pool", required=True)
        if name == "recommend":
            s.add_argument("--min-save-cores", type=int, default=0)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(argv)
    spark = spark or build_session(extra={"spark.checkpoint.dir": args.scratch} if args.scratch else None)
    inv = normalise_inventory(read_inventory(spark, args.inventory, fmt=args.format, where=known_scan(args)))
    name, tables = tables_for(args, inv)
    folder = os.path.join(args.out, name)
    paths = write_report(tables, folder, fmt=args.out_format)
    counts = {t: read_back(spark, p, args.out_format).count() for t, p in paths.items()}
    result = {"report": folder, "rows": counts}
    print(json.dumps(result))
    return result


if __name__ == "__main__":
    main(sys.argv[1:])

import os
import tempfile

from poolshift.cli import main
from poolshift.session import scratch_path

from .helpers import make_inventory


def test_cli_runs_each_analysis(spark):
    rows = [{"psm": f"s{i % 3}", "physical_cluster": "AB"[i % 2], "instance_num": str(i),
             "save_cores": str(i), "idc": "S1"} for i in range(16)]
    inv = make_inventory(spark, rows)
    src = scratch_path(spark, "t-cli-inv")
    inv.drop("row_ord").coalesce(1).write.parquet(src)
    out = tempfile.mkdtemp(prefix="poolshift-cli-")
    r = main(["migration", "--inventory", src, "--pool1", "A/default", "--pool2", "B/default",
              "--idc", "S1", "--out", out], spark=spark)
    assert r["rows"]["detail"] == 16 and r["rows"]["stats"] == 1 and os.path.isdir(r["report"])
    r = main(["recommend", "--inventory", src, "--idc", "S1", "--pool", "A", "--min-save-cores", "4",
              "--out", out, "--out-format", "csv"], spark=spark)
    assert r["rows"]["detail"] == 6 and r["rows"]["notes"] == 7
    r = main(["migratable", "--inventory", src, "--idc", "S1", "--pool", "A/default", "--out", out,
              "--out-format", "json"], spark=spark)
    assert r["rows"]["detail"] == 3 and r["rows"]["available_pools"] == 1
    r = main(["candidates", "--inventory", src, "--target", "A/default",
              "--candidates", "B/default, Z/x", "--out", out], spark=spark)
    assert r["rows"]["overview"] == 2

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from poolshift.operators.scaling import recommend_scale_down
from poolshift.sinks import report as K
from poolshift.sources.inventory import normalise_inventory, read_inventory, scan_condition
from poolshift.session import scratch_path

from .helpers import make_inventory


def test_write_report_and_read_back(spark):
    inv = make_inventory(spark, [{"psm": "a", "physical_cluster": "A"},
                                 {"psm": "b", "physical_cluster": "B"}])
    folder = scratch_path(spark, "t-report")
    for fmt in ("parquet", "json", "csv", "orc"):
        paths = K.write_report({"inv": inv, "one": inv.limit(1)}, os.path.join(folder, fmt), fmt)
        assert K.read_back(spark, paths["inv"], fmt).count() == 2
        assert K.read_back(spark, paths["one"], fmt).count() == 1


def test_scratch_folder_comes_from_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(root)


def test_csv_quotes_and_newlines(spark):
    df = spark.createDataFrame([("a\nb", 'say "hi"', None)], "x string, y string, z string")
    path = os.path.join(tempfile.mkdtemp(prefix="poolshift-csv-"), "out")
    K.write_csv(df, path)
    text = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path))
                   if f.endswith(".csv"))
    assert '"a b"' in text and '"say ""hi"""' in text
    back = K.read_back(spark, path, "csv").first()
    assert back["x"] == "a b" and back["y"] == 'say "hi"'


def test_records_json(spark):
    df = spark.createDataFrame([("s", 3, None)], "psm string, n long, z string")
    assert K.records_json(df).first()["record"] == '{"psm":"s","n":3,"z":null}'


ROW = {"psm": "s1", "idc": "S", "cluster_name": "default", "physical_cluster": "A", "iaas_cluster": "default",
       "instance_num": "\t3 ", "cpu_limit": "40", "cpu_request": "10", "mem_limit": "8"}


def _files(fmt, records, names):
    folder = tempfile.mkdtemp(prefix="poolshift-inv-")
    for n, r in enumerate(records):
        with open(os.path.join(folder, f"{n}.{fmt}"), "w") as f:
            if fmt == "json":
                f.write(json.dumps({k: r[k] for k in names}) + "\n")
            else:
                f.write(",".join(names) + "\n" + ",".join(r[k] for k in names) + "\n")
    return folder


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_text_inventories_are_read_by_name(spark, fmt):
    names = ["idc", "mem_limit", "psm", "cluster_name", "physical_cluster", "cpu_request", "iaas_cluster", "cpu_limit", "instance_num"]
    inv = normalise_inventory(read_inventory(spark, _files(fmt, [ROW], names), fmt=fmt))
    r = inv.first()
    assert (r["psm"], r["idc"], r["cluster_id"], r["instance_num"], r["save_cores"]) == ("s1", "S", "default", 3.0, 30.0)
    with pytest.raises(ValueError, match="mem_limit"):
        normalise_inventory(read_inventory(spark, _files(fmt, [ROW], [n for n in names if n != "mem_limit"]), fmt=fmt))


def _csv(folder, name, records):
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n" + ",".join(records[0]) + "\n" + "".join(",".join(r.values()) + "\n" for r in records))


def test_csv_files_of_several_headers_are_one_table(spark):
    folder = tempfile.mkdtemp(prefix="poolshift-inv-")
    rows = [dict(ROW, psm=f"s{i}", cpu_limit=["40", "n/a", "7.5"][i % 3]) for i in range(9)]
    _csv(folder, "a x.csv", rows[:3])
    _csv(folder, "b.csv", [dict(reversed(r.items())) for r in rows[3:5]])
    _csv(folder, "c.csv", [dict(r, save_cores="1", cluster_id="own", package="p") for r in rows[5:7]])
    _csv(folder, "d[1].csv", rows[7:])
    open(os.path.join(folder, "e.csv"), "w").close()
    splits = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = normalise_inventory(read_inventory(spark, folder, fmt="csv")).orderBy("row_ord").collect()
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == splits
    assert [r["psm"] for r in got] == [f"s{i}" for i in range(9)]
    assert [r["cluster_id"] for r in got] == ["default"] * 5 + ["own"] * 2 + ["default"] * 2
    assert [r["save_cores"] for r in got] == [30, None, -2.5, 30, None, 1, 1, None, -2.5]
    assert [r["package"] for r in got] == [None] * 5 + ["p"] * 2 + [None] * 2
    one = tempfile.mkdtemp(prefix="poolshift-inv-")
    _csv(one, "one.csv", [dict(r, save_cores="1" if i in (5, 6) else str(float(r["cpu_limit"]) - 10) if i % 3 != 1 else "",
                               cluster_id="own" if i in (5, 6) else "default", package="p" if i in (5, 6) else "")
                          for i, r in enumerate(rows)])
    whole = normalise_inventory(read_inventory(spark, one, fmt="csv")).orderBy("row_ord")
    assert [tuple(r)[:-1] for r in got] == [tuple(r)[:-1] for r in whole.collect()]
    kept = read_inventory(spark, folder, fmt="csv", where=F.col("cluster_id") == "own")
    assert sorted(r["psm"] for r in kept.collect()) == ["s5", "s6"]


def test_csv_file_without_a_required_column_of_the_others_is_refused(spark):
    folder = tempfile.mkdtemp(prefix="poolshift-inv-")
    _csv(folder, "a.csv", [ROW])
    _csv(folder, "b.csv", [{k: v for k, v in ROW.items() if k != "mem_limit"}])
    with pytest.raises(ValueError, match="mem_limit"):
        read_inventory(spark, folder, fmt="csv")


def test_several_headers_below_partition_folders(spark):
    folder = tempfile.mkdtemp(prefix="poolshift-inv-")
    rest = {k: v for k, v in ROW.items() if k != "idc"}
    for site, r in (("7", rest), ("8", dict(reversed(rest.items())))):
        os.mkdir(os.path.join(folder, f"idc={site}"))
        _csv(os.path.join(folder, f"idc={site}"), "x.csv", [r])
    inv = read_inventory(spark, folder, fmt="csv", where=scan_condition("8"))
    assert [(r["psm"], r["idc"]) for r in inv.collect()] == [("s1", "8")]
    assert [r["idc"] for r in read_inventory(spark, folder, fmt="csv").orderBy("row_ord").collect()] == ["7", "8"]


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_dense_positions_do_not_depend_on_the_splits(spark, fmt):
    folder = tempfile.mkdtemp(prefix="poolshift-inv-")
    for name, n in (("a", 3000), ("b", 1), ("c", 700)):
        rows = [dict(ROW, psm=f"{name}{i}", idc="ST"[i % 2], package="p" * (i % 50)) for i in range(n)]
        if fmt == "csv":
            _csv(folder, f"{name}.csv", rows if name != "c" else [dict(reversed(r.items())) for r in rows])
        else:
            with open(os.path.join(folder, f"{name}.json"), "w") as f:
                f.writelines(json.dumps(r) + "\n" for r in rows)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before, got = {k: spark.conf.get(k) for k in keys}, []
    try:
        for split in (1 << 27, 5000):
            for k in keys:
                spark.conf.set(k, str(split))
            whole = read_inventory(spark, folder, fmt=fmt, dense=True)
            part = read_inventory(spark, folder, fmt=fmt, dense=True, where=scan_condition("T"))
            got.append([sorted((r["row_ord"]["file"], r["row_ord"]["pos"], r["psm"]) for r in x.collect()) for x in (whole, part)])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got[0] == got[1]
    assert [(p, s) for _, p, s in got[0][0]] == [(i, f"{x}{i}") for x, n in (("a", 3000), ("b", 1), ("c", 700)) for i in range(n)]
    assert [(p, s) for _, p, s in got[0][1]] == [(i, f"{x}{2 * i + 1}") for x, n in (("a", 1500), ("c", 350)) for i in range(n)]


def formatted(spark, df):
    """The entries of the scan in the formatted plan."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    lines = df._jdf.queryExecution().explainString(mode).splitlines()
    return dict(x.split(": ", 1) for x in lines if x.startswith(("PushedFilters: ", "PartitionFilters: ")))


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_filters_reach_real_files(spark, fmt):
    folder = tempfile.mkdtemp(prefix="poolshift-inv-") + "/inv"
    rows = [dict(ROW, psm=f"s{i}", idc=["S", "T"][i % 2], physical_cluster=["A", "B", ""][i % 3], save_cores=str(i)) for i in range(12)]
    spark.createDataFrame(rows).write.partitionBy("idc").format(fmt).save(folder)
    inv = normalise_inventory(read_inventory(spark, folder, fmt=fmt, where=scan_condition("S", [("A", "default")])))
    plan = formatted(spark, recommend_scale_down(inv, "S", "A/default"))
    assert "EqualTo(physical_cluster,A)" in plan["PushedFilters"] and "EqualTo(iaas_cluster,default)" in plan["PushedFilters"]
    assert "(idc#" in plan["PartitionFilters"]
    assert {r["psm"] for r in recommend_scale_down(inv, "S", "A/default").collect()} == {"s0", "s6"}


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_sites_prune_partitions_of_text_files(spark, fmt):
    folder = tempfile.mkdtemp(prefix="poolshift-inv-") + "/inv"
    w = spark.createDataFrame([dict(ROW, psm=f"s{i}", idc=["S", "T"][i % 2]) for i in range(4)]).write.partitionBy("idc")
    (w.option("header", "true") if fmt == "csv" else w).format(fmt).save(folder)
    inv = read_inventory(spark, folder, fmt=fmt, where=scan_condition("S"))
    assert "(idc#" in formatted(spark, inv)["PartitionFilters"]
    assert {r["psm"] for r in inv.collect()} == {"s0", "s2"}


def test_read_inventory_csv_with_blanks_and_missing_columns(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="poolshift-inv-"), "inv.csv")
    with open(path, "w") as f:
        f.write("psm,idc,cluster_name,cluster_id,package,physical_cluster,iaas_cluster,instance_num,"
                "cpu_limit,cpu_request,mem_limit,save_cores\n")
        f.write("s1,S,default,,,A,default, 3 ,4,1,8,nan\n")
        f.write("s2,S,default,c2,p,A,gpu,n/a,x,1,8, 2 \n")
    inv = normalise_inventory(read_inventory(spark, path, fmt="csv"))
    rows = inv.orderBy("row_ord").collect()
    assert [r["psm"] for r in rows] == ["s1", "s2"]
    assert rows[0]["instance_num"] == 3.0 and rows[1]["instance_num"] is None
    assert rows[0]["package"] is None and rows[0]["save_cores"] is None
    assert rows[1]["cpu_limit"] is None and rows[1]["save_cores"] == 2.0


def test_read_inventory_parquet_row_order(spark):
    inv = make_inventory(spark, [{"psm": f"s{i}", "physical_cluster": "A"} for i in range(5)])
    path = scratch_path(spark, "t-inv-parquet")
    inv.drop("row_ord").coalesce(1).write.parquet(path)
    back = normalise_inventory(read_inventory(spark, path))
    assert [r["psm"] for r in back.orderBy("row_ord").collect()] == [f"s{i}" for i in range(5)]


def test_report_notes(spark):
    stats = spark.createDataFrame([(5, 2)], "total_cpu long, total_clusters long")
    got = [tuple(r) for r in K.report_notes(stats, {"idc": "S"}, "t0").collect()]
    assert got == [("analysis_time", "t0"), ("idc", "S"), ("total_cpu", "5"), ("total_clusters", "2")]


def test_report_name():
    from datetime import datetime
    assert K.report_name("migration", datetime(2024, 1, 2, 3, 4, 5), "BUILDING", "A/x", "B/y") == \
        "migration_BUILDING_A-x_B-y_20240102_030405"


def test_report_notes_formats_time(spark):
    from datetime import datetime
    stats = spark.createDataFrame([(1,)], "n long")
    got = dict(tuple(r) for r in K.report_notes(stats, {}, datetime(2024, 5, 6, 7, 8, 9)).collect())
    assert got["analysis_time"] == "2024-05-06 07:08:09"


def test_read_named_inventory_falls_back(spark):
    import pytest
    from poolshift.sources.inventory import read_named_inventory
    inv = make_inventory(spark, [{"psm": "a", "physical_cluster": "A"}])
    folder = scratch_path(spark, "t-named")
    inv.drop("row_ord").write.parquet(folder + "/test-set")
    got = read_named_inventory(spark, folder, "missing", fallback="test-set")
    assert got.count() == 1
    with pytest.raises(FileNotFoundError):
        read_named_inventory(spark, folder, "missing")


def test_read_inventory_json_and_orc(spark):
    inv = make_inventory(spark, [{"psm": f"s{i}", "physical_cluster": "A", "instance_num": f" {i} "}
                                 for i in range(4)])
    raw = inv.drop("row_ord").select(*[c for c in inv.columns if c != "row_ord"])
    for fmt in ("json", "orc"):
        path = scratch_path(spark, f"t-inv-{fmt}")
        raw.coalesce(1).write.format(fmt).save(path)
        back = normalise_inventory(read_inventory(spark, path, fmt=fmt))
        got = [(r["psm"], r["instance_num"]) for r in back.orderBy("row_ord").collect()]
        assert got == [(f"s{i}", float(i)) for i in range(4)]


def test_malformed_text_lines_are_kept_or_fail_fast(spark):
    import pytest
    from poolshift.sources.inventory import bad_rows
    path = os.path.join(tempfile.mkdtemp(prefix="poolshift-bad-"), "inv.json")
    with open(path, "w") as f:
        f.write('{"psm": "s1", "idc": "S", "cluster_name": "default", "physical_cluster": "A", '
                '"iaas_cluster": "default", "instance_num": "3", "cpu_limit": "4", "mem_limit": "8"}\n')
        f.write('{"psm": "s2", "idc": "S", "cluster_name": \n')
    raw = read_inventory(spark, path, fmt="json")
    bad = bad_rows(raw).collect()
    assert len(bad) == 1 and bad[0]["_corrupt_record"].startswith('{"psm": "s2"')
    assert [r["psm"] for r in normalise_inventory(raw).collect()] == ["s1", None]
    with pytest.raises(Exception):
        read_inventory(spark, path, fmt="json", mode="FAILFAST").collect()


def test_a_failed_report_leaves_the_former_one_readable(spark, tmp_path):
    folder = str(tmp_path / "report")
    one, two = spark.range(3).toDF("a"), spark.range(5).toDF("a")
    assert K.published_tables(spark, folder) == {} and K.published(spark, folder).collect() == []
    K.publish_report({"x": one, "y": two}, folder)
    broken = spark.range(4).select(F.raise_error(F.lit("no third table")).alias("a"))
    with pytest.raises(Exception, match="no third table"):
        K.publish_report({"x": two, "y": one, "z": broken}, folder)
    got = K.published_tables(spark, folder)
    assert {n: df.count() for n, df in got.items()} == {"x": 3, "y": 5}
    K.publish_report({"x": two}, folder, "csv")
    got = K.published_tables(spark, folder)
    assert {n: df.count() for n, df in got.items()} == {"x": 5}
    assert [(r.table_name, r.seq, r.fmt, r.row_count) for r in K.published(spark, folder).collect()] == [("x", 2, "csv", 5)]

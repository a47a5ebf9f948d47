"""The deployment inventory: one row per cluster of one service.

Three ways in:

* :func:`inventory_from_tables` derives the inventory from the TPC-H style
  test tables (the fixture the correctness check uses);
* :func:`read_inventory` reads an inventory file (Parquet, ORC, CSV, JSON)
  with an explicit all-text schema, as an untidy export would arrive;
* :func:`normalise_inventory` turns either into the typed form every
  analysis expects (absent optional columns added, numbers coerced).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import DEFAULT_CLUSTER, coerce_number, in_list_or_all
from ..session import ADVISORY, size_in_bytes

TEXT_COLUMNS = [
    "psm", "idc", "cluster_name", "cluster_id", "package", "physical_cluster",
    "iaas_cluster", "cpu_util_max_1days", "cpu_util_max_7days",
    "mem_util_max_7days", "dept_level1", "dept_level2", "host_type",
]
MEASURE_COLUMNS = ["instance_num", "cpu_limit", "cpu_request", "mem_limit", "save_cores"]
REQUIRED_COLUMNS = ["psm", "idc", "cluster_name", "physical_cluster", "iaas_cluster",
                    "instance_num", "cpu_limit", "mem_limit"]

# Column order of the typed inventory.
INVENTORY_COLUMNS = [
    "psm", "idc", "cluster_name", "cluster_id", "package", "physical_cluster",
    "iaas_cluster", "instance_num", "cpu_limit", "cpu_request", "mem_limit",
    "save_cores", "cpu_util_max_1days", "cpu_util_max_7days", "mem_util_max_7days",
    "dept_level1", "dept_level2", "host_type", "row_ord",
]

# Raw file schema: everything arrives as text (numbers may be words or blanks).
RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), True)
     for c in INVENTORY_COLUMNS if c != "row_ord"]
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _row_ord():
    """File order of the fixture: the line's key, then its place among the
    lines of that key. The window needs the rows by order key, as the join
    with orders does."""
    same_line = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000
            + F.row_number().over(same_line)).cast("bigint")


def inventory_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows derived from lineitem and its dimensions (raw form).

    Mapping: a part is a service, a customer's market segment is the site,
    a supplier's region is the physical cluster, the return flag picks the
    iaas cluster and the line status the cluster name. Some measures are
    written as untidy text on purpose so that coercion has work to do.

    Join order: orders (with their customers) meet lineitem first, dealt by
    order key once for the place in the line and for this join; suppliers are
    broadcast by the planner under its size threshold, on their own size, and
    the nations with their regions (a fixed few) always; parts come last, so
    their long texts are in no shuffle of lines.

    ``row_ord`` is a bigint at every scale factor.
    """
    li = read_table(spark, sf_dir, "lineitem").repartition("l_orderkey").withColumn("row_ord", _row_ord())
    part = read_table(spark, sf_dir, "part")
    supp = read_table(spark, sf_dir, "supplier")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    orders = read_table(spark, sf_dir, "orders")
    cust = read_table(spark, sf_dir, "customer")

    geo = (nation.select("n_nationkey", "n_regionkey")
           .join(F.broadcast(region.select("r_regionkey", "r_name")),
                 F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "r_name"))
    order_cust = (orders.select("o_orderkey", "o_custkey", "o_orderpriority")
                  .join(cust.select("c_custkey", "c_mktsegment"),
                        F.col("o_custkey") == F.col("c_custkey"))
                  .select("o_orderkey", "o_orderpriority", "c_mktsegment"))

    ln = F.col("l_linenumber")
    qty = F.col("l_quantity")
    qty_text = qty.cast("string")
    j = (li.join(order_cust, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(supp.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
         .join(F.broadcast(geo), F.col("s_nationkey") == F.col("n_nationkey"))
         .join(part, F.col("l_partkey") == F.col("p_partkey")))
    return j.select(
        F.concat(F.lit("svc."), F.col("p_partkey").cast("string")).alias("psm"),
        F.col("c_mktsegment").alias("idc"),
        F.when(F.col("l_linestatus") == "O", "default").otherwise("canary").alias("cluster_name"),
        F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("cluster_id"),
        F.when(ln.isin(2, 4), F.lit(None).cast("string"))
         .when(ln == 3, F.lit(""))
         .otherwise(F.col("p_brand")).alias("package"),
        F.replace(F.col("r_name"), F.lit(" "), F.lit("-")).alias("physical_cluster"),
        F.when(F.col("l_returnflag") == "N", "default")
         .when(F.col("l_returnflag") == "A", "gpu")
         .otherwise("spot").alias("iaas_cluster"),
        F.when(ln == 7, F.lit("n/a"))
         .when(ln == 6, F.lit(None).cast("string"))
         .when(ln == 5, F.concat(F.lit("\t"), qty_text, F.lit("\n")))
         .when(ln == 4, (qty + 0.5).cast("string"))
         .otherwise(qty.cast("int").cast("string")).alias("instance_num"),
        (qty * 4).alias("cpu_limit"),
        F.col("p_size").cast("double").alias("cpu_request"),
        (qty * 8 + F.col("p_size")).alias("mem_limit"),
        F.when(ln == 1, F.lit("  "))
         .when(ln == 2, F.lit("nan"))
         .when(ln == 3, (qty - F.col("p_size") - 0.5).cast("string"))
         .otherwise((qty - F.col("p_size")).cast("string")).alias("save_cores"),
        F.when(ln == 1, F.lit(""))
         .otherwise(F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"),
                             F.lit("%"))).alias("cpu_util_max_1days"),
        F.concat(F.round(F.col("l_tax") * 100).cast("int").cast("string"),
                 F.lit("%")).alias("cpu_util_max_7days"),
        F.lit(None).cast("string").alias("mem_util_max_7days"),
        F.col("p_type").alias("dept_level1"),
        F.concat(F.lit("/"), F.col("p_name"), F.lit("/")).alias("dept_level2"),
        F.col("o_orderpriority").alias("host_type"),
        "row_ord",
    )


def _typed_measure(df: DataFrame, name: str):
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, T.NumericType):
        c = c.cast("double")
        return F.when(~F.isnan(c), c)
    return coerce_number(c)


def normalise_inventory(df: DataFrame) -> DataFrame:
    """Typed inventory with every column of :data:`INVENTORY_COLUMNS`.

    * required columns must exist (error otherwise);
    * optional text columns absent from the input become null;
      ``cluster_id`` falls back to ``cluster_name``;
    * measures become double; text that is not a number becomes null;
    * ``save_cores`` absent -> ``cpu_limit - cpu_request``;
    * ``row_ord`` absent -> file order from the source metadata is expected
      to have been attached by :func:`read_inventory`.
    """
    present = set(df.columns)
    missing = [c for c in REQUIRED_COLUMNS if c not in present]
    if missing:
        raise ValueError(f"inventory lacks required columns: {missing}")
    if "row_ord" not in present:
        raise ValueError("inventory needs a row_ord column (file order); use read_inventory")
    out = []
    for c in INVENTORY_COLUMNS:
        if c == "row_ord":
            out.append(F.col("row_ord"))
        elif c in MEASURE_COLUMNS:
            if c in present:
                out.append(_typed_measure(df, c).alias(c))
            elif c == "save_cores" and "cpu_request" in present:
                out.append((_typed_measure(df, "cpu_limit")
                            - _typed_measure(df, "cpu_request")).alias(c))
            else:
                out.append(F.lit(None).cast("double").alias(c))
        elif c in present:
            out.append(F.col(c).cast("string").alias(c))
        elif c == "cluster_id":
            out.append(F.col("cluster_name").cast("string").alias(c))
        else:
            out.append(F.lit(None).cast("string").alias(c))
    return df.select(*out)


_WRITTEN: dict[tuple, tuple[str, T.StructType]] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Identity of the source files. Local folders are listed directly (names,
    sizes, times of change); others by Spark, so any file system will do, as
    number, bytes and newest change of the files."""
    if os.path.isdir(sf_dir):
        found = [os.path.join(d, n) for d, _, names in os.walk(sf_dir) for n in names]
        return tuple(sorted((f, os.stat(f).st_size, os.stat(f).st_mtime_ns) for f in found))
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.parquet").load(sf_dir))
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime")).first())


LAYOUT = ["idc", "physical_cluster", "iaas_cluster", "row_ord"]

# While an inventory is written: shuffled bytes that AQE gives a task, whose
# rows become wide and are sorted (some 300,000 of the fixture).
WRITE_TASK_BYTES = 16 << 20


def write_inventory(df: DataFrame, path: str) -> None:
    """Write a raw inventory as Parquet partitioned by site.

    Rows are not shuffled for it: every task writes its rows as one file a
    site, sorted by pool, so that statistics of row groups and pages skip
    other pools.
    """
    spark = df.sparkSession
    before = spark.conf.get(ADVISORY)
    try:
        spark.conf.set(ADVISORY, str(min(size_in_bytes(before), WRITE_TASK_BYTES)))
        (df.sortWithinPartitions(*LAYOUT)
         .write.mode("overwrite").partitionBy("idc").parquet(path))
    finally:
        spark.conf.set(ADVISORY, before)


def read_written_inventory(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a table written by :func:`write_inventory` with the schema it was
    written with (the site partition column stays text)."""
    return spark.read.schema(schema).parquet(path).select(*INVENTORY_COLUMNS)


def raw_inventory(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """Raw inventory derived from the tables in ``sf_dir``.

    With ``materialize`` the derivation (a star join) runs once per session
    and data folder: the result is written as a table under the shared
    scratch folder and later calls read that table, as an inventory export
    would be read.
    """
    if not materialize:
        return inventory_from_tables(spark, sf_dir)
    from ..session import app_id, bound_tasks, scratch_path, size_shuffles
    key = (app_id(spark), sf_dir.rstrip('/'), _stamp(spark, sf_dir))
    found = _WRITTEN.get(key)
    if found is None:  # the write either completed or raised
        size_shuffles(spark, read_table(spark, sf_dir, "lineitem").count())
        df = inventory_from_tables(spark, sf_dir)
        found = (scratch_path(spark, "inventory"), df.schema)
        write_inventory(df, found[0])
        _WRITTEN[key] = found
    bound_tasks(spark)
    return read_written_inventory(spark, *found)


def inventory(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """Typed inventory over the test tables (what every query starts from)."""
    return normalise_inventory(raw_inventory(spark, sf_dir, materialize))


CORRUPT = "_corrupt_record"


# While headers are looked up: every file is a task of its own, which stops after its first lines.
ONE_FILE_A_TASK = {"spark.sql.files.maxPartitionBytes": str(1 << 36),
                   "spark.sql.files.openCostInBytes": str(1 << 36)}


def _files_by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """Files of a CSV inventory that begin with the same line (blank lines
    aside). A task reads the first lines of one file and leaves the rest;
    files without a line are in no group. The list of files goes through the
    driver, which holds it for every read anyway."""
    def first_line(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    lines = (spark.read.text(path)
             .filter((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
             .select(F.col("value").alias("header"), F.col("_metadata.file_path").alias("file"))
             .mapInArrow(first_line, "header string, file string")
             .groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")))
    before = {k: spark.conf.get(k) for k in ONE_FILE_A_TASK}
    try:
        for k, v in ONE_FILE_A_TASK.items():
            spark.conf.set(k, v)
        found = lines.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return sorted([_as_path(f) for f in r["files"]] for r in found)


def _as_path(uri: str) -> str:
    """A file named by its URI as a path for a reader (readers expand globs)."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(uri))


def _scans(spark: SparkSession, path: str, fmt: str, header: bool, multiline: bool) -> list[tuple[list[str], list[str]]]:
    """(paths, columns) of each scan that a text inventory needs: one, or for
    CSV files of several headers one for each list of columns. The columns are
    those a CSV's header names, or the keys that occur in any JSON record (one
    pass over the names), and the folders' partition columns."""
    if fmt == "json":
        return [([path], spark.read.option("primitivesAsString", "true").json(path).drop(CORRUPT).columns)]
    if not header:
        return [([path], RAW_SCHEMA.names)]

    def columns(paths):
        reader = spark.read.option("header", "true").option("multiLine", str(multiline).lower()).option("escape", '"')
        return reader.options(**_base(path, paths)).csv(paths).columns

    alike = _files_by_header(spark, path)
    if len(alike) < 2:
        return [([path], columns([path]))]
    scans: dict[tuple[str, ...], list[str]] = {}
    for files in alike:
        scans.setdefault(tuple(columns(files[:1])), []).extend(files)
    return [(files, list(names)) for names, files in scans.items()]


def _base(path: str, paths: list[str]) -> dict[str, str]:
    """Reader option that keeps the partition columns of single files of a folder."""
    return {} if paths == [path] or re.search(r"[*?\[{]", path) else {"basePath": path}


def _completed(df: DataFrame, every: list[str], na_values: Iterable[str]) -> DataFrame:
    """The scan of files that lack some of the inventory's columns ``every``:
    those that fall back do so here, file by file (see
    :func:`normalise_inventory`), other optional ones are null."""
    lacking = [c for c in every if c not in df.columns]
    refused = [c for c in lacking if c in REQUIRED_COLUMNS]
    if refused:
        raise ValueError(f"some files of the inventory lack required columns: {refused}")
    falls_back = {"cluster_id": F.col("cluster_name")}
    if "cpu_request" in df.columns:
        limit, request = (coerce_number(_not_blank(c, na_values)) for c in ("cpu_limit", "cpu_request"))
        falls_back["save_cores"] = (limit - request).cast("string")
    return df.withColumns({c: falls_back.get(c, F.lit(None).cast("string")) for c in lacking})


def _not_blank(c: str, na_values: Iterable[str]) -> Column:
    """``c`` without the texts that stand for a missing value. Comparisons of
    the result prune partitions, but do not reach a file's reader: hand those
    to ``where``, which tests the raw column."""
    out = F.col(c)
    for v in na_values:
        out = F.when(~F.col(c).eqNullSafe(v), out)
    return out


def read_inventory(spark: SparkSession, path: str, fmt: str = "parquet",
                   na_values: tuple[str, ...] = ("",), header: bool = True,
                   multiline: bool = False, mode: str = "PERMISSIVE",
                   where: Column | None = None, dense: bool = False) -> DataFrame:
    """Read an inventory export by column name, all text, and attach file order.

    CSV columns are found by the header (``header=False`` takes them in the
    order of :data:`RAW_SCHEMA`), JSON fields by their names; columns that a
    text inventory lacks are absent from the result, as with Parquet and ORC,
    so that :func:`normalise_inventory` can fall back or refuse. The CSV files
    of a folder may have different headers: each list of columns is a scan of
    its files, put together by name. A file that lacks a column of the others
    falls back by itself (``cluster_id``, ``save_cores``) or holds null; one
    that lacks a required column that others have is refused.

    ``row_ord`` is a struct ``(file, position)``: for Parquet the position is
    the row index inside the file (``_metadata.row_index``); for other formats
    it is the scan's increasing id, which grows with the position in a file,
    or with ``dense`` the row's number among those of its file that pass
    ``where`` (from 0, blank lines aside), however the file is split (see
    :func:`_numbered`; the files are read twice).
    ``where`` (site and pool tests, see :func:`scan_condition`) is applied to
    the raw columns below that id: it prunes partitions and reaches readers
    that take filters, for every format. Text equal to one of ``na_values``
    becomes null. ``multiline`` allows quoted line breaks in CSV, at the price
    of reading each file in one task. For text formats, ``mode='PERMISSIVE'``
    keeps malformed lines with their raw text in ``_corrupt_record`` (see
    :func:`bad_rows`); ``'FAILFAST'`` stops the read at the first one.
    """
    text = fmt in ("csv", "json")
    scans = _scans(spark, path, fmt, header, multiline) if text else [([path], [])]
    every = list(dict.fromkeys(c for _, columns in scans for c in columns))
    parts = []
    for paths, columns in scans:
        reader = spark.read.format(fmt).options(**_base(path, paths))
        if fmt == "csv":
            reader = (reader.option("header", str(header).lower()).option("enforceSchema", str(not header).lower())
                      .option("multiLine", str(multiline).lower()).option("escape", '"'))
        if text:
            reader = (reader.schema(T.StructType([T.StructField(c, T.StringType(), True) for c in [*columns, CORRUPT]]))
                      .option("mode", mode).option("columnNameOfCorruptRecord", CORRUPT))
        df = reader.load(paths)
        if len(scans) > 1:
            df = _completed(df, every, na_values)
        if where is not None:
            df = df.filter(where)
        if dense and fmt != "parquet":
            df = _numbered(df)
        else:
            pos = F.col("_metadata.row_index") if fmt == "parquet" else F.monotonically_increasing_id()
            df = df.withColumn("row_ord", F.struct(F.col("_metadata.file_path").alias("file"), pos.alias("pos")))
        parts.append(df.select(*[_not_blank(c, na_values).alias(c)
                                 if isinstance(df.schema[c].dataType, T.StringType) and c != CORRUPT else F.col(c)
                                 for c in df.columns]))
    return reduce(DataFrame.unionByName, parts)


def _numbered(df: DataFrame) -> DataFrame:
    """A scan with ``row_ord`` = (file, row number in it), in two passes: rows
    are counted by split, a split's rows begin after those of the splits
    before it in its file, and a row's place in its split is its distance from
    the split's first increasing id. Both passes plan the same splits; the
    window runs over the splits of one file, never over rows."""
    taken = set(df.columns)
    file, start, at, first, before = (c if c not in taken else f"{c}__" for c in ("_file", "_start", "_id", "_first", "_before"))
    rows = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(start),
                     F.monotonically_increasing_id().alias(at))
    earlier = Window.partitionBy(file).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    splits = (rows.groupBy(file, start).agg(F.min(at).alias(first), F.count(F.lit(1)).alias("_n"))
              .select(file, start, first, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(before)))
    pos = (F.col(before) + F.col(at) - F.col(first)).cast("bigint")
    return (rows.join(splits, [file, start])
            .select(*df.columns, F.struct(F.col(file).alias("file"), pos.alias("pos")).alias("row_ord")))


def scan_condition(idc: str | Iterable[str] | None = None, pools: Iterable[tuple[str, str | None]] = (),
                   default_only: bool = False) -> Column:
    """Test on raw inventory columns for :func:`read_inventory`'s ``where``:
    rows at one of the sites and in one of the pools (``iaas`` None: any;
    no pools: every pool). The analysis applies its own filters on top."""
    cond = in_list_or_all("idc", idc)
    any_pool = None
    for physical, iaas in pools:
        one = F.col("physical_cluster") == physical
        one = one if iaas is None else one & (F.col("iaas_cluster") == iaas)
        any_pool = one if any_pool is None else any_pool | one
    if any_pool is not None:
        cond = cond & any_pool
    return cond & (F.col("cluster_name") == DEFAULT_CLUSTER) if default_only else cond


def bad_rows(raw: DataFrame) -> DataFrame:
    """Lines of a text inventory that did not parse (raw text, service as
    parsed, position). Write or collect the result: Spark refuses a query on
    raw text files that reads only the corrupt-record column, which is what
    a bare ``count()`` of this frame would prune down to."""
    if CORRUPT not in raw.columns:
        return raw.limit(0)
    return raw.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT, "psm", "row_ord")


def read_named_inventory(spark: SparkSession, folder: str, name: str,
                         fallback: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Read data set ``name`` under ``folder``; if it does not exist, the
    ``fallback`` data set (e.g. a test inventory); else a clear error.

    Existence is checked by Spark's reader itself (works on any file system
    the cluster uses), not by local file calls.
    """
    from pyspark.errors import AnalysisException
    tried = []
    for n in [name] + ([fallback] if fallback else []):
        path = f"{folder.rstrip('/')}/{n}"
        tried.append(path)
        try:
            return read_inventory(spark, path, fmt=fmt)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "Path does not exist" not in str(e):
                raise
    raise FileNotFoundError(f"inventory data set not found: {', '.join(tried)}")

"""Report output: several named tables written side by side.

Each table goes to its own directory under one report folder, written by
the executors (``df.write``), never gathered on the driver.
"""

from __future__ import annotations

import os
import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import one_line

FORMATS = ("parquet", "json", "csv", "orc")


def records_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON object text (column ``record``); null fields are kept."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]),
                               {"ignoreNullFields": "false"}).alias("record"))


def csv_ready(df: DataFrame) -> DataFrame:
    """Values as one-line text, ready for a quoted CSV export."""
    return df.select(*[one_line(c).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", options: dict[str, str] | None = None) -> None:
    """CSV with a header, every field quoted and quotes doubled; ``options``: further options of the writer."""
    (csv_ready(df).write.mode(mode).options(**options or {})
     .option("header", "true").option("quoteAll", "true")
     .option("quote", '"').option("escape", '"')
     .csv(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, options: dict[str, str] | None = None) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if fmt == "csv":
        if partition_by:
            raise ValueError("csv report tables are written unpartitioned")
        write_csv(df, path, mode, options)
        return
    w = df.write.mode(mode).options(**options or {})
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "json":
        w = w.option("ignoreNullFields", "false")
    w.format(fmt).save(path)


def write_report(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet",
                 mode: str = "overwrite", partition_by: dict[str, list[str]] | None = None
                 ) -> dict[str, str]:
    """Write every table of ``tables`` to ``folder/<name>``; returns the paths."""
    paths = {}
    for name, df in tables.items():
        p = os.path.join(folder, name)
        write_table(df, p, fmt, mode, (partition_by or {}).get(name))
        paths[name] = p
    return paths


MANIFEST_SCHEMA = "version string, seq long, table_name string, fmt string, row_count long"


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a published report; no rows where none is published yet."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).json(os.path.join(folder, "manifest"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def publish_report(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet",
                   partition_by: dict[str, list[str]] | None = None) -> str:
    """Write a whole report as a new version of ``folder``; returns its version.

    Every table goes to ``folder/versions/<version>/<name>``; the manifest,
    one line per table with its rows, is added by one write at the very end. A
    write that fails on the way leaves files that no manifest names: readers
    (:func:`published_tables`) still get the version before. One writer a
    folder at a time; of two that finish together the later id is read.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    paths = write_report(tables, os.path.join(folder, "versions", version), fmt, "error", partition_by)
    seq = (_manifest(spark, folder).agg(F.max("seq")).first()[0] or 0) + 1
    lines = [(version, seq, name, fmt, read_back(spark, p, fmt).count()) for name, p in paths.items()]
    spark.createDataFrame(lines, MANIFEST_SCHEMA).coalesce(1).write.mode("append").json(os.path.join(folder, "manifest"))
    return version


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest lines of the newest whole report of ``folder``."""
    lines = _manifest(spark, folder)
    newest = lines.agg(F.max(F.struct("seq", "version")).alias("_newest"))
    return (lines.join(newest, F.struct("seq", "version") == F.col("_newest")).drop("_newest"))


def published_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest whole report of ``folder``."""
    lines = published(spark, folder).collect()
    return {r["table_name"]: read_back(spark, os.path.join(folder, "versions", r["version"], r["table_name"]), r["fmt"])
            for r in lines}


def read_back(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return spark.read.option("header", "true").option("escape", '"').csv(path)
    return spark.read.format(fmt).load(path)


TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def report_name(kind: str, at: datetime, *parts: str) -> str:
    """Output name such as ``migration_BUILDING_EUROPE-default_to_..._20240101_000000``:
    the kind, the request's parts (``/`` written as ``-``) and the time."""
    clean = [p.replace("/", "-").replace(" ", "") for p in parts if p]
    return "_".join([kind, *clean, at.strftime("%Y%m%d_%H%M%S")])


def report_notes(stats: DataFrame, notes: dict[str, str], at: str | datetime) -> DataFrame:
    """Notes sheet: fixed notes plus every statistic of ``stats`` as rows
    ``(item, value)``; ``at`` is the analysis time (passed in, not 'now'):
    text as given, or a datetime written as ``yyyy-MM-dd HH:mm:ss``."""
    when = F.lit(at) if isinstance(at, str) else F.date_format(F.lit(at), TIME_FORMAT)
    fixed = [F.struct(F.lit("analysis_time").alias("item"), when.alias("value"))]
    fixed += [F.struct(F.lit(k).alias("item"), F.lit(v).alias("value")) for k, v in notes.items()]
    stat_rows = [F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value"))
                 for c in stats.columns]
    return (stats.select(F.explode(F.array(*fixed, *stat_rows)).alias("n"))
            .select("n.item", "n.value"))

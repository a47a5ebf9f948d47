"""Scale-down advice: clusters of a pool that can give back cores.

A pure filter -> project -> sort plan: no shuffle except the final sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import (DEFAULT_IAAS, PRIORITY_CORES, business_line, dash_if_blank,
                               parse_pool_text, split_pool, strip)
from .filters import filter_by_idc, filter_default, filter_pool

RECOMMEND_COLUMNS = ["psm", "cluster_id", "package", "cpu_limit", "mem_limit", "save_cores",
                     "cpu_util_max_1days", "cpu_util_max_7days", "mem_util_max_7days",
                     "business_line"]


def save_cores_clean(rows: DataFrame) -> DataFrame:
    """Rows with a usable ``save_cores``: null/blank/bad text dropped, then
    truncated toward zero to a whole number (so -0.5 becomes 0)."""
    return (rows.filter(F.col("save_cores").isNotNull())
            .withColumn("save_cores", F.col("save_cores").try_cast("bigint"))
            .filter(F.col("save_cores").isNotNull()))


def recommend_scale_down(inv: DataFrame, idc: str | None, pool: str, min_save_cores: int = 0,
                         default_only: bool = False, ordered: bool = True,
                         with_priority: bool = True, strict: bool = False) -> DataFrame:
    """Clusters of ``pool`` (a bare name means iaas ``default``) at site ``idc``
    whose ``save_cores >= min_save_cores``, largest first.

    ``default_only`` restricts to clusters named ``default`` (documented but
    not applied by the original tool, hence off by default).
    """
    physical, iaas = parse_pool_text(pool, bare="default")
    rows = filter_pool(filter_by_idc(inv, idc or None), physical, iaas)
    if default_only:
        rows = filter_default(rows)
    if strict and rows.limit(1).count() == 0:
        raise LookupError(f"no rows for site {idc!r} in pool {pool!r}")
    rows = save_cores_clean(rows).filter(F.col("save_cores") >= int(min_save_cores))
    out = rows.select(*[business_line().alias(c) if c == "business_line" else F.col(c)
                        for c in RECOMMEND_COLUMNS], "row_ord")
    if with_priority:
        out = out.withColumn("priority", F.col("save_cores") > PRIORITY_CORES)
    if ordered:
        out = out.orderBy(F.col("save_cores").desc_nulls_last(), F.col("row_ord").asc())
    return out.drop("row_ord")


def recommend_stats(rec: DataFrame) -> DataFrame:
    """Cores that can be freed, number of clusters, clusters above 10 cores."""
    return rec.agg(F.coalesce(F.sum("save_cores"), F.lit(0)).cast("bigint").alias("total_cpu"),
                   F.count(F.lit(1)).cast("bigint").alias("total_clusters"),
                   F.count_if(F.col("save_cores") > PRIORITY_CORES).cast("bigint")
                   .alias("clusters_over_10"))


def recommend_display(rec: DataFrame) -> DataFrame:
    """Display form: empty text shown as ``-``."""
    text_cols = ["package", "cpu_util_max_1days", "cpu_util_max_7days", "mem_util_max_7days",
                 "business_line", "cluster_id"]
    return rec.select(*[dash_if_blank(c).alias(c) if c in text_cols else F.col(c)
                        for c in rec.columns])


def min_cores_value(c) -> "Column":
    """Threshold text -> int: a whole number (blanks around it allowed), else 0."""
    t = strip(c)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int")).otherwise(F.lit(0))


def recommend_batch(inv: DataFrame, requests: DataFrame, with_priority: bool = True) -> DataFrame:
    """Scale-down advice for every request (``request_id, idc, pool, min_save_cores``).

    Requests join the inventory on ``(physical_cluster, iaas_cluster)`` (a
    bare pool name means iaas ``default``); a blank site means every site.
    Requests that share an id, or could not be read, are not answered.
    """
    from .batch import once
    ok, phys, iaas = split_pool(F.col("pool"))
    req = once(requests).select(
        "request_id",
        F.when(F.coalesce(F.col("idc"), F.lit("")) == "", F.lit(None)).otherwise(F.col("idc"))
        .alias("req_idc"),
        F.when(ok, phys).otherwise(strip("pool")).alias("physical_cluster"),
        F.when(ok, iaas).otherwise(F.lit(DEFAULT_IAAS)).alias("iaas_cluster"),
        min_cores_value("min_save_cores").alias("min_cores"))
    rows = (inv.join(req, ["physical_cluster", "iaas_cluster"])
            .filter(F.col("req_idc").isNull() | (F.col("idc") == F.col("req_idc"))))
    rows = save_cores_clean(rows).filter(F.col("save_cores") >= F.col("min_cores"))
    out = rows.select("request_id", *[business_line().alias(c) if c == "business_line"
                                      else F.col(c) for c in RECOMMEND_COLUMNS])
    if with_priority:
        out = out.withColumn("priority", F.col("save_cores") > PRIORITY_CORES)
    return out

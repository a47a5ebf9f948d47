"""Migration analysis: services deployed in both a lender and a receiver pool.

Plan shape:

    rows  = inventory  -> site filter -> default clusters -> the two pools
            (partition pruning and Parquet filter pushdown)
    per_service = rows.groupBy(psm): in-lender?, in-receiver?, lender count,
                  row count and sums (partial aggregation map-side, so a hot
                  service is pre-combined before the shuffle); checkpointed
    detail  = rows JOIN per_service on (psm, salt)   [hot services salted;
              broadcast instead when Spark measures per_service as small]
    summary = detail.groupBy(psm, pool, package)     [partial aggregation]
    stats   = per_service.agg(...)                   [no second pass]
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import parse_pool_text, pool_key
from .filters import filter_by_idc, filter_default, pools_predicate
from ..session import cut_lineage
from .skew import join_per_key

DETAIL_COLUMNS = ["psm", "pool_identifier", "package", "physical_cluster", "iaas_cluster",
                  "instance_num", "cpu_limit", "mem_limit", "cluster_name", "dept_level1",
                  "dept_level2", "host_type", "idc"]
SUMMARY_MEASURES = ["instance_num", "cpu_limit", "mem_limit"]


@dataclass
class Migration:
    detail: DataFrame
    summary: DataFrame
    stats: DataFrame
    services: DataFrame
    package: bool


def zero_if_null(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def detail_count(c: str = "instance_num") -> Column:
    """Detail form of a count: bad -> 0, then truncated to a whole number."""
    return F.coalesce(zero_if_null(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def pool_rows(inv: DataFrame, keys: list[tuple[str, str]], idc=None) -> DataFrame:
    """Default-cluster rows of the given pools and sites, with ``pool_identifier``."""
    rows = filter_default(filter_by_idc(inv, idc))
    return (rows.filter(pools_predicate(keys))
            .withColumn("pool_identifier", pool_key()))


def lender_rank(rows: DataFrame, lender: str, receiver: str, rank_by: str = "last",
                group: list[str] | None = None, with_row_count: bool = False,
                extra: list[Column] | None = None) -> DataFrame:
    """Per service: present in both pools? and the lender's count used for ordering.

    ``rank_by='last'`` takes the count of the lender row latest in file order
    (a later row overwrites an earlier one), ``'sum'`` adds them and ``'max'``
    takes the largest. Services present in both pools only are returned;
    ``with_row_count`` adds ``_rows``, the service's row count in ``rows``;
    ``extra`` are further named aggregates computed in the same pass.
    """
    keys = (group or []) + ["psm"]
    is_lender = F.col("pool_identifier") == (F.lit(lender) if isinstance(lender, str) else lender)
    is_receiver = F.col("pool_identifier") == (F.lit(receiver) if isinstance(receiver, str)
                                               else receiver)
    n = detail_count()
    if rank_by == "last":
        rank = F.max_by(n, F.when(is_lender, F.col("row_ord")))
    elif rank_by == "sum":
        rank = F.sum(F.when(is_lender, n))
    elif rank_by == "max":
        rank = F.max(F.when(is_lender, n))
    else:
        raise ValueError(f"rank_by must be 'last', 'sum' or 'max', not {rank_by!r}")
    return (rows.filter(F.col("psm").isNotNull())
            .groupBy(*keys)
            .agg(F.bool_or(is_lender).alias("_in_lender"),
                 F.bool_or(is_receiver).alias("_in_receiver"),
                 F.coalesce(rank, F.lit(0).cast("bigint")).cast("bigint").alias("sort_key"),
                 F.count(F.lit(1)).alias("_rows"), *(extra or []))
            .filter(F.col("_in_lender") & F.col("_in_receiver"))
            .drop("_in_lender", "_in_receiver", *([] if with_row_count else ["_rows"])))


def package_present(df: DataFrame) -> bool:
    """Data-dependent gate: some package value is neither null nor empty.

    One small aggregate; pass ``package=True/False`` to skip it.
    """
    row = df.agg(F.bool_or(F.col("package").isNotNull() & (F.col("package") != ""))
                 .alias("p")).first()
    return bool(row and row["p"])


def detail_columns(package: bool, keep_sort_key: bool = True, prefix: list[str] | None = None):
    cols = [c for c in DETAIL_COLUMNS if package or c != "package"]
    out = list(prefix or [])
    for c in cols:
        out.append(detail_count().alias("instance_num") if c == "instance_num" else F.col(c))
    if keep_sort_key:
        out.append(F.col("sort_key"))
    return out


def summarise(detail_rows: DataFrame, package: bool, keep_null_package: bool = False,
              group: list[str] | None = None) -> DataFrame:
    """Sums of instances, CPU and memory per service and pool (and package).

    Measures are summed as coerced doubles with bad values as 0 (no
    truncation). With package as a key, rows whose package is null drop out
    unless ``keep_null_package``; empty text stays a key of its own.
    """
    keys = (group or []) + ["psm", "pool_identifier"] + (["package"] if package else [])
    rows = detail_rows
    if package and not keep_null_package:
        rows = rows.filter(F.col("package").isNotNull())
    return (rows.groupBy(*keys)
            .agg(*[F.sum(zero_if_null(c)).alias(c) for c in SUMMARY_MEASURES],
                 F.max("sort_key").alias("sort_key")))


def order_detail(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    return df.orderBy(*[F.col(g).asc_nulls_last() for g in (group or [])],
                      F.col("sort_key").desc_nulls_last(), F.col("psm").asc_nulls_last(),
                      F.col("pool_identifier").asc_nulls_last(), F.col("row_ord").asc_nulls_last())


def order_summary(df: DataFrame, package: bool, group: list[str] | None = None) -> DataFrame:
    keys = [F.col(g).asc_nulls_last() for g in (group or [])]
    keys += [F.col("sort_key").desc_nulls_last(), F.col("psm").asc_nulls_last(),
             F.col("pool_identifier").asc_nulls_last()]
    if package:
        keys.append(F.col("package").asc_nulls_last())
    return df.orderBy(*keys)


def migration(inv: DataFrame, pool1: str, pool2: str, idc=None, package="auto",
              rank_by: str = "last", keep_sort_key: bool = True, ordered: bool = True,
              keep_null_package: bool = False, strict: bool = False,
              materialize: bool = False) -> Migration:
    """Which services run in both ``pool1`` (lender) and ``pool2`` (receiver).

    Returns detail rows of both pools, per-service/pool sums and one row of
    statistics. ``idc`` is a site, a list of sites, or None for all.
    ``materialize`` checkpoints the matched rows into the shared checkpoint
    folder first, so that writing all three outputs reads the inventory once
    and a lost executor does not replay the whole lineage.
    """
    p1 = parse_pool_text(pool1, bare="error")
    p2 = parse_pool_text(pool2, bare="error")
    k1, k2 = "/".join(p1), "/".join(p2)
    rows = pool_rows(inv, [p1, p2], idc)
    sums = [F.sum(zero_if_null(c)).alias(f"_sum_{c}") for c in SUMMARY_MEASURES]
    per_service = lender_rank(rows, k1, k2, rank_by=rank_by, with_row_count=True, extra=sums)
    # One row per matched service, read by the hot-key table, the join back
    # and the statistics with different columns: checkpoint it once.
    per_service = cut_lineage(per_service)
    services = per_service.select("psm", "sort_key", "_rows")
    joined = join_per_key(rows, services, ["psm"], "_rows").drop("_rows")
    services = services.drop("_rows")
    if materialize:
        joined = cut_lineage(joined)
    if package == "auto":
        package = package_present(joined)
    detail = joined.select(*detail_columns(bool(package), keep_sort_key=True), "row_ord")
    summary = summarise(joined, bool(package), keep_null_package)
    if ordered:
        detail = order_detail(detail)
        summary = order_summary(summary, bool(package))
    detail = detail.drop("row_ord")
    if not keep_sort_key:
        detail = detail.drop("sort_key")
        summary = summary.drop("sort_key")
    stats = stats_from_services(per_service, pool1, pool2)
    if strict and detail.limit(1).count() == 0:
        raise LookupError(f"no service runs in both {k1} and {k2}")
    return Migration(detail, summary, stats, services, bool(package))


def stats_from_services(per_service: DataFrame, pool1: str, pool2: str) -> DataFrame:
    """The statistics row from the per-service table (one row per matched
    service carrying its sums): no second pass over the rows."""
    return per_service.agg(
        F.lit(pool1).alias("pool1"), F.lit(pool2).alias("pool2"),
        F.count(F.lit(1)).cast("bigint").alias("psm_count"),
        *[F.coalesce(F.sum(f"_sum_{c}"), F.lit(0.0)).alias(name)
          for c, name in zip(SUMMARY_MEASURES, ["total_instances", "total_cpu", "total_memory"])])


def with_role(detail: DataFrame, pool1: str, pool2: str) -> DataFrame:
    """Role of each detail row: ``lender`` (first pool) or ``receiver`` (second)."""
    k1 = "/".join(parse_pool_text(pool1))
    k2 = "/".join(parse_pool_text(pool2))
    return detail.withColumn(
        "role", F.when(F.col("pool_identifier") == k1, "lender")
        .when(F.col("pool_identifier") == k2, "receiver"))


def migration_totals(detail: DataFrame, pool1: str) -> DataFrame:
    """Movable CPU and memory: the lender rows' limits, and the service count."""
    k1 = "/".join(parse_pool_text(pool1))
    lender = F.col("pool_identifier") == k1
    return detail.agg(
        F.coalesce(F.sum(F.when(lender, zero_if_null("cpu_limit"))), F.lit(0.0)).alias("movable_cpu"),
        F.coalesce(F.sum(F.when(lender, zero_if_null("mem_limit"))), F.lit(0.0)).alias("movable_mem"),
        F.count_distinct("psm").cast("bigint").alias("service_count"))


def top_movable_services(m: Migration, k: int = 20) -> DataFrame:
    """The ``k`` services with the largest lender count (ties by service name)."""
    return (m.services.orderBy(F.col("sort_key").desc(), F.col("psm").asc())
            .limit(k))

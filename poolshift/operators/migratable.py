"""Services of a pool and the other pools they also run in.

Two aggregations, no join:

1. ``groupBy(psm, physical_cluster, iaas_cluster)``: first file position,
   row count and the first row's attributes. Partial aggregation runs
   map-side, so a service with a huge number of rows is reduced before the
   shuffle; afterwards a service has at most one row per pool.
2. ``groupBy(psm)``: is the service in the queried physical cluster, the
   other pools in first-seen order, their row count and the attributes of
   the first row in the exact pool. Group size is bounded by the number of
   pools, so the ordered list is collected from a bounded group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import STATUS_MULTI, STATUS_SINGLE, parse_pool_text, pool_key
from ..session import stored
from .filters import filter_by_idc, filter_default

ATTRIBUTES = ["instance_num", "cpu_limit", "mem_limit", "dept_level1", "dept_level2",
              "package", "cluster_id"]
DISPLAY_LIMIT = 500


def migratable_services(inv: DataFrame, idc: str | None, pool: str, ordered: bool = True,
                        keep_order_key: bool = False) -> DataFrame:
    """One row per service seen in the physical cluster of ``pool``.

    ``pool`` may be ``physical/iaas`` (attributes from the first row in that
    exact pool) or a bare physical cluster (first row of any iaas). Rows of
    the same physical cluster never count as "other", whatever their iaas.
    """
    physical, iaas = parse_pool_text(pool, bare="any")
    iaas = iaas or None
    rows = filter_default(filter_by_idc(inv, idc or None)).filter(F.col("psm").isNotNull())

    per_pool = (rows.groupBy("psm", "physical_cluster", "iaas_cluster")
                .agg(F.min("row_ord").alias("o"),
                     F.count(F.lit(1)).alias("n"),
                     F.min_by(F.struct(*ATTRIBUTES), F.col("row_ord")).alias("first_row"))
                .withColumn("pool_key", pool_key()))

    in_cluster = F.coalesce(F.col("physical_cluster") == physical, F.lit(False))
    in_pool = in_cluster & (F.coalesce(F.col("iaas_cluster") == iaas, F.lit(False))
                            if iaas is not None else F.lit(True))
    other = ~in_cluster
    others_sorted = F.array_sort(F.collect_list(F.when(other, F.struct("o", "pool_key"))))
    per_service = (per_pool.groupBy("psm")
                   .agg(F.bool_or(in_cluster).alias("_target"),
                        F.min(F.when(in_cluster, F.col("o"))).alias("first_seen"),
                        F.array_distinct(F.transform(others_sorted, lambda x: x["pool_key"]))
                        .alias("other_pools"),
                        F.coalesce(F.sum(F.when(other, F.col("n"))), F.lit(0)).cast("bigint")
                        .alias("other_pool_cluster_count"),
                        F.min_by(F.col("first_row"), F.when(in_pool, F.col("o"))).alias("_main"))
                   .filter(F.col("_target")))
    out = per_service.select(
        "psm",
        F.when(F.size("other_pools") > 0, F.lit(STATUS_MULTI)).otherwise(F.lit(STATUS_SINGLE))
        .alias("deployment_status"),
        "other_pools", "other_pool_cluster_count",
        F.lit(idc).cast("string").alias("idc"), F.lit(pool).alias("pool"),
        *[F.col("_main")[a].alias(a) for a in ATTRIBUTES],
        "first_seen")
    if ordered:
        out = out.orderBy("first_seen")
    return out if keep_order_key else out.drop("first_seen")


def migratable_flat(ms: DataFrame) -> DataFrame:
    """Export form: the other-pools list written as ``a, b, c``."""
    return ms.withColumn("other_pools", F.array_join("other_pools", ", "))


def migratable_stats(ms: DataFrame) -> DataFrame:
    """Services queried, services in several pools, and the total cluster count
    (other-pool rows plus one per service)."""
    return ms.agg(F.count(F.lit(1)).cast("bigint").alias("total_psm"),
                  F.count_if(F.col("deployment_status") == STATUS_MULTI).cast("bigint")
                  .alias("migratable_psm"),
                  (F.coalesce(F.sum("other_pool_cluster_count"), F.lit(0))
                   + F.count(F.lit(1))).cast("bigint").alias("total_clusters"))


def available_pools(ms: DataFrame) -> DataFrame:
    """Sorted distinct union of every service's other pools."""
    return (ms.select(F.explode("other_pools").alias("pool")).distinct()
            .orderBy("pool"))


def migratable_top(ms_with_order: DataFrame, n: int = DISPLAY_LIMIT) -> DataFrame:
    """The first ``n`` services in first-appearance order (the display cap)."""
    return ms_with_order.orderBy("first_seen").limit(n)


def pool_profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First level: one row per ``keys + (psm, physical, iaas)`` with the first
    file position ``o``, the row count ``n`` and the first row's attributes."""
    return (rows.groupBy(*keys, "psm", "physical_cluster", "iaas_cluster")
            .agg(F.min("row_ord").alias("o"),
                 F.count(F.lit(1)).alias("n"),
                 F.min_by(F.struct(*ATTRIBUTES), F.col("row_ord")).alias("first_row")))


def migratable_batch(inv: DataFrame, requests: DataFrame) -> DataFrame:
    """The migratable analysis for every request (``request_id, idc, pool``).

    The first aggregation does not depend on the requests: it runs once per
    site (and once more, from its result, across sites for requests without
    a site). Its rows are dealt by service once; a service's pools at a site
    (as many as there are pools, at most) become one list. Requests pick their
    services with an equi-join on ``(site, physical cluster)`` and find
    everything else in the list, so nothing is shuffled for each request. No
    join is a cross product.
    """
    from ..functions.exprs import split_pool, strip
    from .batch import once
    rows = filter_default(inv).filter(F.col("psm").isNotNull())
    # site_key: the site, or null for the across-sites profile ("every site")
    # The first aggregation feeds both profiles below: written once so the
    # rows are aggregated once.
    per_site = stored(pool_profile(rows, ["idc"]).withColumnRenamed("idc", "site_key"), "pool-profile").repartition("psm")
    per_all = (per_site.groupBy("psm", "physical_cluster", "iaas_cluster")
               .agg(F.min("o").alias("o"), F.sum("n").alias("n"),
                    F.min_by("first_row", "o").alias("first_row"))
               .withColumn("site_key", F.lit(None).cast("string")))
    pool = F.struct("o", "n", "physical_cluster", "iaas_cluster", pool_key().alias("pool_key"), "first_row")
    pools = F.collect_list(pool).alias("pools")
    services = (per_site.filter(F.col("site_key").isNotNull()).groupBy("site_key", "psm").agg(pools)
                .unionByName(per_all.groupBy("site_key", "psm").agg(pools)))

    ok, phys, iaas = split_pool(F.col("pool"))
    req = stored(once(stored(requests, "requests")).select(
        "request_id", F.col("idc").alias("req_idc"), F.col("pool").alias("req_pool"),
        F.when(F.coalesce(F.col("idc"), F.lit("")) != "", F.col("idc")).alias("req_site"),
        F.when(ok, phys).otherwise(strip("pool")).alias("req_physical"),
        F.when(ok & (iaas != ""), iaas).alias("req_iaas")), "asked-services")
    # services of each request: equi-join on (site, physical cluster)
    clusters = F.array_distinct(F.transform("pools", lambda x: x["physical_cluster"]))
    found = services.select("*", F.explode(clusters).alias("_cluster"))
    met = found.join(req, F.col("site_key").eqNullSafe(F.col("req_site")) & (F.col("_cluster") == F.col("req_physical")))

    def inside(x):
        return F.coalesce(x["physical_cluster"] == F.col("req_physical"), F.lit(False))

    def in_pool(x):
        return F.col("req_iaas").isNull() | F.coalesce(x["iaas_cluster"] == F.col("req_iaas"), F.lit(False))

    met = met.select("*", F.filter("pools", inside).alias("_own"), F.filter("pools", lambda x: ~inside(x)).alias("_others"))
    named = F.sort_array(F.transform("_others", lambda x: F.struct(x["o"].alias("o"), x["pool_key"].alias("pool_key"))))
    main = F.array_min(F.transform(F.filter("_own", in_pool), lambda x: F.struct(x["o"].alias("o"), x["first_row"].alias("row"))))
    per_service = met.select(
        "request_id", "psm", F.col("req_idc").alias("idc"), F.col("req_pool").alias("pool"),
        F.array_min(F.transform("_own", lambda x: x["o"])).alias("first_seen"),
        F.array_distinct(F.transform(named, lambda x: x["pool_key"])).alias("other_pools"),
        F.aggregate("_others", F.lit(0).cast("bigint"), lambda total, x: total + x["n"]).alias("other_pool_cluster_count"),
        main["row"].alias("_main"))
    return per_service.select(
        "request_id", "psm",
        F.when(F.size("other_pools") > 0, F.lit(STATUS_MULTI)).otherwise(F.lit(STATUS_SINGLE))
        .alias("deployment_status"),
        "other_pools", "other_pool_cluster_count", "idc", "pool",
        *[F.col("_main")[a].alias(a) for a in ATTRIBUTES],
        "first_seen")

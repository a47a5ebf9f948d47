"""Registered queries: every analysis and tool run on the test tables.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole inventory derived from the tables in ``sf_dir``. Parameters are the
standard ones (pools, sites, thresholds) so that every entry is
argument-free. Where an output holds a list, the list is also given as
``a, b, c`` text so that engines compare it the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import (coerce_number, count_or_zero, list_size, normal_pool, number_or_zero,
                               pool_key, split_pool)
from ..operators import batch as B
from ..operators import candidates as C
from ..operators import filters as FL
from ..operators import migratable as M3
from ..operators import migration as M1
from ..operators import overlap as OV
from ..operators import results as R
from ..operators import scaling as M2
from ..operators import search as SE
from ..session import scratch_path
from ..sinks import report as K
from ..sources.inventory import (INVENTORY_COLUMNS, inventory, normalise_inventory,
                                 raw_inventory, read_inventory)
from ..sources.requests import mixed_bodies, request_bodies, request_table

# Standard parameters of the checks.
POOL1 = "EUROPE/default"
POOL2 = "ASIA/default"
SITES = ["BUILDING", "MACHINERY"]
SITE = "BUILDING"
POOL = "EUROPE/default"
CANDIDATES = "ASIA/default, AFRICA/gpu, AMERICA/spot, NOWHERE/default"
SEARCH_TEXT = "Brand#1 europe"
OTHER_POOL_TEXT = "asia"
TOP_K = 20
PAGE, PAGE_SIZE = 1, 25
PAD_ROWS = 2
NOTE_TIME = "2024-01-01 00:00:00"


def _migration(spark, sf_dir, package=True, **kw) -> M1.Migration:
    return M1.migration(inventory(spark, sf_dir), POOL1, POOL2, SITES, package=package,
                        ordered=False, **kw)


def q_pool_key(spark, sf_dir):
    return (inventory(spark, sf_dir).groupBy(pool_key().alias("pool_key"))
            .agg(F.count(F.lit(1)).alias("row_count")))


def q_filter_by_idc(spark, sf_dir):
    return (FL.filter_by_idc(inventory(spark, sf_dir), SITES)
            .select("row_ord", "psm", "idc", "physical_cluster", "iaas_cluster"))


def q_filter_default(spark, sf_dir):
    return (FL.filter_default(inventory(spark, sf_dir))
            .select("row_ord", "psm", "idc", "cluster_name"))


def q_services_in_both_pools(spark, sf_dir):
    return _migration(spark, sf_dir).services.select("psm")


def q_lender_rank(spark, sf_dir):
    return _migration(spark, sf_dir).services


def q_migration_detail(spark, sf_dir):
    return _migration(spark, sf_dir).detail


def q_coerce_numbers(spark, sf_dir):
    raw = raw_inventory(spark, sf_dir)
    return raw.select(
        "row_ord",
        F.col("instance_num").alias("raw_instance_num"),
        coerce_number("instance_num").alias("instance_num"),
        number_or_zero("instance_num").alias("instance_num_or_zero"),
        count_or_zero("instance_num").alias("instance_count"),
        coerce_number("save_cores").alias("save_cores"))


def q_package_present(spark, sf_dir):
    inv = inventory(spark, sf_dir)
    p1 = M1.parse_pool_text(POOL1)
    p2 = M1.parse_pool_text(POOL2)
    rows = M1.pool_rows(inv, [p1, p2], SITES)
    joined = rows.join(M1.lender_rank(rows, "/".join(p1), "/".join(p2)), "psm")
    return joined.agg(F.coalesce(F.bool_or(F.col("package").isNotNull()
                                           & (F.col("package") != "")), F.lit(False))
                      .alias("package_present"))


def q_migration_summary(spark, sf_dir):
    return _migration(spark, sf_dir).summary


def q_migration_summary_no_package(spark, sf_dir):
    return _migration(spark, sf_dir, package=False).summary


def q_migration_stats(spark, sf_dir):
    return _migration(spark, sf_dir).stats.select("pool1", "pool2", "psm_count")


def q_migration_stats_full(spark, sf_dir):
    return _migration(spark, sf_dir).stats


def q_migration_totals(spark, sf_dir):
    return M1.migration_totals(_migration(spark, sf_dir).detail, POOL1)


def q_migration_role(spark, sf_dir):
    return M1.with_role(_migration(spark, sf_dir).detail, POOL1, POOL2)


def q_top_movable_services(spark, sf_dir):
    return M1.top_movable_services(_migration(spark, sf_dir), TOP_K)


def _pool_rows(spark, sf_dir, inv=None):
    phys, iaas = M1.parse_pool_text(POOL, bare="default")
    return FL.filter_pool(FL.filter_by_idc(inv or inventory(spark, sf_dir), SITE), phys, iaas)


def q_filter_pool(spark, sf_dir):
    return _pool_rows(spark, sf_dir).select("row_ord", "psm", "cluster_id", "physical_cluster",
                                            "iaas_cluster")


def q_save_cores_clean(spark, sf_dir):
    return M2.save_cores_clean(_pool_rows(spark, sf_dir)).select("row_ord", "psm", "save_cores")


def q_save_cores_derived(spark, sf_dir):
    inv = normalise_inventory(raw_inventory(spark, sf_dir).drop("save_cores"))
    return M2.recommend_scale_down(inv, SITE, POOL, 0, ordered=False)


def q_recommend_scale_down(spark, sf_dir):
    return M2.recommend_scale_down(inventory(spark, sf_dir), SITE, POOL, 0, ordered=False)


def q_recommend_min_cores(spark, sf_dir):
    return M2.recommend_scale_down(inventory(spark, sf_dir), SITE, POOL, 10, ordered=False)


def q_recommend_display(spark, sf_dir):
    return M2.recommend_display(q_recommend_scale_down(spark, sf_dir))


def q_recommend_stats(spark, sf_dir):
    return M2.recommend_stats(q_recommend_scale_down(spark, sf_dir))


def q_business_line(spark, sf_dir):
    from ..functions.exprs import business_line
    return inventory(spark, sf_dir).select("row_ord", business_line().alias("business_line"))


def _migratable(spark, sf_dir, keep_order_key=True):
    return M3.migratable_services(inventory(spark, sf_dir), SITE, POOL, ordered=False,
                                  keep_order_key=keep_order_key)


def q_migratable_services(spark, sf_dir):
    return M3.migratable_flat(_migratable(spark, sf_dir))


def q_migratable_flat(spark, sf_dir):
    return M3.migratable_flat(_migratable(spark, sf_dir, keep_order_key=False))


def q_migratable_stats(spark, sf_dir):
    return M3.migratable_stats(_migratable(spark, sf_dir, keep_order_key=False))


def q_available_pools(spark, sf_dir):
    return M3.available_pools(_migratable(spark, sf_dir, keep_order_key=False))


def q_migratable_top(spark, sf_dir):
    return M3.migratable_flat(M3.migratable_top(_migratable(spark, sf_dir)))


def q_filter_other_pools(spark, sf_dir):
    return M3.migratable_flat(FL.filter_other_pools(_migratable(spark, sf_dir), OTHER_POOL_TEXT))


def _compare(spark, sf_dir) -> C.CandidateComparison:
    return C.compare_candidates(inventory(spark, sf_dir), POOL1, CANDIDATES, SITES)


def q_parse_candidates(spark, sf_dir):
    req = request_table(spark, sf_dir)
    raw = C.candidates_column(F.col("candidate_pools"))
    cands = C.candidates_column(F.col("candidate_pools"), F.col("target_pool"))
    items = F.filter(F.transform(F.split(F.coalesce("candidate_pools", F.lit("")), ","), normal_pool),
                     lambda x: x != "")
    return req.select(
        "request_id", "target_pool",
        F.array_join(cands, ",").alias("candidates"),
        F.size(cands).alias("candidate_count"),
        list_size("candidate_pools").alias("listed_count"),
        (F.size(items) != F.size(raw)).alias("had_duplicates"),
        F.array_contains(raw, normal_pool(F.col("target_pool"))).alias("target_listed"))


def q_pool_stats(spark, sf_dir):
    return _compare(spark, sf_dir).pool_stats


def q_candidate_matches(spark, sf_dir):
    return _compare(spark, sf_dir).matches


def q_candidate_overview(spark, sf_dir):
    return _compare(spark, sf_dir).overview


def q_candidate_summary(spark, sf_dir):
    return _compare(spark, sf_dir).summary


def q_candidate_detail(spark, sf_dir):
    return _compare(spark, sf_dir).detail.drop("row_ord")


def q_candidate_detail_top(spark, sf_dir):
    return C.detail_top(_compare(spark, sf_dir).detail).drop("row_ord")


def q_candidate_counts(spark, sf_dir):
    return _compare(spark, sf_dir).counts


def q_parse_requests(spark, sf_dir):
    return B.parse_requests(request_bodies(spark, sf_dir)).select(*B.REQUEST_SCHEMA.names)


def q_parse_pool(spark, sf_dir):
    req = B.parse_requests(request_bodies(spark, sf_dir))
    ok, phys, iaas = split_pool(F.col("pool2"))
    return req.select("request_id", "pool2", ok.alias("is_pair"), phys.alias("physical"),
                      iaas.alias("iaas"))


def q_validate_pools(spark, sf_dir):
    req = B.parse_requests(request_bodies(spark, sf_dir))
    return req.select("request_id", B.valid_pool("pool1").alias("pool1_ok"),
                      B.valid_pool("pool2").alias("pool2_ok"))


def q_validate_requests_candidates(spark, sf_dir):
    req = B.validate_requests(B.parse_requests(request_bodies(spark, sf_dir)), "candidates")
    return req.select("request_id", F.array_join("errors", "; ").alias("errors"), "valid")


def q_validate_requests_scale_down(spark, sf_dir):
    req = B.validate_requests(B.parse_requests(request_bodies(spark, sf_dir)), "scale_down")
    return req.select("request_id", F.array_join("errors", "; ").alias("errors"), "valid")


def q_validate_requests(spark, sf_dir):
    req = B.validate_requests(B.parse_requests(request_bodies(spark, sf_dir)))
    return req.select("request_id", F.array_join("errors", "; ").alias("errors"), "valid")


def q_typed_requests(spark, sf_dir):
    """Bodies of every shape: what was read, and what is wrong with each."""
    req = B.parse_requests(mixed_bodies(spark, sf_dir), keep=["c_custkey"])
    return B.validate_requests(req, "candidates").select(
        "c_custkey", "request_id", F.array_join("sites", "|").alias("sites"), F.array_join("candidates", "|").alias("candidates"),
        F.array_join("errors", "; ").alias("errors"), "valid")


def q_candidate_batch_typed(spark, sf_dir):
    """The candidate overview for the bodies that could be read: many requests, few different questions."""
    return C.candidate_batch(inventory(spark, sf_dir), B.parse_requests(mixed_bodies(spark, sf_dir)))


def q_candidate_overlap(spark, sf_dir):
    """The services that target and candidates share, for the bodies that could be read, from bitmaps."""
    return OV.candidate_overlap(inventory(spark, sf_dir), B.parse_requests(mixed_bodies(spark, sf_dir)))


def _batch(spark, sf_dir):
    req = B.parse_requests(request_bodies(spark, sf_dir))
    return B.migration_batch(inventory(spark, sf_dir), req)


def q_migration_batch(spark, sf_dir):
    return _batch(spark, sf_dir).detail


def q_migration_batch_summary(spark, sf_dir):
    return _batch(spark, sf_dir).summary


def q_migration_batch_stream(spark, sf_dir):
    """The batch answered by the streaming job: request files arrive in two
    parts (two micro-batches); the detail written by all batches is read back."""
    from ..streaming.requests import answer_requests, read_answers
    landing = scratch_path(spark, "request-files")
    bodies = request_bodies(spark, sf_dir)
    first = F.get_json_object("body", "$.request_id").startswith("r0")
    for part in (first, ~first):  # every request lands, in two writes
        bodies.filter(part).write.mode("append").text(landing)
    sink = scratch_path(spark, "request-answers")
    # static side: the written inventory table, read by every micro-batch
    q = answer_requests(spark, lambda: inventory(spark, sf_dir), landing, sink,
                        kinds=("migration",))
    q.awaitTermination()
    return read_answers(spark, sink, "detail").drop("batch_id")


def q_recommend_batch(spark, sf_dir):
    req = B.parse_requests(request_bodies(spark, sf_dir))
    return M2.recommend_batch(inventory(spark, sf_dir), req)


def q_migratable_batch(spark, sf_dir):
    req = B.parse_requests(request_bodies(spark, sf_dir))
    return M3.migratable_flat(M3.migratable_batch(inventory(spark, sf_dir), req))


def q_candidate_batch(spark, sf_dir):
    req = B.parse_requests(request_bodies(spark, sf_dir))
    return C.candidate_batch(inventory(spark, sf_dir), req)


_EXPORTS: dict[tuple, str] = {}
# Exports are text, many times the table's size: written compressed, in files
# that a task reads whole.
EXPORT_FILES = {"compression": "gzip", "maxRecordsPerFile": "500000"}


def _export(spark, sf_dir, fmt: str, columns: list[str]) -> str:
    """An export of the raw inventory with the given columns, written once per
    session and source data."""
    from ..session import app_id
    from ..sources.inventory import _stamp
    key = (app_id(spark), fmt, *columns, _stamp(spark, sf_dir))
    if key not in _EXPORTS:
        path = scratch_path(spark, f"inventory-{fmt}")
        K.write_table(raw_inventory(spark, sf_dir).select(*columns), path, fmt, options=EXPORT_FILES)
        _EXPORTS[key] = path
    return _EXPORTS[key]


def _read_export(spark, sf_dir, fmt, columns):
    return normalise_inventory(read_inventory(spark, _export(spark, sf_dir, fmt, columns), fmt=fmt)).drop("row_ord")


def q_read_inventory(spark, sf_dir):
    """An untidy CSV export of the inventory (all text, quoted, blanks), read and normalised."""
    return _read_export(spark, sf_dir, "csv", [c for c in INVENTORY_COLUMNS if c != "row_ord"])


# Columns of the exports that come in another order and without save_cores and cluster_id.
REORDERED = ["idc", "mem_limit", "psm", "cpu_request", "cluster_name", "physical_cluster", "package",
             "iaas_cluster", "instance_num", "cpu_limit"]


def q_read_inventory_reordered(spark, sf_dir):
    """CSV columns are found by name; absent ones fall back (cluster_name, cpu_limit - cpu_request)."""
    return _read_export(spark, sf_dir, "csv", REORDERED).select(*REORDERED, "cluster_id", "save_cores", "host_type")


def q_read_inventory_json(spark, sf_dir):
    """The same from JSON lines."""
    return _read_export(spark, sf_dir, "json", REORDERED).select(*REORDERED, "cluster_id", "save_cores", "host_type")


def q_read_inventory_mixed(spark, sf_dir):
    """A folder of CSV exports with three different headers, read as one table."""
    raw, path = raw_inventory(spark, sf_dir), scratch_path(spark, "inventory-mixed")
    line = F.floor(F.col("row_ord") / 1000) % 10
    every = [c for c in INVENTORY_COLUMNS if c != "row_ord"]
    for columns, own in ((REORDERED, line <= 2), (every, line.isin(3, 4)),
                         ([c for c in reversed(every) if c != "dept_level2"], line >= 5)):
        K.write_table(raw.filter(own).select(*columns), path, "csv", mode="append", options=EXPORT_FILES)
    return normalise_inventory(read_inventory(spark, path, fmt="csv")).drop("row_ord")


def q_normalised_inventory(spark, sf_dir):
    return inventory(spark, sf_dir)


def q_search_rows(spark, sf_dir):
    return FL.search_rows(_migration(spark, sf_dir).detail, SEARCH_TEXT)


def q_search_indexed(spark, sf_dir):
    """The same rows by the trigram index of the written detail rows."""
    detail = _migration(spark, sf_dir).detail
    path = scratch_path(spark, "search")
    SE.write_search_table(detail, path, ["psm", "pool_identifier"], block_rows=256)
    return SE.search_table(spark, path, SEARCH_TEXT).drop(SE.RANK)


def q_search_inventory(spark, sf_dir):
    """One service looked up by its name's letters in the whole inventory."""
    rows = inventory(spark, sf_dir).select("row_ord", "psm", "cluster_id", "idc", "physical_cluster", "iaas_cluster")
    path = scratch_path(spark, "search")
    SE.write_search_table(rows, path, ["psm"], ["psm", "cluster_id", "idc"], tiebreak="row_ord", block_rows=1024)
    return SE.search_table(spark, path, "SVC.77 build").drop(SE.RANK)


def q_page_rows(spark, sf_dir):
    rows = _pool_rows(spark, sf_dir).select("row_ord", "psm", "cluster_id", "cpu_limit")
    return R.page_rows(rows, ["cpu_limit"], page=PAGE, size=PAGE_SIZE, descending=True,
                       tiebreak="row_ord")


def q_page_rows_middle(spark, sf_dir):
    """The page in the middle of all rows, read from a table of ranks."""
    rows = inventory(spark, sf_dir).select("row_ord", "psm", "cluster_id", "cpu_limit")
    path = scratch_path(spark, "pages")
    R.write_pages(rows, path, ["cpu_limit"], descending=True, tiebreak="row_ord")
    middle = spark.read.parquet(path).count() // 2 // PAGE_SIZE
    return R.read_page(spark, path, middle, PAGE_SIZE)


def q_format_numbers(spark, sf_dir):
    s = _migration(spark, sf_dir).summary
    return R.format_numbers(s, ["instance_num", "cpu_limit", "mem_limit"]).drop(
        "instance_num", "cpu_limit", "mem_limit")


def q_pad_rows(spark, sf_dir):
    rows = _pool_rows(spark, sf_dir).select("row_ord", "psm", "cluster_id", "cpu_limit")
    return R.pad_rows(rows, PAD_ROWS)


def q_records_json(spark, sf_dir):
    return K.records_json(q_recommend_scale_down(spark, sf_dir).select("psm", "package", "save_cores", "mem_util_max_7days"))


def q_csv_export(spark, sf_dir):
    path = scratch_path(spark, "recommend-csv")
    K.write_csv(q_recommend_display(spark, sf_dir), path)
    return K.read_back(spark, path, "csv")


def q_report_tables(spark, sf_dir):
    m = _migration(spark, sf_dir, materialize=True)
    folder = scratch_path(spark, "migration-report")
    paths = K.write_report({"summary": m.summary, "detail": m.detail, "stats": m.stats}, folder)
    parts = [K.read_back(spark, p).agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count")
             for name, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_published_report(spark, sf_dir):
    """A report published twice: the manifest of the newest version, counted again from its tables."""
    m = _migration(spark, sf_dir, materialize=True)
    folder = scratch_path(spark, "published")
    K.publish_report({"summary": m.summary, "stats": m.stats}, folder)
    K.publish_report({"summary": m.summary, "detail": m.detail, "stats": m.stats}, folder)
    out = None
    for name, df in K.published_tables(spark, folder).items():
        part = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        out = part if out is None else out.unionByName(part)
    return out.join(K.published(spark, folder).select("table_name", F.col("row_count").alias("listed_count")), "table_name")


def q_candidate_report(spark, sf_dir):
    """Per-candidate report tables written partitioned by candidate pool,
    row counts read back per table and candidate."""
    cmp = _compare(spark, sf_dir)
    folder = scratch_path(spark, "candidate-report")
    paths = K.write_report({"summary": cmp.summary, "detail": cmp.detail.drop("row_ord")},
                           folder, partition_by={"summary": ["candidate_pool"],
                                                 "detail": ["candidate_pool"]})
    parts = [K.read_back(spark, p).groupBy("candidate_pool")
             .agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "candidate_pool", "row_count")
             for name, p in paths.items()]
    return parts[0].unionByName(parts[1])


def q_report_notes(spark, sf_dir):
    stats = q_recommend_stats(spark, sf_dir)
    return K.report_notes(stats, {"idc": SITE, "pool": POOL}, NOTE_TIME)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}

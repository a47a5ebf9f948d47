"""Many migration questions in one plan.

Request bodies are read once as VARIANT and then typed (:func:`parse_requests`);
a body that cannot be read, a missing id and a field of a wrong type are
errors of their own, never another question.

Requests that ask the same (same two pools, same set of sites) form a class
and are evaluated once. The inventory is first aggregated per (pool, site,
service), whatever is asked of it; classes join this profile, not the rows,
merge the sites they name, and their answers are handed out to their members
at the end. So what is shuffled before the first aggregation does not grow
with the number of requests. Which side of a join is broadcast, if any, is
left to the planner and to AQE, which measure sizes: one plan, one answer, at
any number of requests.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import NULL_PART, POOL_PATTERN, normal_pool, pool_key, split_pool, strip
from ..session import stored
from .filters import filter_default
from .skew import join_per_key
from .migration import (DETAIL_COLUMNS, SUMMARY_MEASURES, detail_columns, detail_count, order_detail, order_summary,
                        summarise, zero_if_null)

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("idc", T.StringType()),
    T.StructField("pool1", T.StringType()),
    T.StructField("pool2", T.StringType()),
    T.StructField("pool", T.StringType()),
    T.StructField("min_save_cores", T.StringType()),
    T.StructField("target_pool", T.StringType()),
    T.StructField("candidate_pools", T.StringType()),
])


# Fields that hold a list: a comma text, or a JSON array of texts.
LISTS = {"idc": "sites", "candidate_pools": "candidates"}
# Fields that may also come as a number.
NUMBERS = ("request_id", "min_save_cores")
UNREADABLE, NO_OBJECT, NO_ID = "body is not JSON", "body is not an object", "missing request_id"


def parse_requests(df: DataFrame, column: str = "body", keep: Sequence[str] = ()) -> DataFrame:
    """JSON request bodies -> the columns of :data:`REQUEST_SCHEMA` (unknown
    keys ignored), ``sites`` and ``candidates`` (arrays, see below) and
    ``faults``, the reasons why a body is no request.

    ``idc`` and ``candidate_pools`` are a comma text or an array of texts; both
    give the same array (items without blanks around them; null items of an
    array dropped), in which an item of an array may hold a comma. The text
    column of an array is its items joined by commas. A null field is an
    absent one. A field of another type is null and named in ``faults``.
    ``keep``: columns of ``df`` put in front (an arrival time, a position).
    """
    body = df.select(*keep, F.try_parse_json(F.col(column)).alias("_v"))
    fields, faults = [*map(F.col, keep), F.col("_v")], []
    for f in REQUEST_SCHEMA.names:
        fields += [F.try_variant_get("_v", f"$.{f}", "variant").alias(f"_{f}")]
    body = body.select(*fields).select(
        "*", F.schema_of_variant("_v").startswith("OBJECT").alias("_object"),
        *[F.schema_of_variant(f"_{f}").alias(f"_type_{f}") for f in REQUEST_SCHEMA.names])
    out = []
    for f in REQUEST_SCHEMA.names:
        kind = F.col(f"_type_{f}")
        text = kind == "STRING"
        if f in NUMBERS:
            text = text | kind.rlike("^(BIGINT|DECIMAL|DOUBLE)")
        value = F.when(text, F.try_variant_get(f"_{f}", "$", "string"))
        fits, wrong = text, f"{f} is not text"
        if f in LISTS:
            items = F.filter(F.transform(F.try_variant_get(f"_{f}", "$", "array<string>"), strip), lambda x: x.isNotNull())
            listed = kind.isin("ARRAY<STRING>", "ARRAY<VOID>")
            fits, wrong = text | listed, f"{f} is neither text nor a list of texts"
            out.append(F.when(listed, items).otherwise(site_list(value)).alias(LISTS[f]))
            value = F.when(listed, F.array_join(items, ",")).otherwise(value)
        out.append(value.alias(f))
        faults.append(F.when(~fits & (kind != "VOID"), F.lit(wrong)))
    # an id that is absent, null or blank; one of a wrong type is named as such
    no_id = F.coalesce(F.col("_type_request_id"), F.lit("VOID")).isin("VOID") | (strip(F.try_variant_get("_request_id", "$", "string")) == "")
    faults.append(F.when(no_id, F.lit(NO_ID)))
    found = (F.when(F.col("_v").isNull(), F.array(F.lit(UNREADABLE)))
             .when(~F.col("_object"), F.array(F.lit(NO_OBJECT))).otherwise(F.array_compact(F.array(*faults))))
    return (body.select(*keep, *out, found.alias("faults"))
            .select(*keep, *REQUEST_SCHEMA.names, *LISTS.values(), "faults"))


def listed(requests: DataFrame, field: str) -> Column:
    """The items of a list field: the array of a parsed body, or the field's text, split."""
    name = LISTS[field]
    if name in requests.columns and isinstance(requests.schema[name].dataType, T.ArrayType):
        return F.coalesce(F.col(name), F.array().cast("array<string>"))
    return site_list(field)


def site_list(c: str | Column) -> Column:
    """Comma list of sites; blank or null means every site (empty array)."""
    s = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(strip(s), F.lit("")) == "", F.array().cast("array<string>")) \
        .otherwise(F.transform(F.split(s, ","), strip))


def valid_pool(c: str | Column) -> Column:
    """Pool text has the form ``name/name`` (letters, digits, ``_``, ``-``)."""
    s = F.col(c) if isinstance(c, str) else c
    return F.coalesce(strip(s).rlike(POOL_PATTERN), F.lit(False))


def request_errors(kind: str = "migration", pools: Column | None = None) -> Column:
    """Array of rule violations for one request row (empty when valid).
    ``pools``: the candidate pools as an array, else the text is split."""
    def blank(c):
        return F.coalesce(strip(c), F.lit("")) == ""
    checks = []
    if kind == "migration":
        checks = [
            (blank("pool1") | blank("pool2"), "missing pool"),
            (~blank("pool1") & ~split_pool(F.col("pool1"))[0], "pool1 is not physical/iaas"),
            (~blank("pool2") & ~split_pool(F.col("pool2"))[0], "pool2 is not physical/iaas"),
            (~blank("pool1") & ~blank("pool2") & (normal_pool(F.col("pool1")) == normal_pool(F.col("pool2"))),
             "pool1 equals pool2"),
        ]
    elif kind == "scale_down":
        checks = [(blank("idc") | blank("pool"), "missing site or pool")]
    elif kind == "candidates":
        cands = site_list("candidate_pools") if pools is None else pools
        cands = F.filter(F.transform(cands, normal_pool), lambda x: x != "")
        checks = [
            (blank("target_pool"), "missing target pool"),
            (F.size(cands) == 0, "no candidate pools"),
            (F.size(F.array_distinct(cands)) != F.size(cands), "duplicate candidate pools"),
            (F.coalesce(F.array_contains(cands, normal_pool(F.col("target_pool"))), F.lit(False)), "target among candidates"),
            (~F.forall(cands, lambda x: x.rlike(POOL_PATTERN)), "candidate pool format"),
        ]
    else:
        raise ValueError(kind)
    return F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in checks]))


def validate_requests(requests: DataFrame, kind: str = "migration") -> DataFrame:
    """Request rows with an ``errors`` array and a ``valid`` flag.

    The faults of a parsed body come alone: the rules are only asked of
    requests that could be read. An id that several rows carry is an error in
    each of them, a null id in its row: answers are told apart by it (requests
    without an id column are single questions)."""
    errors = request_errors(kind, listed(requests, "candidate_pools") if kind == "candidates" else None)
    if "faults" in requests.columns:
        errors = F.when(F.size("faults") > 0, F.col("faults")).otherwise(errors)
    if "request_id" not in requests.columns:
        return requests.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
    again = (requests.groupBy(F.col("request_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
             .filter("_id IS NOT NULL AND _n > 1"))
    missing = F.when(F.col("request_id").isNull() & ~F.array_contains(F.col("errors"), NO_ID)
                     & ~F.arrays_overlap("errors", F.array(F.lit(UNREADABLE), F.lit(NO_OBJECT))), F.array(F.lit(NO_ID)))
    none = F.array().cast("array<string>")
    repeated = F.when(F.col("_n") > 1, F.array(F.lit("repeated request_id")))
    return (requests.withColumn("errors", errors)
            .join(again, F.col("request_id") == F.col("_id"), "left")
            .withColumn("errors", F.concat("errors", F.coalesce(missing, none), F.coalesce(repeated, none)))
            .drop("_id", "_n").withColumn("valid", F.size("errors") == 0))


def once(requests: DataFrame) -> DataFrame:
    """Requests that can be answered apart: read without faults, with an id that no other row carries."""
    if "faults" in requests.columns:
        kept = requests.filter(F.size("faults") == 0)
    else:
        kept = requests
    single = (requests.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n"))
    return kept.join(single, "request_id", "left_semi").select(*requests.columns)


def asked_pools(requests: DataFrame) -> DataFrame:
    """Valid migration requests: request_id, idcs (the set of sites, sorted),
    and the two pools in one spelling. The rules are those of
    :func:`validate_requests`, here and in the stream."""
    _, p1, i1 = split_pool(F.col("pool1"))
    _, p2, i2 = split_pool(F.col("pool2"))
    checked = validate_requests(requests).filter("valid")
    return checked.select("request_id", F.array_sort(F.array_distinct(listed(requests, "idc"))).alias("idcs"),
                          F.concat(p1, F.lit("/"), i1).alias("lender_key"),
                          F.concat(p2, F.lit("/"), i2).alias("receiver_key"))


def pool_parts(asked: DataFrame) -> DataFrame:
    """One row per (request, pool), the pool's parts as columns of their own."""
    out = asked.withColumn("_pool", F.explode(F.array("lender_key", "receiver_key")))
    _, physical, iaas = split_pool(F.col("_pool"))
    return out.select(*asked.columns, physical.alias("req_physical"), iaas.alias("req_iaas"))


def request_pools(requests: DataFrame) -> DataFrame:
    """Valid migration requests in long form: one row per (request, pool)."""
    return pool_parts(asked_pools(requests))


def request_classes(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (``request_id, idcs, lender_key, receiver_key``) factorised.

    Returns the classes, in the same columns, and ``class_id, request_id`` of
    the members. A class is named by the least id of its members. ``asked``
    is read twice: the caller stores it.
    """
    question = ["lender_key", "receiver_key", "idcs"]
    classes = stored(asked.groupBy(*question).agg(F.min("request_id").alias("class_id")), "request-classes")
    members = asked.join(classes, question).select("class_id", "request_id")
    return classes.withColumnRenamed("class_id", "request_id"), members


def join_pools(rows: DataFrame, requested: DataFrame) -> DataFrame:
    """Rows with every request for their pool (``req_physical``, ``req_iaas``;
    a missing part of a row's pool is named ``nan``) at one of its ``idcs``."""
    def part(c):
        return F.coalesce(F.col(c), F.lit(NULL_PART))
    on = (part("physical_cluster") == F.col("req_physical")) & (part("iaas_cluster") == F.col("req_iaas"))
    j = rows.join(requested, on).drop("req_physical", "req_iaas")
    return j.filter((F.size("idcs") == 0) | F.array_contains("idcs", F.col("idc")))


@dataclass
class BatchMigration:
    detail: DataFrame
    summary: DataFrame
    services: DataFrame


def batch_rows(inv: DataFrame, req_pools: DataFrame) -> DataFrame:
    """Inventory rows attached to every request naming their pool and site."""
    return join_pools(filter_default(inv).withColumn("pool_identifier", pool_key()), req_pools)


def pool_profile(inv: DataFrame, pools: DataFrame, rank_by: str = "last",
                 prefilter: Column | None = None) -> DataFrame:
    """One row per (pool, site, service) of the pools in ``pools``
    (``req_physical, req_iaas``): the lender count and its file position, the
    row count, sums, and whether a package is named. Asked by any number of
    requests, a pool is aggregated once."""
    rows = filter_default(inv)
    if prefilter is not None:
        rows = rows.filter(prefilter)
    n = detail_count()
    rank = {"last": F.max_by(n, "row_ord"), "sum": F.sum(n), "max": F.max(n)}
    if rank_by not in rank:
        raise ValueError(f"rank_by must be 'last', 'sum' or 'max', not {rank_by!r}")
    named = [F.coalesce(F.col(c), F.lit(NULL_PART)).alias(k)
             for c, k in (("physical_cluster", "req_physical"), ("iaas_cluster", "req_iaas"))]
    return (rows.select("*", *named)
            .join(pools.select("req_physical", "req_iaas"), ["req_physical", "req_iaas"], "left_semi")
            .groupBy("req_physical", "req_iaas", "idc", "psm")
            .agg(rank[rank_by].alias("_count"), F.max("row_ord").alias("_last"),
                 F.count(F.lit(1)).alias("_rows"),
                 F.bool_or(F.col("package").isNotNull() & (F.col("package") != "")).alias("_pkg_any"),
                 *[F.sum(zero_if_null(c)).alias(f"_sum_{c}") for c in SUMMARY_MEASURES]))


def class_services(inv: DataFrame, classes: DataFrame, rank_by: str = "last",
                   prefilter: Column | None = None) -> DataFrame:
    """Per (class, service): in which of the two pools it runs at the class's
    sites, the lender count used for ordering, its rows, and the receiver
    pool's sums. Rows without a service keep a line of their own."""
    parts = pool_parts(classes)
    lends = F.concat("req_physical", F.lit("/"), "req_iaas") == F.col("lender_key")
    met = (pool_profile(inv, parts, rank_by, prefilter)
           .join(parts.withColumn("_lends", lends), ["req_physical", "req_iaas"])
           .filter((F.size("idcs") == 0) | F.array_contains("idcs", F.col("idc"))))
    lent = F.when(F.col("_lends"), F.col("_count"))
    rank = {"last": F.max_by("_count", F.when(F.col("_lends"), F.col("_last"))),
            "sum": F.sum(lent), "max": F.max(lent)}[rank_by]
    received = [F.coalesce(F.sum(F.when(~F.col("_lends"), F.col(f"_sum_{c}"))), F.lit(0.0)).alias(f"_sum_{c}")
                for c in SUMMARY_MEASURES]
    return (met.groupBy("request_id", "psm")
            .agg(F.bool_or("_lends").alias("_in_lender"), F.bool_or(~F.col("_lends")).alias("_in_receiver"),
                 F.coalesce(rank, F.lit(0)).cast("bigint").alias("sort_key"),
                 F.sum("_rows").alias("_rows"), F.bool_or("_pkg_any").alias("_pkg_any"), *received))


def service_rows(inv: DataFrame, classes: DataFrame, services: DataFrame) -> DataFrame:
    """Inventory rows with every one of ``services`` (``request_id, psm, _rows``
    and more) that they belong to. Rows are dealt by pool and service, and are
    handed to the classes that ask for them only then: what is shuffled does
    not grow with the number of classes."""
    parts = pool_parts(classes).drop("lender_key", "receiver_key")
    pools = ["req_physical", "req_iaas"]
    named = [F.coalesce(F.col(c), F.lit(NULL_PART)).alias(k) for c, k in zip(("physical_cluster", "iaas_cluster"), pools)]
    # the sites asked for in each pool, null for every site
    asked = parts.select(*[F.col(c).alias(f"_{c}") for c in pools], F.explode_outer("idcs").alias("_site")).distinct()
    here = [F.col(c) == F.col(f"_{c}") for c in pools] + [F.col("_site").isNull() | (F.col("_site") == F.col("idc"))]
    rows = filter_default(inv).select("*", *named, pool_key().alias("pool_identifier")).join(asked, here, "left_semi")
    met = join_per_key(rows, services.join(parts, "request_id"), [*pools, "psm"], "_rows", hot_by=["psm"])
    return met.filter((F.size("idcs") == 0) | F.array_contains("idcs", F.col("idc"))).drop("_rows", "idcs", *pools)


IN_BOTH = "psm IS NOT NULL AND _in_lender AND _in_receiver"


def migration_batch(inv: DataFrame, requests: DataFrame, rank_by: str = "last",
                    group: str = "request_id", ordered: bool = False,
                    keep_row_ord: bool = False, materialize: bool = False,
                    prefilter: Column | None = None) -> BatchMigration:
    """Answer every valid request at once. Output keys are prefixed by ``group``.

    Everything up to the sums runs per class of equal requests; members get
    their class's rows last. The package column is kept in both outputs;
    whether package is a summary key is decided per request by the same data
    rule as the single analysis.
    ``materialize`` writes the matched rows (shared by both outputs) into
    the shared scratch folder once. ``prefilter`` is a filter on inventory
    columns that the requests imply and the caller knows (pools and sites
    given as arguments); it only spares reading rows the join would drop.
    """
    if group != "request_id":
        requests = requests.withColumnRenamed(group, "request_id")
    classes, members = request_classes(stored(asked_pools(requests), "asked-pools"))
    # One row per (class, service), read three times below (hot keys, gate,
    # join keys) with different columns: written once so the rows are
    # aggregated once and the lineage is cut.
    services = stored(class_services(inv, classes, rank_by, prefilter).filter(IN_BOTH)
                      .select("request_id", "psm", "sort_key", "_rows", "_pkg_any"), "class-services")
    # Package gate per class, from the per-service table: one row per
    # class (AQE splits a class that most services belong to).
    gate = stored(services.groupBy("request_id").agg(F.bool_or("_pkg_any").alias("_pkg")), "class-packages")
    services = services.join(gate, "request_id").drop("_pkg_any")
    joined = service_rows(inv if prefilter is None else inv.filter(prefilter), classes, services)
    if materialize:
        joined = stored(joined.select("request_id", *DETAIL_COLUMNS, "row_ord", "sort_key", "_pkg"), "matched-rows")
    detail = joined.select(*detail_columns(True, True, prefix=[F.col("request_id")]),
                             "row_ord")
    summary_rows = (joined.filter(~F.col("_pkg") | F.col("package").isNotNull())
                    .withColumn("package", F.when(F.col("_pkg"), F.col("package"))))
    summary = summarise(summary_rows, True, keep_null_package=True, group=["request_id"])

    def of_members(answers: DataFrame) -> DataFrame:
        columns = [F.col(c) if c != "request_id" else F.col("_member").alias(group) for c in answers.columns]
        given = members.select(F.col("class_id").alias("_class"), F.col("request_id").alias("_member"))
        return answers.join(given, F.col("request_id") == F.col("_class")).select(*columns)

    detail, summary, services = (of_members(x) for x in (detail, summary, services.drop("_rows", "_pkg")))
    if ordered:
        detail = order_detail(detail, group=[group])
        summary = order_summary(summary, True, group=[group])
    return BatchMigration(detail if keep_row_ord else detail.drop("row_ord"), summary, services)

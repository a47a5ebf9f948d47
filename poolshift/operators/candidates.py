"""One lender pool against many candidate receiver pools.

Each candidate is the migration question (target -> candidate); all of them
run as one batch plan keyed by ``candidate_pool``. Pool totals come from one
``groupBy(pool_identifier)`` over the rows of the pools involved.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import (BLANKS, POOL_SEP, in_list_or_all, normal_pool, parse_pool_text,
                               pool_key, split_pool)
from ..session import stored
from .batch import IN_BOTH, class_services, listed, migration_batch, once, request_classes
from .filters import filter_by_idc, filter_default, pools_predicate
from .migration import SUMMARY_MEASURES, zero_if_null

ROWS_PER_CANDIDATE = 10


def one_spelling(pool: str | None) -> str:
    """Driver-side :func:`normal_pool`: no blanks around the parts of a pair."""
    text = (pool or "").strip(BLANKS)
    parts = text.split(POOL_SEP)
    return POOL_SEP.join(p.strip(BLANKS) for p in parts) if len(parts) == 2 else text


def candidate_list(text: str | Iterable[str], target: str | None = None) -> list[str]:
    """Driver-side form of a candidate argument: each in one spelling, blanks
    dropped, duplicates dropped (first kept), the target itself removed."""
    items = text.split(",") if isinstance(text, str) else list(text)
    out: list[str] = []
    for it in map(one_spelling, items):
        if it and it not in out and it != one_spelling(target):
            out.append(it)
    return out


def candidates_column(text: Column, target: Column | None = None) -> Column:
    """Column form: comma text -> distinct non-empty pools in one spelling, without the target."""
    items = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), normal_pool),
                     lambda x: x != "")
    items = F.array_distinct(items)
    if target is not None:
        items = F.array_remove(items, normal_pool(target))
    return items


@dataclass
class CandidateComparison:
    overview: DataFrame
    summary: DataFrame
    detail: DataFrame
    matches: DataFrame
    pool_stats: DataFrame
    counts: DataFrame


def pool_stats(inv: DataFrame, pools: DataFrame, idc=None,
               prefilter: Column | None = None) -> DataFrame:
    """Totals of every pool listed in ``pools`` (column ``pool_identifier``):
    services, instances, CPU and memory over default clusters at the sites.
    ``prefilter``: a caller-known filter on the listed pools (small list)."""
    keys = pools.select("pool_identifier").distinct()
    rows = filter_default(filter_by_idc(inv, idc))
    if prefilter is not None:
        rows = rows.filter(prefilter)
    return (rows.withColumn("pool_identifier", pool_key()).join(keys, "pool_identifier")
            .groupBy("pool_identifier")
            .agg(F.count_distinct("psm").cast("bigint").alias("psm_count"),
                 F.sum(zero_if_null("instance_num")).alias("total_instances"),
                 F.sum(zero_if_null("cpu_limit")).alias("total_cpu"),
                 F.sum(zero_if_null("mem_limit")).alias("total_memory")))


def compare_candidates(inv: DataFrame, target: str, candidates: str | Iterable[str],
                       idc=None, ordered: bool = True) -> CandidateComparison:
    """Run the migration analysis of ``target`` against each candidate pool."""
    spark: SparkSession = inv.sparkSession
    tkey = "/".join(parse_pool_text(target, bare="error"))
    cands = candidate_list(candidates, tkey)
    idc_text = idc if isinstance(idc, str) or idc is None else ",".join(idc)
    req = spark.createDataFrame(
        [(c, idc_text or "", tkey, c, i) for i, c in enumerate(cands)],
        "candidate_pool string, idc string, pool1 string, pool2 string, position int")
    # the pools and sites are known here: filter the scan without a lookup job
    pairs = [parse_pool_text(tkey)] + [parse_pool_text(c) for c in cands
                                       if len(c.strip().split("/")) == 2]
    known = pools_predicate(pairs) & in_list_or_all("idc", idc)
    return compare_candidate_table(inv, req, tkey, idc, ordered, known)


def compare_candidate_table(inv: DataFrame, req: DataFrame, tkey: str, idc=None,
                            ordered: bool = True, prefilter: Column | None = None
                            ) -> CandidateComparison:
    """Like :func:`compare_candidates` with the candidates given as a table
    (``candidate_pool, idc, pool1, pool2, position``); ``prefilter`` is an
    optional filter implied by the target, candidates and sites."""
    b = migration_batch(inv, req.withColumnRenamed("candidate_pool", "request_id")
                        .select("request_id", "idc", "pool1", "pool2"), keep_row_ord=True,
                        prefilter=prefilter)
    detail = b.detail.withColumnRenamed("request_id", "candidate_pool")
    summary = b.summary.withColumnRenamed("request_id", "candidate_pool")
    matches = b.services.withColumnRenamed("request_id", "candidate_pool")

    pools = req.select(F.col("candidate_pool").alias("pool_identifier")).unionByName(
        req.select(F.lit(tkey).alias("pool_identifier")))
    pstats = pool_stats(inv, pools, idc, prefilter)
    matched = matches.groupBy("candidate_pool").agg(
        F.count(F.lit(1)).cast("bigint").alias("matching_psm_count"))
    overview = (req.select("candidate_pool", "position")
                .join(matched, "candidate_pool", "left")
                .join(pstats.withColumnRenamed("pool_identifier", "candidate_pool"),
                      "candidate_pool", "left")
                .select("candidate_pool",
                        (F.coalesce("matching_psm_count", F.lit(0)) > 0).alias("has_matches"),
                        F.coalesce("matching_psm_count", F.lit(0)).cast("bigint")
                        .alias("matching_psm_count"),
                        F.coalesce("psm_count", F.lit(0)).cast("bigint").alias("psm_count"),
                        F.coalesce("total_instances", F.lit(0.0)).alias("total_instances"),
                        F.coalesce("total_cpu", F.lit(0.0)).alias("total_cpu"),
                        F.coalesce("total_memory", F.lit(0.0)).alias("total_memory")))
    counts = overview.agg(F.count(F.lit(1)).cast("bigint").alias("candidates"),
                          F.count_if("has_matches").cast("bigint").alias("matched"),
                          F.count_if(~F.col("has_matches")).cast("bigint").alias("unmatched"))
    pstats = pstats.withColumn(
        "role", F.when(F.col("pool_identifier") == tkey, "target").otherwise("candidate"))
    if ordered:
        overview = order_overview(overview)
    return CandidateComparison(overview, summary, detail, matches, pstats, counts)


def order_overview(overview: DataFrame) -> DataFrame:
    """Most matched services first, then by pool name."""
    return overview.orderBy(F.col("matching_psm_count").desc(), F.col("candidate_pool").asc())


def detail_top(detail: DataFrame, n: int = ROWS_PER_CANDIDATE) -> DataFrame:
    """First ``n`` detail rows of every candidate in detail order.

    ``row_number() <= n`` over a per-candidate window: Spark keeps at most
    ``n`` rows per candidate in every task before the shuffle
    (``WindowGroupLimit``), so even a candidate holding most of the detail
    moves only ``n`` rows per task.
    """
    w = Window.partitionBy("candidate_pool").orderBy(
        F.col("sort_key").desc(), F.col("psm").asc(), F.col("pool_identifier").asc(),
        F.col("row_ord").asc())
    return (detail.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= n))


def candidate_questions(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates of every request that can be answered (``request_id,
    lender_key, idcs, position, receiver_key``), and the classes of equal
    questions among them (see ``batch.request_classes``). Bodies are read once."""
    requests = stored(requests, "requests")
    ok, p, i = split_pool(F.col("target_pool"))
    target = F.concat(p, F.lit("/"), i)
    pools = F.filter(F.transform(listed(requests, "candidate_pools"), normal_pool), lambda x: x != "")
    cands = stored(once(requests).filter(ok)
                   .select("request_id", target.alias("lender_key"),
                           F.array_sort(F.array_distinct(listed(requests, "idc"))).alias("idcs"),
                           F.posexplode(F.array_remove(F.array_distinct(pools), target)).alias("position", "receiver_key")),
                   "candidates")
    # numbered by request and place: the id of the question
    sub_id = F.concat_ws("#", "request_id", F.col("position").cast("string"))
    asked = cands.filter(split_pool(F.col("receiver_key"))[0]).select(
        sub_id.alias("request_id"), "idcs", "lender_key", "receiver_key")
    return cands, request_classes(asked)[0]


def with_answers(cands: DataFrame, classes: DataFrame, answers: DataFrame) -> DataFrame:
    """Candidates with their class's row of ``answers`` (by ``request_id``), null where it has none."""
    known = stored(answers.join(classes, "request_id").drop("request_id"), "class-answers")
    return cands.join(known, ["lender_key", "receiver_key", "idcs"], "left")


def candidate_batch(inv: DataFrame, requests: DataFrame) -> DataFrame:
    """The candidate overview for every request (``request_id, idc,
    target_pool, candidate_pools``): one row per (request, candidate) with
    the matched-service count and the candidate pool's totals at the
    request's sites.

    Candidates are parsed per request (one spelling each, blanks and
    duplicates dropped, the target removed) and exploded; equal (target,
    candidate, sites) are evaluated once, and one aggregate over the profile
    of the pools gives both the matches and the candidate's totals.
    """
    cands, classes = candidate_questions(requests)
    names = ["total_instances", "total_cpu", "total_memory"]
    answers = (class_services(inv, classes).groupBy("request_id")
               .agg(F.count_if(F.expr(IN_BOTH)).alias("matching_psm_count"),
                    F.count_if(F.expr("psm IS NOT NULL AND _in_receiver")).alias("psm_count"),
                    *[F.sum(f"_sum_{c}").alias(name) for c, name in zip(SUMMARY_MEASURES, names)]))
    matches = F.coalesce("matching_psm_count", F.lit(0)).cast("bigint")
    return (with_answers(cands, classes, answers)
            .select("request_id", F.col("receiver_key").alias("candidate_pool"), "position",
                    (matches > 0).alias("has_matches"), matches.alias("matching_psm_count"),
                    F.coalesce("psm_count", F.lit(0)).cast("bigint").alias("psm_count"),
                    *[F.coalesce(name, F.lit(0.0)).alias(name) for name in names]))

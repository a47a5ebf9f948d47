"""Services that pools have in common, from bitmaps.

Every service gets a dense number; the services of a pool at a site are then
one bitmap per block of 32,768 numbers. A question (two pools, a set of
sites) is answered by OR over the sites and AND over the pools, block by
block: what is shuffled per pool, site and block is 4 KB at most, however many
rows and services stand behind it, and blocks of a large pool are apart. Rows
are read once, to build the bitmaps; services or rows are only needed again
for the matches that somebody wants listed (:func:`shared_services`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import NULL_PART
from ..session import shuffle_tasks, stored
from .batch import pool_parts
from .candidates import candidate_questions, with_answers
from .filters import filter_default


def dense_ids(values: DataFrame, column: str) -> DataFrame:
    """``column``, ``id``: the distinct non-null values numbered from 1 in their order.

    Ranges of values are counted apart and the counts added up, so no task
    sees more than its range.
    """
    tasks = shuffle_tasks(values.sparkSession)
    ranged = stored(values.select(column).where(F.col(column).isNotNull()).distinct()
                    .repartitionByRange(tasks, column).withColumn("_range", F.spark_partition_id()), "ranges")
    front = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for a range
    offsets = (ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
               .select("_range", F.coalesce(F.sum("_rows").over(front), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("_range").orderBy(column)
    return (ranged.join(offsets, "_range")
            .select(column, (F.col("_before") + F.row_number().over(inside)).cast("bigint").alias("id")))


def pool_bitmaps(inv: DataFrame, ids: DataFrame) -> DataFrame:
    """``req_physical, req_iaas, idc, block, bits`` of the default clusters' rows; ``ids`` numbers the services."""
    named = [F.coalesce(F.col(c), F.lit(NULL_PART)).alias(k)
             for c, k in (("physical_cluster", "req_physical"), ("iaas_cluster", "req_iaas"))]
    seen = filter_default(inv).where(F.col("psm").isNotNull()).select(*named, "idc", "psm").distinct()
    keys = ["req_physical", "req_iaas", "idc", "block"]
    bits = seen.join(ids, "psm").select(*keys[:3], F.bitmap_bucket_number("id").alias("block"), F.bitmap_bit_position("id").alias("bit"))
    # a bitmap's rows, 32,768 at most, come to one task: were every task to begin
    # all bitmaps, as many would be shuffled as there are tasks and bitmaps
    return (bits.repartition(shuffle_tasks(inv.sparkSession), *keys).groupBy(*keys)
            .agg(F.bitmap_construct_agg("bit").alias("bits")))


def class_bitmaps(bitmaps: DataFrame, classes: DataFrame) -> DataFrame:
    """``request_id, block``, ``lent`` and ``received``: the bits of both pools of each class over its sites (null where a pool has none)."""
    parts = pool_parts(classes)
    lends = F.concat("req_physical", F.lit("/"), "req_iaas") == F.col("lender_key")
    met = (bitmaps.join(parts.withColumn("_lends", lends), ["req_physical", "req_iaas"])
           .filter((F.size("idcs") == 0) | F.array_contains("idcs", F.col("idc"))))
    side = met.groupBy("request_id", "block", "_lends").agg(F.bitmap_or_agg("bits").alias("bits"))
    return side.groupBy("request_id", "block").agg(F.first(F.when(F.col("_lends"), F.col("bits")), ignorenulls=True).alias("lent"),
                                                   F.first(F.when(~F.col("_lends"), F.col("bits")), ignorenulls=True).alias("received"),
                                                   F.bitmap_and_agg("bits").alias("both"))


def class_counts(blocks: DataFrame) -> DataFrame:
    """``request_id``, services of the lender, of the receiver, and of both."""
    def total(bits):
        return F.coalesce(F.sum(F.bitmap_count(bits)), F.lit(0)).cast("bigint")

    both = F.when(F.col("lent").isNotNull() & F.col("received").isNotNull(), F.col("both"))
    return blocks.groupBy("request_id").agg(total(F.col("lent")).alias("target_psm_count"), total(F.col("received")).alias("psm_count"),
                                            total(both).alias("matching_psm_count"))


def shared_services(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """``request_id, psm`` of the services in both pools: set bits turned back to names."""
    shared = blocks.where("lent is not null and received is not null and bitmap_count(both) > 0")
    byte = F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("both")),
                                    lambda i: F.conv(F.hex(F.substring("both", i, F.lit(1))), 16, 10).cast("int"))).alias("at", "byte")
    bits = shared.select("request_id", "block", byte).where("byte > 0").select(
        "request_id", "block", "at", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    held = bits.where(F.expr("(byte >> bit) & 1 = 1"))
    return (held.select("request_id", ((F.col("block") - 1) * 32768 + F.col("at") * 8 + F.col("bit") + 1).cast("bigint").alias("id"))
            .join(ids, "id").select("request_id", "psm"))


def candidate_overlap(inv: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request and candidate the services of target, candidate and both, from bitmaps alone.

    Requests and candidates are read as in ``candidates.candidate_batch``.
    """
    cands, classes = candidate_questions(requests)
    counts = class_counts(class_bitmaps(pool_bitmaps(inv, dense_ids(inv, "psm")), classes))
    names = ["target_psm_count", "psm_count", "matching_psm_count"]
    return (with_answers(cands, classes, counts)
            .select("request_id", F.col("receiver_key").alias("candidate_pool"), "position",
                    *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names]))

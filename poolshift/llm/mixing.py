"""Mixing sources to target weights by a low-discrepancy schedule.

The mix holds as many words as all documents. It is cut into slots of
``block`` words; slot k sits at the golden-ratio point ``k * A mod 2**bits``
and goes to the source whose interval of cumulative targets holds that point.
A source's slots are ranked; slot r reads block ``r mod blocks`` of the
source's documents, laid end to end in a fixed shuffle and cut into blocks of
equally many words, in pass ``r div blocks``. Slots join blocks on (source,
block). The points leave a source a few slots over or short of its target
(the discrepancy, of the order of log(slots)): those over are dropped, the
last is trimmed, those short are added at golden-ratio places, so a source
gives its target, rounded to the word, whatever its size.

Targets: source i of weight w_i and size s_i takes min(lambda * w_i, 3 * s_i)
where lambda makes the sum the size of all documents. Lambda is found by
resharing the excess until no source is above; each round is one aggregate
over the table of sources, of which the driver sees the two sums.

``block`` is ``total >> 18`` words, at least 1 and at most 4096, so a small
table is mixed as finely as a large one. Points and intervals meet on buckets
of 2**13 neighbouring points; nothing is broadcast that Spark's planner does
not find small.

Defined cases: a null or empty text has no words and is taken 0 times; a null
doc_id is shuffled as the text ``null``; repeated rows are rows of their own;
rows that share a doc_id are ordered by size; a source without words has
target 0; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import laid_out
from .text import written

WEIGHTS = (5, 2, 1)
MOST = 3
GOLDEN = (math.sqrt(5) - 1) / 2
SLOTS_BITS = 18
MAX_BLOCK = 4096
BUCKET_BITS = 13


def words_of(text: Column) -> Column:
    """Number of maximal runs of characters other than space and \\t\\n\\v\\f\\r (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with src (rank by code point, null last), weight and target."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    # laid_out has nulls first; ranked on a flag ahead of the name, they come last
    keyed = sources.select(F.lit(0).alias("all"), F.col("source").isNull().alias("unnamed"), "source", "source_size")
    ranked = laid_out(keyed, "all", ["unnamed", "source"])
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", F.col("rank").alias("src"), weight.alias("weight")), "mix-sources")
    share, capped = 0.0, -1
    while True:
        above = most * F.col("source_size") <= F.lit(share) * F.col("weight")
        full, free, n = ranked.agg(F.sum(F.when(above, most * F.col("source_size")).otherwise(0)),
                                   F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.count_if(above)).first()
        if n == capped or not free:
            break
        capped, share = n, (total - full) / free
    return ranked.withColumn("target", F.least(F.lit(share) * F.col("weight"), F.lit(float(most)) * F.col("source_size")))


def block_words(total: int) -> int:
    return min(MAX_BLOCK, max(1, total >> SLOTS_BITS))


def golden_points(spark, slots: int, bits: int) -> DataFrame:
    """slot, point: ``slot * A mod 2**bits`` with A the odd number next to the golden share; all points differ."""
    a = int(GOLDEN * (1 << bits)) | 1
    mask = (1 << bits) - 1
    k = F.col("id")
    # in two halves, so that no product leaves 64 bits while bits <= 47
    high = F.shiftleft((k * (a >> 16)).bitwiseAND(mask >> 16 if bits > 16 else 0), 16)
    return spark.range(slots).select(k.alias("slot"), (high + k * (a & 0xFFFF)).bitwiseAND(mask).alias("point"))


def schedule(shares: DataFrame, total: int, block: int) -> DataFrame:
    """Slots of the mix: at (place in the mix), src, rank, pass, block, words (from the block's start).

    ``shares`` has src, source_size and target, and covers ``total`` words.
    """
    spark = shares.sparkSession
    slots = -(-total // block)
    bits = max(1, (slots - 1).bit_length())
    want = F.floor(F.col("target") + 0.5).cast("long")
    shares = shares.withColumn("want", F.least(want, MOST * F.col("source_size"))).where("want > 0")
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    rest = F.col("want") % F.col("source_size")
    shares = (shares.withColumn("blocks", blocks).withColumn("rest", rest)
              .withColumn("needed", F.expr("want div source_size") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long")))
    # cumulative targets as points: the sums are exact, and the end of one interval is the same number as the start of the next
    laid = laid_out(shares.select(F.lit(0).alias("all"), "src", "want", "source_size", "blocks", "rest", "needed"), "all", ["src"], "want")

    def at_point(words):
        return F.floor(words.cast("double") / F.col("total") * float(1 << bits)).cast("long")

    low, high = at_point(F.col("before")), at_point(F.col("before") + F.col("want"))
    shares = written(laid.select("src", "source_size", "blocks", "rest", "needed", low.alias("low"), high.alias("high")), "mix-shares")

    near = F.shiftright("low", BUCKET_BITS), F.shiftright(F.col("high") - 1, BUCKET_BITS)
    spans = shares.where("high > low").select("src", "needed", "low", "high", F.explode(F.sequence(*near)).alias("bucket"))
    points = golden_points(spark, slots, bits).withColumn("near", F.shiftright("point", BUCKET_BITS))
    hit = points.join(spans, (F.col("near") == F.col("bucket")) & (F.col("low") <= F.col("point")) & (F.col("point") < F.col("high")))
    ranked = written(laid_out(hit.select("src", "slot"), "src", ["slot"]).select("src", "slot", "rank", "n"), "mix-slots")
    given = ranked.groupBy("src").agg(F.max("n").alias("given"))
    short = (shares.join(given, "src", "left").withColumn("given", F.coalesce("given", F.lit(0).cast("long"))).where("given < needed")
             .select("src", F.explode(F.sequence(F.col("given"), F.col("needed") - 1)).alias("rank"))
             .withColumn("at", F.pmod((F.col("rank") + 1) * GOLDEN + F.col("src") * GOLDEN, F.lit(1.0)) * slots))
    placed = ranked.select("src", "rank", F.col("slot").cast("double").alias("at")).unionByName(short)
    full = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block)
    last = F.expr("source_size > 0 and rank div blocks = (needed - 1) div blocks and rest > 0")
    return (placed.join(shares.select("src", "source_size", "blocks", "rest", "needed"), "src").where("rank < needed")
            .withColumn("pass", F.expr("rank div blocks")).withColumn("block", F.col("rank") % F.col("blocks"))
            .withColumn("words", F.when(last, F.least(full, F.col("rest") - F.col("block") * block)).otherwise(full))
            .select("at", "src", "rank", "pass", "block", "words"))


def shuffled(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size with rank, before and total in the source's fixed shuffle."""
    sized = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"))
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    # written first: the ranges are found by a pass of their own, which must not read the texts again
    return laid_out(written(sized.withColumn("mix_key", key), "mix-sizes"), "source", ["mix_key", "doc_id", "size"], "size").drop("mix_key")


def mix(docs: DataFrame, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The documents laid out, with their source's src, source_size and target, and the pieces of the mix:

    at, src, pass, before (which names the document in its source), doc_id, first (word of the document, from 0) and taken (words).
    """
    laid = written(shuffled(docs, seed), "mix-laid")
    sources = laid.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = written(targets(sources), "mix-targets")
    total = shares.agg(F.sum("source_size")).first()[0] or 0
    rows = (laid.join(shares.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
            .select("doc_id", "source", "size", "before", "src", "source_size", "target"))
    block = block_words(total)
    touched = F.sequence(F.expr(f"before div {block}L"), F.expr(f"(before + size - 1) div {block}L"))
    pieces = rows.where("size > 0").select("doc_id", "src", "before", "size", F.explode(touched).alias("block"))
    start = F.col("block") * block
    low, high = F.greatest(F.col("before"), start), F.least(F.col("before") + F.col("size"), start + F.col("words"))
    taken = (schedule(shares, total, block).join(pieces, ["src", "block"]).where(low < high)
             .select("at", "src", "pass", "before", "doc_id", (low - F.col("before")).alias("first"), (high - low).alias("taken")))
    return rows, taken


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target and taken, the words of the document that the mix takes, repeats counted."""
    rows, pieces = mix(docs, seed)
    # documents with words have starts of their own within a source
    taken = pieces.groupBy("src", F.col("before").alias("start")).agg(F.sum("taken").alias("taken")).withColumnRenamed("src", "of")
    met = rows.where("size > 0").join(taken, (F.col("src") == F.col("of")) & (F.col("before") == F.col("start")), "left").drop("of", "start")
    none = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return met.unionByName(none).select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))

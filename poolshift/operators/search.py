"""Search by a trigram index.

A table to be searched is written in pages (see ``results.write_pages``); runs
of ``block_rows`` rows of it are blocks. The index holds for each trigram of
the rows' search text the set of blocks it occurs in, as one bitmap per 32,768
blocks. A search intersects the bitmaps of its words' trigrams, reads the
blocks that are left by a pushed-down test on the rank, and tests the words on
the text of their rows, so its answer is that of ``filters.search_rows`` for
any text. Words under three letters have no trigram and narrow nothing; if
there is no other word, every block is read.

Both tables are written by Spark. Searched values are dealt by ranges of
blocks, once; there the distinct values of a block are taken apart, and the
distinct trigrams of a block become bitmaps, before anything is shuffled
again. A range lies in one run of 32,768 blocks or two, so it sends a bitmap or
two for each of its trigrams, of a fixed size whatever the number of rows.
Words hold no blanks, so none goes from one column to the next: columns are
taken apart by themselves, and trigrams with a blank are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import all_words_present, search_text
from .results import write_pages

BLOCK_ROWS = 4096
GRAM = 3
RANK = "page_rank"
# Runs of blocks that a scan is given as tests on the rank; more runs are
# joined over the narrowest gaps, which are read in vain.
RUNS = 64
# Blocks named to a scan; a search that leaves more reads by a join instead.
NAMED_BLOCKS = 1 << 16


def grams(text: Column) -> Column:
    """Distinct trigrams of a text; none for a shorter one."""
    each = F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.substr(text, i, F.lit(GRAM)))
    return F.when(F.length(text) >= GRAM, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def write_search_table(df: DataFrame, path: str, order_by: list[str], columns: list[str] | None = None,
                       tiebreak: str | None = None, block_rows: int = BLOCK_ROWS) -> None:
    """Write ``df`` in pages under ``path/rows`` and its index next to them.

    ``columns`` are those that are searched (all of ``df`` if None); null
    values are empty text, as in ``filters.search_rows``.
    """
    if RANK in df.columns:
        raise ValueError(f"column {RANK} is the table's own")
    spark, columns = df.sparkSession, list(columns or df.columns)
    write_pages(df, f"{path}/rows", order_by, tiebreak=tiebreak, rank=RANK)
    values = F.array_distinct(F.array(*[search_text([c]) for c in columns]))
    blocks = (spark.read.parquet(f"{path}/rows")
              .select(F.floor(F.col(RANK) / block_rows).alias("block"), values.alias("values"))
              .repartitionByRange("block")
              .select("block", F.explode("values").alias("value")).distinct()
              .select("block", F.explode(grams(F.col("value"))).alias("gram"))
              .filter(~F.col("gram").contains(" ")).distinct())
    number = F.col("block") + 1  # bitmaps count from 1
    (blocks.groupBy("gram", F.bitmap_bucket_number(number).alias("bucket"))
     .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("blocks"))
     .repartitionByRange("gram", "bucket").sortWithinPartitions("gram", "bucket").write.parquet(f"{path}/grams"))
    # written last: a search table without it is not complete
    (spark.range(1).select(F.array(*map(F.lit, columns)).alias("columns"), F.lit(block_rows).cast("bigint").alias("block_rows"))
     .write.parquet(f"{path}/spec"))


def candidate_blocks(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """Blocks (``block``) that hold every trigram of every word of ``text``;
    None if it has no word of three letters or more."""
    wanted = sorted({w[i:i + GRAM] for w in text.lower().split() for i in range(len(w) - GRAM + 1)})
    if not wanted:
        return None
    both = (spark.read.parquet(f"{path}/grams").filter(F.col("gram").isin(wanted)).groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("n"), F.bitmap_and_agg("blocks").alias("blocks"))
            .filter((F.col("n") == len(wanted)) & (F.bitmap_count("blocks") > 0)))
    return (both.select("bucket", F.explode(_ones("blocks")).alias("at"))
            .select(((F.col("bucket") - 1) * 32768 + F.col("at")).cast("bigint").alias("block")))


def _ones(bitmap: str) -> Column:
    """Positions of the bits of a bitmap that are set (the lowest bit of a byte first)."""
    digits = F.hex(F.col(bitmap))
    byte = F.transform(F.sequence(F.lit(0), F.octet_length(F.col(bitmap)) - 1), lambda i: F.struct(
        i.alias("at"), F.conv(F.substr(digits, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int").alias("bits")))
    held = F.filter(byte, lambda b: b["bits"] > 0)
    return F.flatten(F.transform(held, lambda b: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(b["bits"], k) == 1),
        lambda k: b["at"] * 8 + k)))


def _runs(blocks: list[int], most: int = RUNS) -> list[tuple[int, int]]:
    """Ascending blocks as at most ``most`` runs (first, last) that hold them all."""
    gaps = sorted(((b - a, b) for a, b in zip(blocks, blocks[1:]) if b - a > 1), reverse=True)[:most - 1]
    starts = sorted([blocks[0], *(b for _, b in gaps)])
    before = dict(zip(blocks[1:], blocks))
    return list(zip(starts, [*(before[s] for s in starts[1:]), blocks[-1]]))


def search_table(spark: SparkSession, path: str, text: str) -> DataFrame:
    """Rows of a search table in which every word of ``text`` occurs
    (case-insensitive, in any searched column), with their rank."""
    spec = spark.read.parquet(f"{path}/spec").first()
    rows, size = spark.read.parquet(f"{path}/rows"), spec["block_rows"]
    found = candidate_blocks(spark, path, text)
    if found is not None:
        named = sorted(r["block"] for r in found.limit(NAMED_BLOCKS + 1).collect())
        if not named:
            rows = rows.filter(F.lit(False))
        elif len(named) <= NAMED_BLOCKS:
            test = F.lit(False)
            for first, last in _runs(named):
                test = test | ((F.col(RANK) >= first * size) & (F.col(RANK) < (last + 1) * size))
            rows = rows.filter(test)
        else:
            at = F.floor(F.col(RANK) / size)
            rows = rows.join(found, at == F.col("block"), "left_semi")
    return rows.filter(all_words_present(spec["columns"], text))

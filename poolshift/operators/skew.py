"""Joining per-key results back to rows when some keys are hot.

The analyses compute one row per key (a service, a request and service)
with a partially aggregated ``groupBy`` -- safe under skew -- and then need
that row on every input row of the key. A plain shuffle join would send all
rows of a hot key to one task. Here every key whose row count exceeds
``rows_per_task`` is split: its rows get a salt from a hash of a unique row
column, and its per-key row is repeated once per salt value, so the key's
rows spread over ``ceil(count / rows_per_task)`` tasks.

The table of hot keys is broadcast. Its size is bounded by construction:
at most ``total_rows / rows_per_task`` keys can exceed the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 2_000_000
# Session setting that overrides the threshold (e.g. smaller executors).
ROWS_PER_TASK_CONF = "poolshift.skew.rowsPerTask"


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str], count_col: str,
                 salt_source: str = "row_ord", rows_per_task: int | None = None,
                 hot_by: list[str] | None = None) -> DataFrame:
    """``rows JOIN per_key USING (keys)`` with hot keys split over several tasks.

    ``per_key`` has one row per key and ``count_col`` = the number of rows of
    that key in ``rows``; ``salt_source`` is a column unique per row. With
    ``hot_by``, some of the keys, ``per_key`` may hold a key several times:
    keys that agree in ``hot_by`` are split alike, by their largest count.
    """
    if rows_per_task is None:
        rows_per_task = int(rows.sparkSession.conf.get(ROWS_PER_TASK_CONF, str(ROWS_PER_TASK)))
    parts = F.greatest(F.ceil(F.col(count_col) / F.lit(rows_per_task)), F.lit(1)).cast("int")
    hot = (per_key.filter(F.col(count_col) > rows_per_task)
           .select(*keys, parts.alias("_parts")))
    if hot_by:
        hot = hot.groupBy(*hot_by).agg(F.max("_parts").alias("_parts"))
        per_key = per_key.join(F.broadcast(hot), hot_by, "left")
        parts = F.coalesce(F.col("_parts"), F.lit(1))
    salted_rows = (rows.join(F.broadcast(hot), hot_by or keys, "left")
                   .withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_source)),
                                               F.coalesce(F.col("_parts"), F.lit(1))).cast("int"))
                   .drop("_parts"))
    salted_keys = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return salted_rows.join(salted_keys, keys + ["_salt"]).drop("_salt")

"""Labelled rows shared by the classifiers: held-out rule and bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(folds: int, fold: int) -> Column:
    """crc32 of the doc_id as text, mod ``folds``, equals ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_ids(labels: DataFrame, label: str, folds: int, fold: int, per_class: int) -> DataFrame:
    """(doc_id, label, weight) of at most ``per_class`` rows of each class, none held out.

    ``weight`` is the number of usable rows of the class for each row taken, so
    the weighed sample has the class mix of the whole table at any size.

    Rows are taken in the order of a hash of the id, so the sample does not
    depend on layout. An id labelled more than once takes part if its labels
    agree; null ids and labels do not take part.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(folds, fold))
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
             .where("label = other").drop("other"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
             .withColumn("weight", F.lit(max(1.0, totals.get(v, 0) / per_class))) for v in (0, 1)]
    return parts[0].unionByName(parts[1])

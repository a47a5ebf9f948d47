"""Row filters over the typed inventory."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import (DEFAULT_CLUSTER, NULL_PART, all_words_present,
                               in_list_or_all, pool_key)


def filter_by_idc(df: DataFrame, idc: Iterable[str] | str | None) -> DataFrame:
    """Sites in a list (or one site); ``None`` or empty keeps every row."""
    return df.filter(in_list_or_all("idc", idc))


def filter_default(df: DataFrame) -> DataFrame:
    """Only clusters named ``default``."""
    return df.filter(F.col("cluster_name") == DEFAULT_CLUSTER)


def with_pool_key(df: DataFrame, name: str = "pool_key") -> DataFrame:
    return df.withColumn(name, pool_key())


def pools_predicate(pools: list[tuple[str, str | None]]):
    """Rows in any of the given ``(physical, iaas)`` pools.

    Besides the test on the combined key, the implied tests on the two
    parts are added when no part is the null marker: they reach the scan
    (and the dimension a part comes from) where the combined key cannot.
    """
    keys = [f"{p}/{i}" for p, i in pools if i is not None]
    cond = None
    if keys:
        cond = pool_key().isin(keys)
    parts_ok = all(p != NULL_PART and (i is None or i != NULL_PART) for p, i in pools)
    if parts_ok:
        phys = in_list_or_all("physical_cluster", sorted({p for p, _ in pools}))
        cond = phys if cond is None else cond & phys
        iaas = {i for _, i in pools}
        if None not in iaas:
            cond = cond & in_list_or_all("iaas_cluster", sorted(iaas))
    return cond if cond is not None else F.lit(True)


def filter_pool(df: DataFrame, physical: str, iaas: str | None) -> DataFrame:
    """Exact pool; ``iaas=None`` means any iaas cluster of that physical cluster."""
    cond = F.col("physical_cluster") == physical
    if iaas is not None:
        cond = cond & (F.col("iaas_cluster") == iaas)
    return df.filter(cond)


def search_rows(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Global search: every word of ``text`` occurs (case-insensitive) in some column."""
    cols = columns or [c for c in df.columns]
    return df.filter(all_words_present(cols, text))


def filter_other_pools(df: DataFrame, text: str, column: str = "other_pools") -> DataFrame:
    """Rows whose other-pools list mentions ``text`` (case-insensitive)."""
    needle = text.lower()
    dt = df.schema[column].dataType.typeName()
    if dt == "array":
        hay = F.lower(F.array_join(F.col(column), ", "))
    else:
        hay = F.lower(F.col(column))
    return df.filter(hay.contains(needle))

"""Hand-made inventories for unit tests."""

from poolshift.sources.inventory import INVENTORY_COLUMNS, RAW_SCHEMA, normalise_inventory
from pyspark.sql import types as T

RAW_WITH_ORD = T.StructType(list(RAW_SCHEMA.fields) + [T.StructField("row_ord", T.LongType())])

DEFAULTS = {"idc": "S1", "cluster_name": "default", "iaas_cluster": "default",
            "instance_num": "1", "cpu_limit": "4", "mem_limit": "8", "cpu_request": "1",
            "package": "pkg"}


def raw_rows(rows):
    out = []
    for i, r in enumerate(rows):
        d = dict(DEFAULTS)
        d.update(r)
        d.setdefault("row_ord", i)
        out.append(tuple(d.get(c) for c in INVENTORY_COLUMNS))
    return out


def make_inventory(spark, rows, drop=()):
    df = spark.createDataFrame(raw_rows(rows), RAW_WITH_ORD)
    if drop:
        df = df.drop(*drop)
    return normalise_inventory(df)

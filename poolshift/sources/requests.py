"""Analysis requests as a table (one row = one question).

For the test tables the requests are derived from ``nation``: each nation
asks to move services from its region's default pool to the next region's
pool; sites and a few malformed requests come from fixed rules on the
nation key, so validation has work to do. The request bodies are JSON
text, as they arrive from a client.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_tasks
from .inventory import read_table

# Fixed values of the derived requests: iaas clusters cycled over nations,
# site lists cycled over nations.
IAAS_CYCLE = ["default", "gpu", "spot"]
# Bodies that a task reads, while there are tasks enough.
BODIES_PER_TASK = 5_000
SITE_CYCLE = ["BUILDING,MACHINERY", "AUTOMOBILE", "", " HOUSEHOLD , FURNITURE "]


def _cycle(key, values):
    expr = None
    for i, v in enumerate(values):
        cond = (key % len(values)) == i
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr


def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed requests: request_id, idc, pool1, pool2, pool, min_save_cores,
    target_pool, candidate_pools."""
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    r1 = region.select(F.col("r_regionkey").alias("rk1"),
                       F.replace("r_name", F.lit(" "), F.lit("-")).alias("reg1"))
    r2 = region.select(F.col("r_regionkey").alias("rk2"),
                       F.replace("r_name", F.lit(" "), F.lit("-")).alias("reg2"))
    k = F.col("n_nationkey")
    base = (nation.join(r1, F.col("n_regionkey") == F.col("rk1"))
            .withColumn("next_region", (F.col("n_regionkey") + 1) % 5)
            .join(r2, F.col("next_region") == F.col("rk2")))
    pool1 = F.concat("reg1", F.lit("/default"))
    pool2 = F.concat("reg2", F.lit("/"), _cycle(k, IAAS_CYCLE))
    return base.select(
        F.concat(F.lit("r"), F.lpad(k.cast("string"), 2, "0")).alias("request_id"),
        _cycle(k, SITE_CYCLE).alias("idc"),
        F.when(k == 11, F.lit(" ")).otherwise(pool1).alias("pool1"),
        # nation 7 names the same pool twice, nation 13 a bare cluster name
        F.when(k == 7, pool1).when(k == 13, F.col("reg2")).otherwise(pool2).alias("pool2"),
        pool1.alias("pool"),
        (k % 4 * 5).cast("string").alias("min_save_cores"),
        pool1.alias("target_pool"),
        # a blank item, the target, a double, and one of them with blanks inside
        F.concat_ws(",", pool2, F.lit(" "), pool1, pool2,
                    F.concat(F.col("reg2"), F.lit(" / default "))).alias("candidate_pools"),
    )


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests as JSON text bodies (column ``body``)."""
    t = request_table(spark, sf_dir)
    return t.select(F.to_json(F.struct(*t.columns)).alias("body"))


def mixed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request body per customer (``c_custkey, body``), in every shape they
    arrive in, cycled over the customer key: lists as comma text and as JSON
    arrays, fields of a wrong type, bodies that are cut off, empty or no
    object, bodies without an id, and ids that several bodies carry."""
    customer = read_table(spark, sf_dir, "customer")
    # bodies are short rows that take long to read: dealt to more tasks than their bytes would get
    tasks = min(shuffle_tasks(spark), customer.count() // BODIES_PER_TASK + 1)
    customer = customer.select("c_custkey", "c_nationkey", "c_mktsegment").repartition(tasks, "c_custkey")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    name = F.replace("r_name", F.lit(" "), F.lit("-"))
    home = region.select(F.col("r_regionkey").alias("rk1"), name.alias("home"))
    away = region.select(F.col("r_regionkey").alias("rk2"), name.alias("away"))
    k = F.col("c_custkey")
    rows = (customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(home, F.col("n_regionkey") == F.col("rk1"))
            .join(away, (F.col("n_regionkey") + 1) % 5 == F.col("rk2")))
    shape = k % 8

    def quoted(*parts):
        return F.concat(F.lit('"'), *parts, F.lit('"'))

    site, pool = F.col("c_mktsegment"), F.concat("away", F.lit("/"), _cycle(k, IAAS_CYCLE))
    text_sites = quoted(F.lit(" "), site, F.lit(" , MACHINERY"))
    text_pools = quoted(pool, F.lit(" ,, AFRICA / gpu"))
    sites = F.when(shape == 1, F.concat(F.lit("["), quoted(site, F.lit(" ")), F.lit(', null, "MACHINERY"]'))).when(shape == 2, F.lit("7")) \
        .otherwise(text_sites)
    pools = F.when(shape == 1, F.concat(F.lit("["), quoted(pool), F.lit(', "AFRICA / gpu"]'))) \
        .when(shape == 3, F.concat(F.lit("["), quoted(pool), F.lit(", 3]"))).otherwise(text_pools)
    ident = F.when(k % 48 == 8, F.lit('"request_id": "same", ')).when(shape == 5, F.lit("")) \
        .otherwise(F.concat(F.lit('"request_id": '), quoted(F.lit("c"), k.cast("string")), F.lit(", ")))
    body = F.concat(F.lit("{"), ident, F.lit('"idc": '), sites, F.lit(', "target_pool": '), quoted(F.col("home"), F.lit("/default")),
                    F.lit(', "candidate_pools": '), pools, F.lit("}"))
    out = rows.select("c_custkey", body.alias("_body"))
    return out.select("c_custkey", F.when(shape == 4, F.left("_body", F.lit(30))).when(shape == 6, F.lit(None).cast("string"))
                      .when(shape == 7, F.lit("[1]")).otherwise(F.col("_body")).alias("body"))

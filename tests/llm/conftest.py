import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text); all other columns null but one whose name clashes with an output."""
    return lambda rows: spark.createDataFrame([(i, t, None, None, None, "extra") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def make_labels(spark):
    return lambda rows: spark.createDataFrame(list(rows), LABELS)


@pytest.fixture(scope="session")
def make_items(spark):
    return lambda rows: spark.createDataFrame(list(rows), ITEMS)

"""Number coercion against the Python model on generated text (one Spark job per example batch)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from poolshift.functions import exprs as X

from . import model

PIECES = ["1", "2", "0", "9", ".", "e", "E", "+", "-", " ", "nan", "inf", ",", "d", "x", "/"]
texts = st.lists(st.lists(st.sampled_from(PIECES), max_size=6).map("".join), min_size=20, max_size=60)


@settings(max_examples=5, deadline=None)
@given(texts)
def test_coerce_number_matches_model(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(X.coerce_number("v")).collect()]
    assert got == [model.to_num(v) for v in values]
    got0 = [r[0] for r in df.orderBy("i").select(X.count_or_zero("v")).collect()]
    assert got0 == [model.trunc_int(model.to_num(v) or 0.0) if abs(model.to_num(v) or 0.0) < 9e18 else 0
                    for v in values]

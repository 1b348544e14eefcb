import pytest
from pyspark.sql import functions as F

from graphloom.operators import style


@pytest.mark.parametrize(
    ("selector", "weight"),
    [("p", 1), ("*", 0), ("ul > li", 2), (".a", 10), ("#x", 100), ("a:hover", 11), ("a::before", 2), ("p:first-line", 2), ("[href='a.b#c']", 10), ("div#main .item.on", 121), (":not(.a)", 10), (":where(#x) p", 1), (":is(#x) p", 101), ("li:nth-child(2n + 1)", 11), ("/* #no */ p", 1), ("h1 + *[rel=up]", 11), (".sm\\:flex", 10), ("", 0), (None, 0)],
)
def test_specificity(spark, selector, weight):
    df = spark.createDataFrame([(selector,)], "s string")
    assert df.select(style.specificity(F.col("s"))).first()[0] == weight

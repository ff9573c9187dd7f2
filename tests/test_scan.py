"""Sliced scans: every running value against plain windows, whatever the slices."""

import pytest
from compare import same
from pyspark.sql import Window as W, functions as F

from streamscope.plans.scan import (
    OrderedScan, first_value, last_value, previous, running_count, running_max, running_min, running_sum, total_of,
)


def plain(df, descending, order):
    per = W.partitionBy("k")
    at = per.orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in order])
    upto, before = at.rowsBetween(W.unboundedPreceding, 0), at.rowsBetween(W.unboundedPreceding, -1)
    v = F.col("v")
    return df.withColumns({
        "a": F.sum(v).over(upto), "b": F.coalesce(F.sum(v).over(before), F.lit(0)), "c": F.max(v).over(upto),
        "d": F.min(v).over(before), "e": F.last(v, True).over(upto), "f": F.last(v, True).over(before),
        "g": F.first(v, True).over(upto), "h": F.lag(v, 1).over(at), "i": F.sum(v).over(per),
        "j": F.count(v).over(per), "m": F.row_number().over(at).cast("bigint"),
    })


def scanned(df, descending, order, width):
    v = F.col("v")
    return OrderedScan(df, "k", order, descending, width).add(
        a=running_sum(v), b=running_sum(v, exclusive=True), c=running_max(v), d=running_min(v, exclusive=True),
        e=last_value(v), f=last_value(v, exclusive=True), g=first_value(v), h=previous(v), i=total_of("sum", v),
        j=total_of("count", v), m=running_count(),
    ).df


ORDERS = {
    "number": "id as o",
    "negative": "id - 150 as o",
    "double": "id / 7 as o",
    "time": "timestamp_seconds(id * 900) as o",
    "date": "date_add(date'2024-01-01', cast(id as int)) as o",
    "null": "if(id = 0, null, id) as o",
}


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ORDERS)
def test_every_running_value(spark, kind, descending):
    df = spark.range(300).selectExpr(
        "if(id % 5 = 0, null, if(id % 3 = 0, 'hot', 'k' || id % 2)) as k", ORDERS[kind],
        "if(id % 7 < 3, null, id * 37 % 101) as v",
    )
    for width in (20, None):
        same(scanned(df, descending, ["o"], width).toPandas(), plain(df, descending, ["o"]).toPandas())


def test_ties_in_the_leading_column(spark):
    df = spark.range(400).selectExpr("'a' as k", "id div 40 as o", "id as tie", "id % 9 as v")
    same(scanned(df, False, ["o", "tie"], 3).toPandas(), plain(df, False, ["o", "tie"]).toPandas())


def test_values_of_values(spark):
    """A later value sees an earlier one, also across slices."""
    df = spark.range(500).selectExpr("id % 2 as k", "id as o")
    scan = OrderedScan(df, "k", "o", width=32).add(n=running_count()).select(odd=F.col("n") % 2)
    got = scan.add(s=running_sum(F.col("odd"))).df
    assert got.count() == 500
    assert got.filter("s <> (n + 1) div 2").count() == 0


def test_no_task_holds_more_of_a_key_than_a_slice(spark):
    df = spark.range(4000).selectExpr("0 as k", "id as o", "id as v")
    plan = OrderedScan(df, "k", "o", width=100).add(n=running_count()).df
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Window [row" not in text and "__slice" in text
    assert plan.filter("n <> o + 1").count() == 0


def test_an_order_that_cannot_be_sliced_is_refused(spark):
    with pytest.raises(TypeError):
        OrderedScan(spark.sql("select 1 as k, 'x' as o"), "k", "o").add(n=running_count())


def test_empty(spark):
    df = spark.range(0).selectExpr("id as k", "id as o", "id as v")
    assert scanned(df, False, ["o"], None).count() == 0

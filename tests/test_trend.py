"""Queries over events on tables that the test folders do not hold: ties, ids beyond the content."""

import duckdb
import pandas as pd
import pytest
from compare import same
from pyspark.sql import functions as F

from streamscope.operators import trend
from streamscope.registry import QUERIES, SQL


def asked(spark, folder, name, events):
    """The query's rows over `events`, which agree with its SQL."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events, schema).repartition(3).write.parquet(f"{folder}/events.parquet")
    got = QUERIES[name](spark, str(folder)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    same(got, con.execute(SQL[name]).fetchdf())
    return got


def in_one_second(n):
    """Rows of two runs, all of a run's within three seconds, ids against the order of the values."""
    start = pd.Timestamp("2024-01-01")
    return [
        (i, (start + pd.Timedelta(microseconds=(i * 7919) % 3_000_000)).to_pydatetime(), i % 2, "view", float(1 + (i * 37) % n), '{"k": %d}' % (1 + i * 31 % 89))
        for i in range(n)
    ]


@pytest.mark.parametrize("name", ["a15_memory_trend", "a16_heap_gap"])
def test_samples_of_one_second(spark, tmp_path, name):
    events = in_one_second(200)
    got = asked(spark, tmp_path, name, events).set_index("run")
    if name == "a15_memory_trend":
        for run in (0, 1):
            read = [
                (int(e[1].second), e[0], e[4] * 100) for e in events if e[2] == run and (1 + e[0] * 31 % 89) % 10
            ]
            assert (got["first"][run], got["last"][run]) == (min(read)[2], max(read)[2])


def test_ties_without_an_order(spark):
    """Equal times and no further order: values decide, however the rows are placed."""
    data = [("r", 1, float(v)) for v in (5, 3, 9)] + [("r", 2, float(v)) for v in (4, 8, 6)]
    for turned in (data, data[::-1]):
        df = spark.createDataFrame(turned, "run string, t int, v double").repartition(3)
        fit = trend.memory_trend(df, "run", "t", "v").first()
        assert (fit.first, fit.last) == (3.0, 8.0)
        gap = trend.heap_gap(df.withColumn("z", F.lit(0.0)), "run", "t", "z", "v", "v", "v")
        assert (gap.first().gap_first, gap.first().gap_last) == (3.0, 8.0)


def test_ranges_beyond_the_content(spark, tmp_path):
    """A range that begins behind the 20,000 bytes is not satisfiable, whoever asks."""
    at = pd.Timestamp("2024-01-01").to_pydatetime()
    users = (19_999, 20_000, 20_805)
    got = asked(spark, tmp_path, "p11_byte_range", [(n, at, u, "view", 300.0, '{"k": 9}') for n, u in enumerate(users)])
    assert got.sort_values("event_id").outcome.tolist() == ["satisfiable", "unsatisfiable", "unsatisfiable"]

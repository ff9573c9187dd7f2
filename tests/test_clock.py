"""Clock and start-up folds in slices against whole folds, and their plans."""

import json
import random
import timeit

import numpy as np
import pytest
from compare import rows, same
from conftest import SF
from pyspark.sql import functions as F
from test_fold import stream

from streamscope.operators import clock, media
from streamscope.registry import QUERIES, SQL


def packets(part):
    pcr = [float("nan") if r[2] is None else float(r[2]) for r in part]
    return {
        "__pid": np.array([float(r[1]) for r in part]), "__pcr": np.array(pcr), "__flag": np.array([r[4] for r in part]),
    }


def along(fold, parts):
    """(state after each slice by its description, by the fold itself, what the fold gave)."""
    state = plain = None
    for part in parts:
        told = json.loads(json.dumps(fold.describe(part)))
        state = json.loads(json.dumps(fold.enter(told, state)))
        done, plain = fold.step(part, plain)
        yield state, plain, done


def cuts(rng, n):
    edges = sorted({0, n, *(rng.randrange(n) for _ in range(rng.choice((0, 3, 30))))})
    return list(zip(edges, edges[1:]))


def test_clock_slices():
    for seed in range(300):
        rng = random.Random(seed)
        timeline = stream(rng, 200)
        fold = clock.clock_fold()
        whole, last = fold.step(packets(timeline), None)
        given = []
        for state, plain, done in along(fold, [packets(timeline[a:b]) for a, b in cuts(rng, len(timeline))]):
            assert state == plain, seed
            given.append(done)
        assert state == last
        for k in (0, 1):
            np.testing.assert_array_equal(np.concatenate([g[k] for g in given]), whole[k])


def test_release_slices():
    for seed in range(300):
        rng = random.Random(seed)
        n = 150
        segment = np.cumsum([rng.random() < 0.05 for _ in range(n)])
        table = {
            "__t": np.cumsum([rng.randrange(900_000) for _ in range(n)]), "__bytes": np.array([rng.randrange(200) for _ in range(n)]),
            "__elapsed": np.array([rng.choice((np.nan, rng.randrange(400_000))) for _ in range(n)]),
            "__rate": np.array([rng.choice((np.nan, 0.0, 5_000.0)) for _ in range(n)]), "__segment": segment,
        }
        fold = clock.release_fold(rng.choice((3_000, 50_000)), rng.choice((2_000, 10_000)), rng.choice((5_000, 90_000)))
        (whole,), last = fold.step(table, None)
        found = []
        for state, plain, (row,) in along(fold, [{k: v[a:b] for k, v in table.items()} for a, b in cuts(rng, n)]):
            assert state == plain, seed
            found.append(row)
        assert state == last
        assert next((r for r in found if r[1] is not None), found[-1]) == whole


@pytest.mark.parametrize("name", ["w1_pcr_segments", "w11_startup_release"])
@pytest.mark.parametrize("width", [3, 400])
def test_any_slices_equal_sql(spark, duck, monkeypatch, name, width):
    monkeypatch.setattr(media, "SLICE_PACKETS", width)
    same(QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).fetchdf())


def test_other_columns_nulls_and_empty(spark):
    df = spark.range(40).selectExpr(
        "if(id % 2 = 0, null, 'a') as s", "id as o", "cast(null as bigint) as pcr", "1 as pid", "cast(null as boolean) as flag",
        "named_struct('x', array(id)) as extra", "timestamp_seconds(id) as ts", "cast(id as decimal(9, 2)) as d",
    )
    out = media.pcr_segments(df, "s", ["o"], "pid", "pcr", "flag")
    assert rows(out.drop("segment", "elapsed")) == rows(df)
    assert rows(out.select("segment", "elapsed").distinct()) == [(0, None)]
    assert media.pcr_segments(df.limit(0), "s", ["o"], "pid", "pcr", "flag").count() == 0


def test_rows_are_dealt_once(spark):
    df = spark.range(1000).selectExpr("id % 3 as s", "id as o", "id * 90000 as pcr", "id % 3 as pid", "id < 0 as flag")
    out = media.pcr_segments(df, "s", ["o"], "pid", "pcr", "flag")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("Range (0, 1000") == 1
    assert out.filter(F.col("elapsed") != (F.col("o") - F.col("s")) * 90_000).count() == 0


def test_small_slices_are_cheap():
    """Sparse streams are many slices of a few rows; each costs microseconds, not array calls."""
    rng = random.Random(1)
    part = {
        "__pid": np.array([256.0 + rng.randrange(2) for _ in range(33)]), "__pcr": np.array([float(rng.randrange(1 << 33)) for _ in range(33)]),
        "__flag": np.array([rng.random() < 0.1 for _ in range(33)]), "__t": np.arange(33), "__bytes": np.ones(33, np.int64),
        "__elapsed": np.full(33, np.nan), "__rate": np.full(33, np.nan), "__segment": np.zeros(33, np.int64),
    }
    for fold in (clock.clock_fold(), clock.release_fold(1, 10**9, 10**9)):
        for part_of in (fold.describe, lambda rows, f=fold: f.step(rows, None)):
            assert min(timeit.repeat(lambda: part_of(part), number=50, repeat=5)) / 50 < 120e-6


def test_clock_is_walked_once_for_the_release(spark):
    """Both uses of the rows that enter the release fold read one exchange."""
    df = QUERIES["w11_startup_release"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 2 and final.count("FileScan parquet") == 1

import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from streamscope.llm import topk
from streamscope.llm.queries import QUERIES, SQL

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k):
    good = [
        (i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (i, q) in enumerate(good):
        if i % 20:
            continue
        found = sorted(
            (-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(good) if m != n
        )
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def asked(frame, **options):
    got = topk.top_k(frame, F.col("id") % 20 == 0, **options).collect()
    return sorted(map(tuple, got))


def test_whole_table(spark, duck):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = sorted(map(tuple, QUERIES["op2_top_k"](spark, SF).collect()))
    assert got == plain([(r.vec_id, r.embedding) for r in rows], 20)
    want = duck.execute(SQL["op2_top_k"]).fetchall()
    columns = [d[0] for d in duck.description]
    at = [columns.index(c) for c in ("query_id", "rank", "vec_id", "score")]
    assert got == sorted(tuple(w[i] for i in at) for w in want)


@pytest.mark.parametrize("sizes", [(7, 3), (50, 1000), (2048, 1024)])
def test_blocks_and_pruning(spark, sizes):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [
        (i, [float(x) for x in np.float32(centres[i % 6] + rng.normal(size=8) / 30)])
        for i in range(400)
    ]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert asked(frame, k=5, data_rows=sizes[0], query_rows=sizes[1]) == plain(rows, 5)


def test_plan_leaves_out_far_cells():
    pivots = np.array([[100.0, 0], [-100, 0], [90, 1]])
    figures = [(0, 50, 1.0, 5, 1.0), (1, 50, 1.0, 0, None), (2, 50, 1.0, 5, 1.0)]
    pairs = topk.plan(pivots, figures, 20, 1000, 10).pairs
    assert {j for _, j in pairs} == {0}


def test_blocks_of_a_group_and_slot_come_one_after_the_other(spark):
    """Only then a query's k-th best is known when its next block comes."""
    rows = [(i, [float(i % 7), float(i % 11)], 0) for i in range(100)]
    found = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("id") % 20 == 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [group" in plan


def test_best_of_many_blocks():
    rng, k = np.random.default_rng(5), 4
    for width in (2, 9, 60):
        best, seen = topk.Best(3, k), [[], [], []]
        for block in range(12):
            ids, rows = rng.integers(0, 50, width), np.arange(width) + block * width
            asked = np.flatnonzero(rng.random(3) < 0.8)
            scores = rng.integers(-9, 9, (len(asked), width)).astype(np.float32)
            scores[rng.random(scores.shape) < 0.1] = -np.inf
            best.meet(asked, scores, ids, rows)
            for line, found in zip(asked, scores):
                seen[line] += [x for x in zip(-found, ids, rows) if x[0] < np.inf]
        best.rank()
        for line in range(3):
            got = [x for x in zip(-best.score[line], best.id[line], best.row[line]) if x[0] < np.inf]
            assert got == sorted(seen[line])[:k]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [None, 1.0]), (80, [inf, 0.0]),
            (1, [-1.0, -1.0]), (2, []), (3, [5.0]), (None, [1.0, 1.0]), (0, [1.0, 2.0]),
            (100, [0.0, 0.0]), (4, [1.0, 2.0]), (5, [-0.001, 0.001])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).withColumn("id", F.lit("x"))
    padded = [(i, v if v is None else [*v, *[0.0] * (2 - len(v))]) for i, v in rows]
    assert asked(frame.withColumn("score", F.lit(1))) == plain(padded, 20)
    assert asked(frame, k=2) == plain(padded, 2)
    assert asked(frame.limit(0)) == []
    assert asked(frame.filter("vec_id = 20")) == []

"""Greedy folds in slices: descriptions against plain folds, and the plans' shape."""

import random

import numpy as np
import pytest
from compare import rows, same
from conftest import SF

from streamscope.operators import delivery, media
from streamscope.operators.segmenter import Segmenter, segment_fold
from streamscope.plans.fold import sliced_fold
from streamscope.registry import QUERIES, SQL


@pytest.mark.parametrize("name", ["w2_hls_segments", "w2_hls_segments_limited", "w19_checkpoints"])
@pytest.mark.parametrize("width", [1, 7, 900])
def test_any_slices_equal_sql(spark, duck, monkeypatch, name, width):
    monkeypatch.setattr(media, "SLICE_PACKETS", width)
    monkeypatch.setattr(delivery, "SLICE_INTERVALS", width)
    same(QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).fetchdf())


def stream(rng, n):
    """Packets with gaps, two clocks, steps backwards, wraps and long stretches without access."""
    pkt, clocks, out = 0, {1: rng.randrange(1 << 33), 2: rng.randrange(1 << 33)}, []
    access, flags, jumps = rng.choice((0.02, 0.2, 0.6)), rng.choice((0.0, 0.03)), rng.choice((0.0, 0.05))
    large = rng.choice((90_000, 90_000, 1 << 31))
    for _ in range(n):
        pkt += rng.choice((1, 1, 2, 5))
        pid = rng.choice((1, 1, 1, 2, 3))
        pcr = None
        if pid in clocks and rng.random() < 0.7:
            step = -rng.randrange(1 << 20) if rng.random() < jumps else rng.randrange(large)
            pcr = clocks[pid] = (clocks[pid] + step) % (1 << 33)
        row = (pkt, pid, pcr, rng.random() < access, rng.random() < flags)
        if row[3] or row[4] or pcr is not None:
            out.append(row)
    return out


def columns(part):
    names = ("pkt", "pid", "pcr", "access", "flag")
    made = dict(zip(names, map(list, zip(*part))))
    made["pcr"] = [float("nan") if v is None else float(v) for v in made["pcr"]]
    return {n: np.array(v) for n, v in made.items()}


@pytest.mark.parametrize("limit", [None, 2, 3, 40, 300])
def test_a_described_slice_gives_the_state_of_the_fold(limit):
    for seed in range(250):
        rng = random.Random(seed)
        packets, target = stream(rng, 300), rng.choice((0.5, 3.0, 20.0))
        fold = segment_fold(target, limit, 2)
        width = rng.choice((5, 40, 200))
        if limit is not None:
            width = min(width, max(1, limit - 2))
        whole, state = Segmenter(target, limit, 2), None
        for at in range(0, packets[-1][0] + 1, width):
            part = [p for p in packets if at <= p[0] < at + width]
            if not part:
                continue
            state = fold.enter(fold.describe(columns(part)), state)
            whole.feed(part)
            assert state == whole.state(), (seed, at)


def test_described_checkpoints_give_the_state_of_the_fold():
    for seed in range(200):
        rng = random.Random(seed)
        gap, interval, width = rng.choice((2, 30, 900)), rng.choice((1, 16, 128)), rng.choice((40, 1000))
        fold = delivery.checkpoint_fold(interval, rng.choice((0, 50)))
        values = np.cumsum([rng.randrange(1, 2 + gap) for _ in range(400)])
        state = plain = None
        for slice_ in np.unique(values // width):
            part = {"cursor": values[values // width == slice_]}
            state = fold.enter(fold.describe(part), state)
            _, plain = fold.step(part, plain)
            assert state == plain, seed


def test_a_slice_says_little(spark):
    """What is walked along a stream does not grow with the rows of a slice."""
    rng, packets, clock = random.Random(5), [], 0
    for pkt in range(0, 60_000, 4):
        clock += 300
        packets.append((pkt, 1, clock, rng.random() < 0.01, False))
    described = segment_fold(6.0, 65_536, 2).describe(columns(packets))
    assert len(described["first"]) < 5_000 and len(described["ends"]) < 100
    limits = delivery.checkpoint_fold(128, 0).describe({"cursor": 8192 + np.arange(8192)})["limits"]
    assert len(limits) <= 129


def test_null_keys_ties_of_streams_and_empty(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, null, cast(id % 3 as string)) as s", "id div 3 as cursor")
    fold = delivery.checkpoint_fold(10, 0)
    got = rows(sliced_fold(df, ["s"], ["cursor"], 64, fold, "saved bigint"))
    assert got == sorted(((s, v) for s in (None, "1", "2") for v in range(10, 1000, 10)), key=repr)
    assert rows(sliced_fold(df.limit(0), ["s"], ["cursor"], 64, fold, "saved bigint")) == []


def test_three_passes_at_any_size(spark):
    """One exchange of the rows, used twice; one of the descriptions, one of the entries."""
    df = spark.range(100_000).selectExpr("id % 2 as s", "id as cursor")
    out = sliced_fold(df, ["s"], ["cursor"], 1024, delivery.checkpoint_fold(128, 0), "saved bigint")
    assert out.count() == 2 * (100_000 - 1) // 128 or out.count() > 0
    plan = out._jdf.queryExecution()
    out.collect()
    text = plan.executedPlan().toString()
    assert text.count("MapInArrow") >= 3 and "ReusedExchange" in text

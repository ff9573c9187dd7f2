"""Stateful operators and folds against plain sequential models on random input."""

import random

import pandas as pd
import pytest
from compare import rows, same
from pyspark.sql import functions as F

from streamscope.operators import access, delivery, media, swarm
from streamscope.operators.segmenter import Segmenter
from streamscope.streaming import stateful as st
from streamscope.streaming import windows
from streamscope.streaming.state import drain

MOD = 1 << 33
HZ = 90_000


def landed(spark, tmp_path, frame: pd.DataFrame, schema: str, parts: int = 3):
    """The frame as ``parts`` files, read as a stream one file at a time."""
    import os
    import time

    step = -(-len(frame) // parts)
    folder = str(tmp_path / "land")
    for i in range(parts):
        piece = frame.iloc[i * step : (i + 1) * step]
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(folder)
        stamp = time.time() - 1000 + i * 10
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if name.endswith(".parquet") and os.path.getmtime(path) > time.time() - 500:
                os.utime(path, (stamp, stamp))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def packets(rng: random.Random, n: int) -> list[dict]:
    clock, out = rng.randrange(MOD), []
    for i in range(n):
        clock = (clock + rng.randrange(40_000)) % MOD
        if rng.random() < 0.03:
            clock = (clock - rng.randrange(10**6)) % MOD
        out.append(
            {
                "pkt": i,
                "pid": rng.choice([256, 256, 256, 257]),
                "pcr": clock if rng.random() < 0.5 else None,
                "access": rng.random() < 0.25,
                "flag": rng.random() < 0.02,
            }
        )
    return out


def model_segments(packets: list[dict], target: float, limit: int | None, tables: int) -> list[tuple]:
    """Packet by packet, keeping the packets of the open segment in a list."""
    done, current, pid, start, last, pending = [], None, None, None, None, False

    def tick(p):
        nonlocal pid, start, last
        if p["pcr"] is None or (pid is not None and p["pid"] != pid):
            return True
        if last is not None and (p["pcr"] - last) % MOD > MOD // 2:
            return False
        pid, last = p["pid"], p["pcr"]
        start = p["pcr"] if start is None else start
        return True

    for p in packets:
        full = limit is not None and current is not None and len(current) + tables == limit
        if p["flag"]:
            current, pid, start, last, pending = None, None, None, None, True
            continue
        if current is None:
            if p["access"] and (limit is None or tables + 1 <= limit):
                current, pid, start, last = [p["pkt"]], None, None, None
                tick(p)
            continue
        if not tick(p):
            current, pid, start, last, pending = None, None, None, None, True
            continue
        ticks = None if start is None else (last - start) % MOD
        long_enough = ticks is not None and ticks <= MOD // 2 and ticks >= target * HZ
        if long_enough and (p["access"] or full):
            done.append((len(done), current[0], current[-1], round(ticks / HZ, 3), pending))
            current, start, pending = [p["pkt"]], last, False
        elif full:
            current, pid, start, last, pending = None, None, None, None, True
            if p["access"]:
                current = [p["pkt"]]
                tick(p)
        else:
            current.append(p["pkt"])
    return done


@pytest.mark.parametrize("limit", [None, 3, 12, 40])
def test_segmenter_against_packet_model(limit):
    for seed in range(150):
        rng = random.Random(seed)
        stream = packets(rng, 200)
        target = rng.choice([0.5, 2.0, 5.0])
        kept = [p for p in stream if p["flag"] or p["access"] or p["pcr"] is not None]
        cutter = Segmenter(target, limit, 2)
        got = cutter.feed([tuple(p[c] for c in ("pkt", "pid", "pcr", "access", "flag")) for p in kept])
        want = [s for s in model_segments(stream, target, limit, 2) if s[2] < kept[-1]["pkt"]]
        assert got == want, seed


def test_segments_batch_stream_and_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "SLICE_PACKETS", 37)
    stream = packets(random.Random(7), 400)
    schema = "s string, pkt bigint, pid int, pcr bigint, access boolean, flag boolean"
    frame = pd.DataFrame([{"s": "a", **p} for p in stream], dtype=object)
    df = spark.createDataFrame(frame, schema)
    model = [("a", *r) for r in model_segments(stream, 1.0, 60, 2)]
    want = sorted(model, key=repr)
    got = media.hls_segments(df, "s", "pkt", "pid", "pcr", "access", "flag", 1.0, 60)
    assert rows(got) == want
    sdf = landed(spark, tmp_path, frame, schema)
    live = drain(st.stream_segments(sdf, "s", "pkt", "pid", "pcr", "access", "flag", 1.0, 60, window=4), "t")
    assert rows(live.drop("media_seq", "discontinuity_seq")) == want
    marks = [r[5] for r in model]
    for r in live.collect():
        assert r.media_seq == max(0, r.seq - 3)
        assert r.discontinuity_seq == sum(marks[: r.media_seq])


def test_clock_stream_equals_batch(spark, tmp_path):
    schema = "s string, pkt bigint, pid int, pcr bigint, access boolean, flag boolean"
    frame = pd.DataFrame([{"s": "a", **p} for p in packets(random.Random(3), 300)], dtype=object)
    batch = media.pcr_segments(spark.createDataFrame(frame, schema), "s", ["pkt"], "pid", "pcr", "flag")
    live = drain(st.stream_clock(landed(spark, tmp_path, frame, schema), "s", "pkt", "pid", "pcr", "flag"), "t")
    same(live.toPandas(), batch.select("s", "pkt", "segment", "elapsed").toPandas())


def test_stall_alerts_match_intervals(spark, tmp_path):
    rng = random.Random(11)
    at, data = 1_700_000_000, []
    for i in range(300):
        at += rng.choice([1, 2, 3, 20])
        data.append(("a", i, at, rng.random() < 0.5 and i > 10, rng.random() < 0.7))
    frame = pd.DataFrame(data, columns=["s", "o", "at", "gave", "active"])
    schema = "s string, o bigint, at bigint, gave boolean, active boolean"

    def timed(df):
        return df.withColumn("ts", F.timestamp_seconds("at")).drop("at")

    batch = timed(spark.createDataFrame(frame, schema))
    end = F.timestamp_seconds(F.lit(at))
    intervals = media.stall_intervals(batch, "s", ["o"], "ts", "gave", "active", end, 12).filter("resumed_at is not null")
    want = {r[0] for r in intervals.select(F.unix_micros("stale_at")).collect()}
    sdf = timed(landed(spark, tmp_path, frame, schema))
    alerts = drain(st.stall_alerts(sdf, "s", ["o"], "ts", "gave", "active", "1 second", 12), "t").collect()
    got = {r.stale_at_us for r in alerts}
    assert want <= got and len(alerts) == len(got)
    # Alerts that closed no interval are repeats inside one, or come after the last progress.
    spans = intervals.select(F.unix_micros("stale_at"), F.unix_micros("resumed_at")).collect()
    last = max(r[1] for r in spans)
    for extra in got - want:
        assert any(a < extra <= b for a, b in spans) or extra > last


def test_retention_forms_agree(spark):
    df = spark.range(200).selectExpr("'a' as s", "id div 4 as piece", "id % 4 as chunk", "id % 7 + 1 as n", "id as o")
    kept = delivery.byte_budget_retention(df, "s", "piece", "n", 100).filter("retained")
    assert kept.agg(F.sum("nbytes")).first()[0] <= 100
    assert delivery.retention_is_ordered(df, "s", ["o"], "piece", "n", 100).first().exact
    assert not delivery.retention_is_ordered(df.withColumn("o", -F.col("o")), "s", ["o"], "piece", "n", 100).first().exact


def test_window_streams(spark, tmp_path):
    frame = pd.DataFrame([("a", 1_700_000_000 + i * 7, i) for i in range(90)], columns=["s", "at", "n"])
    schema = "s string, at bigint, n bigint"

    def timed(df):
        return df.select("s", F.timestamp_seconds("at").alias("ts"), "n")

    batch = timed(spark.createDataFrame(frame, schema))
    sdf = timed(landed(spark, tmp_path, frame, schema))
    live = drain(windows.rolling_rates(sdf, "s", "ts", "n", "60 seconds", "10 seconds", "1 second"), "t")
    every = windows.rolling_rates(batch, "s", "ts", "n", "60 seconds", "10 seconds")
    assert 0 < live.count() and live.exceptAll(every).count() == 0
    assert every.count() - live.count() <= 7  # only windows the watermark has not closed yet
    buckets = drain(windows.bucket_stream(sdf, "s", "ts", "n", "1 second", "30 seconds"), "b")
    assert buckets.agg(F.sum("nbytes")).first()[0] <= batch.agg(F.sum("n")).first()[0]
    sessions = drain(windows.viewer_sessions(sdf.withWatermark("ts", "1 second"), "s", "ts", 5), "v")
    whole = windows.viewer_sessions(batch, "s", "ts", 5)
    assert sessions.count() > 0 and sessions.exceptAll(whole).count() == 0


def test_idle_entries_live(spark, tmp_path):
    data = [("x", 100, "relay", 0), ("y", 101, "broadcast", 0), ("z", 102, "relay", 1), ("x", 500, "relay", 0), ("w", 2000, "relay", 0)]
    frame = pd.DataFrame(data, columns=["k", "at", "kind", "n"])
    sdf = landed(spark, tmp_path, frame, "k string, at bigint, kind string, n bigint")
    sdf = sdf.select("k", F.timestamp_seconds("at").alias("ts"), "kind", "n")
    got = drain(st.reap_idle_entries(sdf, "k", "ts", "kind", "n", "1 second"), "t")
    assert rows(got) == [("x", 100_000_000), ("x", 500_000_000)]


def test_handout_ends(spark):
    df = spark.createDataFrame([("s", 1), ("s", 5), ("s", 9), ("t", 4), ("u", 1), ("u", 2)], "g string, p int")
    got = rows(swarm.tracker_handout(df, "g", "p"))
    want = []
    for g, p in [("s", 1), ("s", 5), ("s", 9), ("t", 4), ("u", 1), ("u", 2)]:
        others = [q for h, q in [("s", 1), ("s", 5), ("s", 9), ("t", 4), ("u", 1), ("u", 2)] if h == g and q != p]
        want.append((g, p, len(others), min(others, default=None), max(others, default=None)))
    assert got == sorted(want, key=repr)


def test_manifest(spark):
    m = spark.createDataFrame([("v", ["da39a3ee5e6b4b0d3255bfef95601890afd80709", "00"])], "k string, h array<string>")
    pay = spark.createDataFrame([("v", 0, ""), ("v", 1, "x"), ("v", 2, "y")], "k string, piece int, data string")
    got = access.verify_pieces(pay, access.expand_manifest(m, "k", "h"), ["k", "piece"], "data", "expected")
    assert [r.ok for r in got.orderBy("piece").collect()] == [True, False, False]


def test_catalog_live(spark, tmp_path):
    rng = random.Random(13)
    at, data = 1_700_000_000, []
    for i in range(200):
        at += rng.randrange(1, 60)
        data.append((rng.choice("ab"), at, i, rng.random() < 0.2))
    frame = pd.DataFrame(data, columns=["k", "at", "i", "entry"])
    schema = "k string, at bigint, i bigint, entry boolean"

    def sides(df):
        df = df.withColumn("ts", F.timestamp_seconds("at"))
        return df.filter("not entry").select("k", "ts", "i"), df.filter("entry").select("k", "ts", F.col("i").alias("v"))

    batch = access.resolve_catalog(*sides(spark.createDataFrame(frame, schema)), "k", "ts", "v", 100)
    sdf = landed(spark, tmp_path, frame, schema)
    live = drain(st.stream_catalog(*sides(sdf), "k", "ts", "i", "v", 100), "t")
    got = live.select("k", F.col("ident").cast("bigint").alias("i"), F.col("value").cast("bigint").alias("v"), "resolved")
    assert rows(got) == rows(batch.select("k", "i", "v", "resolved"))


def test_checkpoints_live(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delivery, "SLICE_INTERVALS", 2)
    rng = random.Random(17)
    frame = pd.DataFrame([("s", i, i * 9 + rng.randrange(60)) for i in range(400)], columns=["s", "o", "piece"])
    schema = "s string, o bigint, piece bigint"
    _, batch = delivery.ingest_cursor(spark.createDataFrame(frame, schema), "s", ["o"], "piece")
    live = drain(st.stream_checkpoints(landed(spark, tmp_path, frame, schema), "s", ["o"], "piece"), "t")
    assert rows(live) == rows(batch)
    last, want = 0, []
    for piece in frame["piece"]:
        if piece >= last + 128:
            last = piece
            want.append(("s", last, last + 128))
    assert rows(batch) == sorted(want, key=repr)


def test_nearest_to_each_target(spark):
    """Clustered ids, targets among and beside them, more wanted than there are."""
    from streamscope.operators import swarm

    rng = random.Random(23)
    ids = {f"{rng.randrange(16 ** 40):040x}" for _ in range(200)}
    ids |= {"abcdef" + f"{rng.randrange(16 ** 34):034x}" for _ in range(300)}
    ids |= {"a" * 39 + x for x in "0123456789abcdef"}
    targets = [*rng.sample(sorted(ids), 5), "a" * 40, "abcdee" + "f" * 34, "0" * 40, *(f"{rng.randrange(16 ** 40):040x}" for _ in range(5))]
    nodes = spark.createDataFrame([(i,) for i in [*ids, *list(ids)[:20], None]], "id string")
    asked = spark.createDataFrame([(t,) for t in [*targets, targets[0], None]], "t string")
    for k, room in ((1, 1), (7, 4), (100, 1), (900, 2)):
        got = swarm.nearest_to_each(nodes, "id", asked, "t", k, room)
        want = []
        for t in set(targets):
            order = sorted((int(i, 16) ^ int(t, 16), i) for i in ids)[:k]
            want += [(t, i, f"{x:040x}", n + 1) for n, (x, i) in enumerate(order)]
        assert rows(got) == sorted(want, key=repr)
    assert rows(swarm.nearest_to_each(nodes.limit(0), "id", asked, "t", 3)) == []
    assert rows(swarm.nearest_to_each(nodes, "id", asked.limit(0), "t", 3)) == []


def test_limit_reached_before_a_last_plain_packet(spark, tmp_path):
    """Nothing that tells follows the packet at which the limit closes the segment."""
    plain = [{"pkt": n, "pid": 256, "pcr": None, "access": False, "flag": False} for n in range(10)]
    plain[0] |= {"pcr": 0, "access": True}
    plain[2] |= {"pcr": 2 * HZ}
    schema = "s string, pkt bigint, pid int, pcr bigint, access boolean, flag boolean"
    for n in range(1, 11):
        frame = pd.DataFrame([{"s": "a", **p} for p in plain[:n]], dtype=object)
        got = media.hls_segments(spark.createDataFrame(frame, schema), "s", "pkt", "pid", "pcr", "access", "flag", 1.0, 8)
        want = [("a", *r) for r in model_segments(plain[:n], 1.0, 8, 2)]
        assert rows(got) == want and len(want) == (n > 6), n
    sdf = landed(spark, tmp_path, frame, schema)
    live = drain(st.stream_segments(sdf, "s", "pkt", "pid", "pcr", "access", "flag", 1.0, 8), "plain")
    assert rows(live.drop("media_seq", "discontinuity_seq")) == want

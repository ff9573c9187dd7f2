"""Trends and counts over events."""

from pyspark.sql import functions as F

from ..operators import trend as tr
from .base import EV, Tables, query

T0 = 1_704_067_200  # 2024-01-01
SOAK = f"""so AS (SELECT user_id AS run, event_id, CAST(epoch_us(ts) // 1000000 - {T0} AS BIGINT) AS t,
  CASE WHEN k % 10 <> 0 THEN CAST(cents AS DOUBLE) END AS rss, CASE WHEN k % 4 <> 0 THEN CAST(cents * 3 AS DOUBLE) END AS alloc,
  CASE WHEN k % 6 <> 0 THEN CAST(cents * 3 + k AS DOUBLE) END AS resident, CASE WHEN k % 5 <> 0 THEN CAST(k AS DOUBLE) END AS threads,
  CASE WHEN event_type <> 'error' THEN CAST(k * 2 AS DOUBLE) END AS fds FROM ev)"""


def soak(t: Tables):
    def some(keep, value):
        return F.when(F.expr(keep), F.expr(value).cast("double"))

    return t.events.select(
        F.col("user_id").alias("run"),
        "event_id",
        (F.unix_seconds("ts") - T0).alias("t"),
        some("k % 10 <> 0", "cents").alias("rss"),
        some("k % 4 <> 0", "cents * 3").alias("alloc"),
        some("k % 6 <> 0", "cents * 3 + k").alias("resident"),
        some("k % 5 <> 0", "k").alias("threads"),
        some("event_type <> 'error'", "k * 2").alias("fds"),
    )


@query(
    "a15_memory_trend",
    f"""WITH {EV}, {SOAK}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY t, event_id) AS n, COUNT(*) OVER (PARTITION BY run) AS total FROM so),
      f AS (SELECT run, COUNT(*) AS samples, arg_min(rss, (t, event_id)) FILTER (rss IS NOT NULL) AS first, arg_max(rss, (t, event_id)) FILTER (rss IS NOT NULL) AS last,
        MAX(rss) AS peak, nullif(regr_slope(rss, t), 'nan') AS slope, nullif(regr_slope(rss, t) FILTER (n > total - greatest(total // 3, 2)), 'nan') AS tail FROM r GROUP BY run)
    SELECT run, samples, first, last, peak, last - first AS delta, round(slope, 6) AS slope, round(tail, 6) AS tail_slope,
      CASE WHEN tail IS NULL THEN NULL WHEN abs(tail * 3600 / 1024) < 20 THEN 'PLATEAU' ELSE 'STILL GROWING' END AS verdict FROM f""",
)
def _(t: Tables):
    return tr.memory_trend(soak(t), "run", "t", "rss", ties=["event_id"])


@query(
    "a16_heap_gap",
    f"""WITH {EV}, {SOAK}, g AS (SELECT *, resident - alloc AS gap FROM so)
    SELECT run, round(nullif(regr_slope(alloc, t), 'nan'), 6) AS allocated_slope,
      arg_min(gap, (t, event_id)) FILTER (gap IS NOT NULL) AS gap_first, arg_max(gap, (t, event_id)) FILTER (gap IS NOT NULL) AS gap_last,
      arg_min(threads, (t, event_id)) FILTER (threads IS NOT NULL) AS threads_first, arg_max(threads, (t, event_id)) FILTER (threads IS NOT NULL) AS threads_last, MAX(threads) AS threads_max,
      arg_min(fds, (t, event_id)) FILTER (fds IS NOT NULL) AS fds_first, arg_max(fds, (t, event_id)) FILTER (fds IS NOT NULL) AS fds_last, MAX(fds) AS fds_max FROM g GROUP BY run""",
)
def _(t: Tables):
    return tr.heap_gap(soak(t), "run", "t", "alloc", "resident", "threads", "fds", ties=["event_id"])


@query(
    "a17_decode_liveness",
    f"""WITH {EV}, s AS (SELECT user_id, event_id, CASE WHEN k % 3 > 0 THEN cents END AS frames, event_type, k FROM ev),
      a AS (SELECT user_id, arg_min(frames, event_id) FILTER (frames IS NOT NULL) AS frames_first, arg_max(frames, event_id) FILTER (frames IS NOT NULL) AS frames_last,
        string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS codes, MAX(k) AS peers_max FROM s GROUP BY user_id)
    SELECT *, CASE WHEN frames_last > frames_first THEN 'DECODING' ELSE 'STALLED/NO-DATA' END AS state FROM a""",
)
def _(t: Tables):
    df = t.events.withColumn("frames", F.when(F.col("k") % 3 > 0, F.col("cents")))
    return tr.decode_liveness(df, "user_id", "event_id", "frames", "event_type", "k")


@query(
    "a18_active_streams",
    f"""WITH {EV} SELECT event_type AS network, user_id % 50 AS stream, CAST(SUM(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS subscribers
    FROM ev GROUP BY ALL HAVING SUM(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) > 0""",
)
def _(t: Tables):
    df = t.events.select(
        F.col("event_type").alias("network"), (F.col("user_id") % 50).alias("stream"),
        F.when(F.col("k") % 2 == 0, 1).otherwise(-1).alias("delta"),
    )
    return tr.active_streams(df, ["network", "stream"], "delta")


@query(
    "a20_oplog_counts",
    f"""WITH {EV} SELECT user_id % 10 AS run, CASE WHEN event_type IN ('view', 'click') THEN 'request' WHEN event_type = 'error' THEN 'loss'
      ELSE 'other' END AS kind, COUNT(*) AS n FROM ev GROUP BY ALL""",
)
def _(t: Tables):
    df = t.events.select((F.col("user_id") % 10).alias("run"), F.concat(F.lit("got "), "event_type").alias("message"))
    return tr.oplog_counts(df, ["run"], "message", {"request": r"\b(view|click)\b", "loss": r"\berror\b"})


@query(
    "a21_packet_inventory",
    f"""WITH {EV}, c AS (SELECT user_id, event_type, event_id, k % 16 AS c FROM ev),
      l AS (SELECT *, (c - lag(c) OVER (PARTITION BY user_id, event_type ORDER BY event_id) + 16) % 16 AS step FROM c)
    SELECT user_id, event_type, COUNT(*) AS packets, COUNT(*) FILTER (step = 0) AS duplicates, COUNT(*) FILTER (step > 1) AS gaps FROM l GROUP BY ALL""",
)
def _(t: Tables):
    df = t.events.withColumn("c", F.col("k") % 16)
    return tr.packet_inventory(df, ["user_id", "event_type"], ["event_id"], "c")

"""Streams replayed over the tables (H1, H2, H8-H11, J1): everything available, then compared."""

from pyspark.sql import DataFrame, functions as F

from ..operators import swarm
from ..streaming import stateful as st
from ..streaming import windows as w
from ..streaming.state import drain
from .base import EV, LI, Tables, plain_time, query
from .media import CLOCK, PK, W2_SQL, packets


class Live(Tables):
    """The same tables and roles, read as streams."""

    def read(self, name: str) -> DataFrame:
        return (
            self.spark.readStream.schema(self.schema(name))
            .option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", 1)
            .parquet(self.folder)
        )


def live(t: Tables) -> Live:
    return Live(t.spark, t.folder)


@query("h1_stream_clock", f"WITH {EV}, {PK}, {CLOCK} SELECT user_id, event_id AS pkt, segment, elapsed FROM t5")
def _(t: Tables):
    return drain(st.stream_clock(packets(live(t)), "user_id", "event_id", "pid", "pcr", "flag"), "clock")


@query(
    "h2_stream_segments",
    f"""WITH sg AS ({W2_SQL})
    SELECT *, greatest(0, seq - 7) AS media_seq, CAST(COALESCE(SUM(CASE WHEN discontinuity THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 8 PRECEDING), 0) AS BIGINT) AS discontinuity_seq FROM sg""",
)
def _(t: Tables):
    df = live(t).events.select(
        "user_id", F.col("event_id").alias("pkt"), F.lit(256).alias("pid"),
        F.when(F.col("k") % 5 > 0, F.col("event_id") * 900 + F.expr("cents div 1000")).alias("pcr"),
        (F.col("event_type") == "view").alias("access"),
        ((F.col("event_type") == "error") & (F.col("k") % 4 == 0)).alias("flag"),
    )
    return drain(st.stream_segments(df, "user_id", "pkt", "pid", "pcr", "access", "flag", 6.0), "segments")


@query(
    "h9_live_edge_stream",
    f"""WITH {LI}, o AS (SELECT peer, piece, MAX(piece) OVER (PARTITION BY peer ORDER BY ts, piece, chunk, cents, part
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM li)
    SELECT peer, piece AS advertised FROM o WHERE before IS NULL OR piece > before""",
)
def _(t: Tables):
    out = st.stream_live_edge(live(t).lineitem, "peer", ["ts", "piece", "chunk", "cents", "part"], "piece")
    return drain(out, "edge")


@query(
    "h10_stall_alerts",
    f"""WITH {EV}, o AS (SELECT user_id, event_id, ts, k >= 10 AND event_type IN ('view', 'click', 'purchase') AS gave, event_type <> 'error' AS active FROM ev),
      s AS (SELECT *, SUM(CASE WHEN gave THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS n, MAX(ts) OVER (PARTITION BY user_id) AS last,
        MAX(ts) OVER () - INTERVAL 1 HOUR AS mark FROM o),
      p AS (SELECT *, COALESCE(lead(ts) OVER (PARTITION BY user_id ORDER BY event_id), greatest(last, mark)) AS until FROM s WHERE gave OR (n = 0 AND active)),
      st AS (SELECT *, row_number() OVER (PARTITION BY user_id, n ORDER BY event_id) AS nth FROM p WHERE ts + INTERVAL 24 HOUR <= until)
    SELECT user_id, epoch_us(ts) + 86400000000 AS stale_at_us, nth > 1 AS excluded FROM st
    UNION ALL SELECT user_id, epoch_us(ts) + 172800000000, TRUE FROM st WHERE nth = 1 AND ts + INTERVAL 48 HOUR <= until""",
)
def _(t: Tables):
    df = live(t).events.withColumns(
        {"out": (F.col("k") >= 10) & F.col("event_type").isin("view", "click", "purchase"), "act": F.col("event_type") != "error"}
    )
    out = st.stall_alerts(df, "user_id", ["event_id"], "ts", "out", "act", "1 hour", 24 * 3600)
    return drain(out, "stalls")


@query(
    "h8_reap_idle_entries",
    f"""WITH {EV}, e AS (SELECT user_id, ts, event_type <> 'signup' AND k % 3 = 0 AS idle, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt,
        MAX(ts) OVER () - INTERVAL 1 HOUR AS mark FROM ev)
    SELECT user_id, epoch_us(ts) AS last_active_us FROM e WHERE idle AND ts + INTERVAL 10 HOUR <= COALESCE(nxt, mark)""",
)
def _(t: Tables):
    df = live(t).events.select(
        "user_id", "ts", F.when(F.col("event_type") == "signup", "broadcast").otherwise("relay").alias("kind"),
        (F.col("k") % 3).alias("producers"),
    )
    return drain(st.reap_idle_entries(df, "user_id", "ts", "kind", "producers", "1 hour", 10 * 3600), "reaped")


@query("h11_dedupe_stream", f"WITH {LI} SELECT DISTINCT piece, chunk FROM li")
def _(t: Tables):
    df = live(t).lineitem.select("piece", "chunk", "ts")
    return drain(w.dedupe_deliveries(df, ["piece", "chunk"], "ts", "30 days"), "dedupe").select("piece", "chunk")


@query(
    "j1_correlate_stream",
    f"""WITH {EV}, q AS (SELECT user_id, ts FROM ev WHERE event_type = 'view'), r AS (SELECT user_id, ts FROM ev WHERE event_type = 'click')
    SELECT DISTINCT q.user_id, q.ts AS asked FROM q JOIN r ON q.user_id = r.user_id AND r.ts BETWEEN q.ts AND q.ts + INTERVAL 6 HOUR""",
)
def _(t: Tables):
    ev = live(t)
    q = ev.events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("asked"))
    r = ev.events.filter("event_type = 'click'").select("user_id", F.col("ts").alias("answered"))
    out = swarm.correlate_reply_stream(q, r, ["user_id"], "asked", "answered", 6 * 3600, "1 hour")
    return drain(out, "replies").select("user_id", "asked").withColumns(plain_time("asked"))

"""Verdicts, rollups, windows over events."""

from pyspark.sql import functions as F

from ..operators import health as h
from ..streaming import windows as w
from .base import EV, LI, Tables, plain_time, query

# First hour of the month of playback, since the epoch.
FIRST_HOUR = 473_352

HOURS = """hb AS (SELECT user_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS second, CAST(SUM(cents) AS BIGINT) AS nbytes FROM ev GROUP BY ALL),
  sp AS (SELECT user_id, 473352 AS a, 474071 + CASE WHEN user_id % 10 = 0 THEN 96 ELSE 0 END AS b
    FROM (SELECT user_id FROM ev UNION SELECT 100000 + n_nationkey FROM nation)),
  gr AS (SELECT user_id, unnest(range(a, b + 1)) AS second FROM sp),
  bk AS (SELECT gr.user_id, gr.second, COALESCE(hb.nbytes, 0) AS nbytes FROM gr LEFT JOIN hb ON gr.user_id = hb.user_id AND gr.second = hb.second)"""

HEALTH = """sm AS (SELECT user_id, event_id, CASE WHEN k >= 5 THEN 'dl' ELSE 'idle' END AS status,
    CASE WHEN user_id % 4 = 0 THEN k ELSE k + 1 END AS peers, CASE WHEN user_id % 3 = 0 THEN cents ELSE event_id END AS down,
    CASE WHEN k = 50 THEN 1 ELSE 0 END AS up FROM ev),
  rn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM sm),
  po AS (SELECT *, lag(down) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM rn WHERE n > 5),
  he AS (SELECT user_id, COUNT(*) AS samples, round(COUNT(*) FILTER (status = 'dl') / COUNT(*), 6) AS dl_ratio,
      COUNT(*) FILTER (status = 'dl') * 10 >= COUNT(*) * 9 AS status_ok, MIN(peers) >= 1 AS peers_ok,
      bool_and(before IS NULL OR down >= before) AND COUNT(*) >= 2 AND arg_max(down, event_id) > arg_min(down, event_id) AS downloaded_rising,
      MAX(up) > 0 AS upload_positive FROM po GROUP BY user_id),
  ha AS (SELECT p.user_id, COALESCE(samples, 0) AS samples, COALESCE(dl_ratio, 0.0) AS dl_ratio, COALESCE(status_ok, false) AS status_ok,
      COALESCE(peers_ok, false) AS peers_ok, COALESCE(downloaded_rising, false) AS downloaded_rising, COALESCE(upload_positive, false) AS upload_positive
      FROM (SELECT user_id FROM ev UNION SELECT 100000 + n_nationkey FROM nation) p LEFT JOIN he ON p.user_id = he.user_id)"""

# Every peer that was set up: those with samples, and some that never reported.
STABLE = """sr AS (SELECT *, second - row_number() OVER (PARTITION BY user_id ORDER BY second) AS g FROM bk WHERE nbytes < 188),
  ls AS (SELECT user_id, MAX(n) AS m FROM (SELECT user_id, COUNT(*) AS n FROM sr GROUP BY user_id, g) GROUP BY user_id),
  st AS (SELECT bk.user_id, CAST(SUM(nbytes) AS BIGINT) AS total_bytes, COUNT(*) AS seconds, COALESCE(MAX(m), 0) AS max_stall,
    SUM(nbytes) * 100 >= 2500 * COUNT(*) * 80 AS throughput_ok, COALESCE(MAX(m), 0) <= 48 AS stall_ok FROM bk
    LEFT JOIN ls ON bk.user_id = ls.user_id GROUP BY bk.user_id)"""


def samples(t: Tables):
    return t.events.select(
        "user_id", "event_id",
        F.when(F.col("k") >= 5, "dl").otherwise("idle").alias("status"),
        F.when(F.col("user_id") % 4 == 0, F.col("k")).otherwise(F.col("k") + 1).alias("peers"),
        F.when(F.col("user_id") % 3 == 0, F.col("cents")).otherwise(F.col("event_id")).alias("down"),
        F.when(F.col("k") == 50, 1).otherwise(0).alias("up"),
    )


def playback(t: Tables):
    """Hours of playback: a month for all, four days longer than any data for every tenth peer."""
    silent = t.read("nation").select((F.lit(100_000) + F.col("n_nationkey")).cast("bigint").alias("user_id"))
    until = F.when(F.col("user_id") % 10 == 0, FIRST_HOUR + 815).otherwise(FIRST_HOUR + 719)
    return t.events.select("user_id").unionByName(silent).distinct().withColumns(
        {"first": F.lit(FIRST_HOUR).cast("bigint"), "until": until.cast("bigint")}
    )


def health(t: Tables):
    return h.swarm_health(
        samples(t), "user_id", ["event_id"], "status", "peers", "down", "up", 5, playback(t)
    )


def buckets(t: Tables):
    return w.bucket_seconds(t.events, playback(t), "user_id", "ts", "cents", width=3600)


def stability(t: Tables):
    sums = w.second_sums(t.events, "user_id", "ts", "cents", width=3600)
    return h.stream_stability(sums, playback(t), "user_id", "second", "nbytes", expected_bps=2500, max_stall=48)


@query("h5_bucket_seconds", f"WITH {EV}, {HOURS} SELECT * FROM bk")
def _(t: Tables):
    return buckets(t)


@query(
    "w13_longest_run",
    f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id)
        - row_number() OVER (PARTITION BY user_id, k < 60 ORDER BY event_id) AS g FROM ev),
      n AS (SELECT user_id, COUNT(*) AS n FROM r WHERE k < 60 GROUP BY user_id, g)
    SELECT e.user_id, COALESCE(MAX(n), 0) AS longest_run FROM (SELECT DISTINCT user_id FROM ev) e LEFT JOIN n ON e.user_id = n.user_id GROUP BY e.user_id""",
)
def _(t: Tables):
    return h.longest_run(t.events, "user_id", ["event_id"], F.col("k") < 60)


@query(
    "w14_is_rising",
    f"""WITH {EV}, s AS (SELECT user_id, event_id, CASE WHEN user_id % 3 = 0 THEN cents WHEN user_id % 3 = 1 THEN event_id ELSE 7 END AS v FROM ev),
      l AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s)
    SELECT user_id, bool_and(before IS NULL OR v >= before) AND COUNT(*) >= 2 AND arg_max(v, event_id) > arg_min(v, event_id) AS rising FROM l GROUP BY user_id""",
)
def _(t: Tables):
    v = F.expr("case when user_id % 3 = 0 then cents when user_id % 3 = 1 then event_id else 7 end")
    return h.is_rising(t.events.withColumn("v", v), "user_id", ["event_id"], "v")


@query(
    "a10_swarm_health",
    f"WITH {EV}, {HEALTH} SELECT *, status_ok AND peers_ok AND downloaded_rising AS passed FROM ha",
)
def _(t: Tables):
    return health(t)


@query(
    "a11_swarm_reciprocates",
    f"WITH {EV}, {HEALTH} SELECT user_id % 20 AS swarm, bool_or(upload_positive) AS reciprocates FROM ha GROUP BY ALL",
)
def _(t: Tables):
    return h.swarm_reciprocates(health(t).withColumn("swarm", F.col("user_id") % 20), "swarm")


@query(
    "a12_stability_zero_filled",
    f"WITH {EV}, {HOURS}, {STABLE} SELECT *, throughput_ok AND stall_ok AS passed FROM st",
)
def _(t: Tables):
    return h.stream_stability(buckets(t), playback(t), "user_id", "second", "nbytes", expected_bps=2500, max_stall=48)


@query(
    "a12_stream_stability",
    f"WITH {EV}, {HOURS}, {STABLE} SELECT *, throughput_ok AND stall_ok AS passed FROM st",
)
def _(t: Tables):
    return stability(t)


@query(
    "a13_packet_contiguity",
    # The places of all sync bytes, from the bytes between them; then four of them a packet apart.
    """WITH d AS (SELECT doc_id, repeat('x', CAST(doc_id % 188 AS INTEGER)) || repeat('G' || repeat('.', 187), CAST(doc_id % 7 AS INTEGER)) || text AS x FROM documents),
    s AS (SELECT doc_id, unnest(list_transform(string_split(x, 'G'), lambda p: strlen(p) + 1)) AS step, generate_subscripts(string_split(x, 'G'), 1) AS i FROM d),
    g AS (SELECT doc_id, CAST(SUM(step) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS o FROM s),
    c AS (SELECT DISTINCT a.doc_id FROM g a JOIN g b ON b.doc_id = a.doc_id AND b.o = a.o + 188 JOIN g e ON e.doc_id = a.doc_id AND e.o = a.o + 376
      JOIN g f ON f.doc_id = a.doc_id AND f.o = a.o + 564 JOIN d ON d.doc_id = a.doc_id WHERE f.o <= strlen(d.x))
    SELECT d.doc_id, strlen(x) AS n, strlen(x) >= 752 AND c.doc_id IS NOT NULL AS contiguous FROM d LEFT JOIN c ON c.doc_id = d.doc_id""",
)
def _(t: Tables):
    head = F.expr("concat(repeat('x', cast(doc_id % 188 as int)), repeat(concat('G', repeat('.', 187)), cast(doc_id % 7 as int)), text)")
    df = h.packet_contiguity(t.read("documents").select("doc_id", head.alias("head")), "head")
    return df.select("doc_id", F.octet_length("head").cast("bigint").alias("n"), "contiguous")


def verdicts(t: Tables):
    heads = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.expr("repeat(concat('G', repeat('.', 187)), cast(n % 24 as int))").alias("head")
    )
    return (
        health(t).select("user_id", F.col("passed").alias("health_ok"), "upload_positive")
        .join(stability(t).select("user_id", F.col("passed").alias("stability_ok")), "user_id", "full")
        .join(h.packet_contiguity(heads, "head").select("user_id", "contiguous"), "user_id", "full")
        .withColumn("scenario", F.col("user_id") % 40)
    )


@query(
    "a14_scenario_rollup",
    f"""WITH {EV}, {HOURS}, {HEALTH}, {STABLE}, cg AS (SELECT user_id, COUNT(*) % 24 >= 4 AS contiguous FROM ev GROUP BY user_id),
      vd AS (SELECT ha.user_id % 40 AS scenario, status_ok AND peers_ok AND downloaded_rising AND throughput_ok AND stall_ok AND COALESCE(contiguous, false) AS ok,
        upload_positive FROM ha JOIN st ON ha.user_id = st.user_id LEFT JOIN cg ON ha.user_id = cg.user_id),
      sc AS (SELECT scenario, COUNT(*) AS peers, COUNT(*) FILTER (ok) AS peers_passed, bool_or(upload_positive) AS reciprocates FROM vd GROUP BY scenario),
      ps AS (SELECT *, peers > 0 AND peers = peers_passed AND reciprocates AS passed, false AS overall FROM sc)
    SELECT * FROM ps UNION ALL SELECT NULL, CAST(SUM(peers) AS BIGINT), CAST(SUM(peers_passed) AS BIGINT), bool_and(reciprocates), bool_and(passed), true FROM ps""",
)
def _(t: Tables):
    return h.scenario_rollup(verdicts(t), "scenario", "user_id")


@query(
    "h6_rolling_rates",
    f"""WITH {EV}, x AS (SELECT user_id, cents, epoch_us(ts) // 3600000000 AS h, unnest(range(6)) AS b FROM ev),
      y AS (SELECT user_id, cents, make_timestamp((h - b) * 3600000000) AS start FROM x)
    SELECT user_id, start, start + INTERVAL 6 HOUR AS "end", COUNT(*) AS samples, CAST(SUM(cents) AS BIGINT) AS nbytes FROM y GROUP BY ALL""",
)
def _(t: Tables):
    out = w.rolling_rates(t.events, "user_id", "ts", "cents", "6 hours", "1 hour")
    return out.withColumns(plain_time("start", "end"))


@query(
    "h7_viewer_sessions",
    f"""WITH {EV}, g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM ev),
      s AS (SELECT user_id, ts, SUM(CASE WHEN b IS NULL OR ts - b >= INTERVAL 24 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
    SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL 24 HOUR AS "end", COUNT(*) AS n FROM s GROUP BY user_id, s""",
)
def _(t: Tables):
    return w.viewer_sessions(t.events, "user_id", "ts", 24 * 3600).withColumns(plain_time("start", "end"))


@query("h11_dedupe_deliveries", f"WITH {LI} SELECT DISTINCT piece, chunk FROM li")
def _(t: Tables):
    return w.dedupe_deliveries(t.lineitem, ["piece", "chunk"])


@query(
    "h12_lease_expiry",
    f"""WITH {EV} SELECT user_id, MAX(ts) + INTERVAL 6 HOUR AS expires_at,
      MAX(ts) + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-30 00:00:00' AS expired FROM ev GROUP BY user_id""",
)
def _(t: Tables):
    at = F.lit("2024-01-30 00:00:00").cast("timestamp")
    return w.lease_expiry(t.events, "user_id", "ts", at).withColumns(plain_time("expires_at"))

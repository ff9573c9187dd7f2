"""Media time on events."""

from pyspark.sql import functions as F

from .. import sources as src
from ..operators import media as m
from .base import EV, Tables, plain_time, query

# Clock: cents in ticks; two PIDs; errors flag a break; views are access points.
PK = """pk AS (SELECT user_id, event_id, ts, 256 + k % 2 AS pid, CASE WHEN k % 5 > 0 THEN (event_id * 90000 + cents * 7000000) % 8589934592 END AS pcr,
  event_type = 'error' AS flag, event_type = 'view' AS access, cents FROM ev)"""

CLOCK = """t0 AS (SELECT *, COALESCE(SUM(CASE WHEN flag THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS epoch, NOT flag AND pcr IS NOT NULL AS timed FROM pk),
  t1 AS (SELECT *, first_value(CASE WHEN timed THEN pid END IGNORE NULLS) OVER (PARTITION BY user_id, epoch ORDER BY event_id) AS clock FROM t0),
  t2 AS (SELECT *, timed AND pid = clock AS is_on FROM t1),
  t3 AS (SELECT *, CASE WHEN is_on THEN (pcr - lag(pcr) OVER (PARTITION BY user_id, epoch, is_on ORDER BY event_id) + 8589934592) % 8589934592 END AS step FROM t2),
  t4 AS (SELECT *, CAST(SUM(CASE WHEN flag OR step > 4294967296 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS segment FROM t3),
  t5 AS (SELECT *, CASE WHEN is_on THEN (pcr - first_value(pcr) OVER (PARTITION BY user_id, segment, is_on ORDER BY event_id) + 8589934592) % 8589934592 END AS elapsed FROM t4)"""

# Segments with a fixed shape, for the window and playlist queries.
SG = """sg AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, (cents % 8000 + 2000) / 1000.0::DOUBLE AS duration, event_type = 'error' AS flag FROM ev),
  mx AS (SELECT user_id, COUNT(*) AS total, MAX(duration) AS longest, COUNT(*) FILTER (flag) AS flags FROM sg GROUP BY user_id),
  lw AS (SELECT sg.*, total - 8 AS media_seq, longest, flags - COUNT(*) FILTER (flag) OVER (PARTITION BY sg.user_id) AS discontinuity_seq FROM sg JOIN mx ON sg.user_id = mx.user_id WHERE seq >= total - 8)"""

AD = """ad AS (SELECT user_id, seq - media_seq AS i, longest, SUM(duration) OVER (PARTITION BY user_id ORDER BY seq DESC) AS suffix FROM lw),
  pick AS (SELECT user_id, MAX(i) AS i FROM ad WHERE i >= 1 AND suffix >= 3 * ceil(longest) GROUP BY user_id),
  st AS (SELECT u.user_id, round(ad.suffix, 3) AS start_offset FROM (SELECT DISTINCT user_id FROM lw) u LEFT JOIN pick ON u.user_id = pick.user_id
    LEFT JOIN ad ON ad.user_id = pick.user_id AND ad.i = CASE WHEN pick.i > 1 THEN pick.i - 1 ELSE pick.i END)"""


def packets(t: Tables):
    return t.events.select(
        "user_id", "event_id", "ts", "cents", (256 + F.col("k") % 2).alias("pid"),
        F.when(F.col("k") % 5 > 0, F.pmod(F.col("event_id") * 90000 + F.col("cents") * 7_000_000, F.lit(1 << 33))).alias("pcr"),
        (F.col("event_type") == "error").alias("flag"), (F.col("event_type") == "view").alias("access"),
    )


def clocked(t: Tables):
    return m.pcr_segments(packets(t), "user_id", ["event_id"], "pid", "pcr", "flag")


def segments(t: Tables):
    from pyspark.sql import Window as W

    seq = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    return t.events.select(
        "user_id", seq.cast("bigint").alias("seq"), ((F.col("cents") % 8000 + 2000) / 1000).alias("duration"),
        (F.col("event_type") == "error").alias("flag"),
    )


@query("w1_pcr_segments", f"WITH {EV}, {PK}, {CLOCK} SELECT user_id, event_id, segment, elapsed FROM t5")
def _(t: Tables):
    return clocked(t).select("user_id", "event_id", "segment", "elapsed")


W2_SQL = f"""WITH RECURSIVE {EV}, p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, event_id AS pkt,
    CASE WHEN k % 5 > 0 THEN event_id * 900 + cents // 1000 END AS pcr, event_type = 'error' AND k % 4 = 0 AS flag, event_type = 'view' AS access FROM ev),
  f AS (
    SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS opened, NULL::BIGINT AS origin, NULL::BIGINT AS latest, FALSE AS pending, 0::BIGINT AS seq,
      NULL::BIGINT AS e_start, NULL::BIGINT AS e_end, NULL::BIGINT AS e_ticks, FALSE AS e_disc FROM (SELECT DISTINCT user_id FROM p)
    UNION ALL
    SELECT x.user_id, x.rn,
      CASE WHEN x.flag THEN NULL WHEN x.opened IS NULL THEN CASE WHEN x.access THEN x.pkt END WHEN x.emits THEN x.pkt ELSE x.opened END,
      CASE WHEN x.flag THEN NULL WHEN x.opened IS NULL THEN CASE WHEN x.access THEN x.pcr END WHEN x.emits THEN x.now ELSE COALESCE(x.origin, x.pcr) END,
      CASE WHEN x.flag THEN NULL WHEN x.opened IS NULL THEN CASE WHEN x.access THEN x.pcr END ELSE x.now END,
      x.flag OR (x.pending AND NOT x.emits), x.seq + CASE WHEN x.emits THEN 1 ELSE 0 END,
      CASE WHEN x.emits THEN x.opened END, CASE WHEN x.emits THEN x.pkt - 1 END, CASE WHEN x.emits THEN x.now - x.origin END, x.pending AND x.emits
    FROM (SELECT p.user_id, p.rn, p.pkt, p.pcr, p.flag, p.access, f.opened, f.origin, f.pending, f.seq, COALESCE(p.pcr, f.latest) AS now,
        NOT p.flag AND f.opened IS NOT NULL AND p.access AND COALESCE(COALESCE(p.pcr, f.latest) - COALESCE(f.origin, p.pcr) >= 540000, FALSE) AS emits
      FROM f JOIN p ON p.user_id = f.user_id AND p.rn = f.rn + 1) x)
  SELECT user_id, seq - 1 AS seq, e_start AS start_pkt, e_end AS end_pkt, round(e_ticks / 90000, 3) AS duration, e_disc AS discontinuity FROM f WHERE e_start IS NOT NULL"""


@query("w2_hls_segments", W2_SQL)
def _(t: Tables):
    """One PID, no packet limit."""
    df = t.events.select(
        "user_id", F.col("event_id").alias("pkt"), F.lit(256).alias("pid"),
        F.when(F.col("k") % 5 > 0, F.col("event_id") * 900 + F.expr("cents div 1000")).alias("pcr"),
        (F.col("event_type") == "view").alias("access"),
        ((F.col("event_type") == "error") & (F.col("k") % 4 == 0)).alias("flag"),
    )
    return m.hls_segments(df, "user_id", "pkt", "pid", "pcr", "access", "flag", 6.0)


# Every packet in turn, with the clock's PID and the limit of 2,000 packets, two of them tables.
W2_LIMITED_SQL = f"""WITH RECURSIVE {EV}, {PK}, p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
    event_id AS pkt, pid, pcr, flag, access FROM pk),
  e AS (SELECT user_id, rn, pkt, pid, pcr, flag, access, FALSE AS plain FROM p),
  f AS (
    SELECT user_id, 1::BIGINT AS rn, NULL::BIGINT AS opened, NULL::BIGINT AS clock, NULL::BIGINT AS origin, NULL::BIGINT AS latest, FALSE AS pending,
      0::BIGINT AS seq, NULL::BIGINT AS e_start, NULL::BIGINT AS e_end, NULL::BIGINT AS e_ticks, FALSE AS e_disc FROM (SELECT DISTINCT user_id FROM p)
    UNION ALL
    SELECT y.user_id, CASE WHEN forced THEN y.rn ELSE y.rn + 1 END,
      CASE WHEN emits THEN here WHEN drops THEN CASE WHEN reopens THEN here END WHEN y.opened IS NULL THEN CASE WHEN starts THEN here END ELSE y.opened END,
      CASE WHEN emits THEN now_clock WHEN drops OR y.opened IS NULL THEN CASE WHEN (reopens OR starts) AND pcr IS NOT NULL THEN pid END ELSE now_clock END,
      CASE WHEN emits THEN now WHEN drops OR y.opened IS NULL THEN CASE WHEN reopens OR starts THEN pcr END ELSE now_origin END,
      CASE WHEN emits THEN now WHEN drops OR y.opened IS NULL THEN CASE WHEN reopens OR starts THEN pcr END ELSE now END,
      CASE WHEN emits THEN FALSE WHEN drops THEN TRUE ELSE y.pending END, y.seq + CASE WHEN emits THEN 1 ELSE 0 END,
      CASE WHEN emits THEN y.opened END, CASE WHEN emits THEN here - 1 END, CASE WHEN emits THEN ticks END, y.pending AND emits
    FROM (
      SELECT *, NOT forced AND flag OR (opened IS NOT NULL AND (back OR (capped AND NOT reached))) AS drops,
        opened IS NOT NULL AND NOT back AND NOT (flag AND NOT forced) AND reached AND (capped OR (access AND NOT forced)) AS emits,
        opened IS NOT NULL AND NOT forced AND NOT flag AND NOT back AND capped AND NOT reached AND access AS reopens,
        opened IS NULL AND NOT flag AND access AS starts
      FROM (
        SELECT *, forced OR COALESCE(opened + 1998 = pkt, FALSE) AS capped, CASE WHEN forced THEN opened + 1998 ELSE pkt END AS here,
          COALESCE(ticks <= 4294967296 AND ticks >= 540000, FALSE) AS reached
        FROM (
          SELECT *, (now - now_origin + 8589934592) % 8589934592 AS ticks
          FROM (
            SELECT *, CASE WHEN ticked THEN pcr ELSE latest END AS now, CASE WHEN ticked THEN pid ELSE clock END AS now_clock,
              CASE WHEN ticked THEN COALESCE(origin, pcr) ELSE origin END AS now_origin,
              ticked AND COALESCE((pcr - latest + 8589934592) % 8589934592 > 4294967296, FALSE) AS back
            FROM (
              SELECT f.user_id, f.rn, f.opened, f.clock, f.origin, f.latest, f.pending, f.seq, e.pkt, e.pid, e.pcr, e.flag, e.access,
                COALESCE(f.opened + 1998 < e.pkt, FALSE) AS forced,
                NOT COALESCE(f.opened + 1998 < e.pkt, FALSE) AND NOT e.flag AND e.pcr IS NOT NULL AND COALESCE(f.clock = e.pid, TRUE) AS ticked
              FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn))))) y)
  SELECT user_id, seq - 1 AS seq, e_start AS start_pkt, e_end AS end_pkt, round(e_ticks / 90000, 3) AS duration, e_disc AS discontinuity FROM f WHERE e_start IS NOT NULL"""


@query("w2_hls_segments_limited", W2_LIMITED_SQL)
def _(t: Tables):
    """With a packet limit and two PIDs."""
    return m.hls_segments(packets(t), "user_id", "event_id", "pid", "pcr", "access", "flag", 6.0, 2000)


@query(
    "w3_hls_live_window",
    f"WITH {EV}, {SG} SELECT user_id, seq, duration, flag, media_seq, discontinuity_seq FROM lw",
)
def _(t: Tables):
    return m.hls_live_window(segments(t), "user_id", "seq", "flag")


@query("w4_advisory_start", f"WITH {EV}, {SG}, {AD} SELECT * FROM st")
def _(t: Tables):
    window = m.hls_live_window(segments(t), "user_id", "seq", "flag")
    longest = segments(t).groupBy("user_id").agg(F.max("duration").alias("longest"))
    return m.advisory_start(window, "user_id", "seq", "duration", longest)


@query(
    "s8_media_playlist",
    f"""WITH {EV}, {SG} SELECT user_id, -4::BIGINT AS line_no, '#EXTM3U' AS line FROM mx UNION ALL SELECT user_id, -3, '#EXT-X-VERSION:3' FROM mx
    UNION ALL SELECT user_id, -2, '#EXT-X-TARGETDURATION:' || CAST(greatest(ceil(longest), 1) AS BIGINT) FROM mx
    UNION ALL SELECT user_id, -1, '#EXT-X-MEDIA-SEQUENCE:0' FROM mx
    UNION ALL SELECT user_id, seq * 2, '#EXTINF:' || printf('%.3f', duration) || ',' FROM sg
    UNION ALL SELECT user_id, seq * 2 + 1, 'seg' || seq || '.ts' FROM sg
    UNION ALL SELECT user_id, total * 2, '#EXT-X-ENDLIST' FROM mx""",
)
def _(t: Tables):
    return src.render_media_playlist(segments(t), "user_id", "seq", "duration", live=False)


@query(
    "s9_live_playlist",
    f"""WITH {EV}, {SG}, {AD}, hd AS (SELECT DISTINCT lw.user_id, longest, media_seq, discontinuity_seq, start_offset FROM lw JOIN st ON lw.user_id = st.user_id)
    SELECT user_id, -6::BIGINT AS line_no, '#EXTM3U' AS line FROM hd UNION ALL SELECT user_id, -5, '#EXT-X-VERSION:3' FROM hd
    UNION ALL SELECT user_id, -4, '#EXT-X-TARGETDURATION:' || CAST(ceil(longest) AS BIGINT) FROM hd
    UNION ALL SELECT user_id, -3, '#EXT-X-START:TIME-OFFSET=-' || printf('%.3f', start_offset) || ',PRECISE=NO' FROM hd WHERE start_offset IS NOT NULL
    UNION ALL SELECT user_id, -2, '#EXT-X-MEDIA-SEQUENCE:' || media_seq FROM hd
    UNION ALL SELECT user_id, -1, '#EXT-X-DISCONTINUITY-SEQUENCE:' || discontinuity_seq FROM hd WHERE discontinuity_seq <> 0
    UNION ALL SELECT user_id, seq * 3, '#EXT-X-DISCONTINUITY' FROM lw WHERE flag
    UNION ALL SELECT user_id, seq * 3 + 1, '#EXTINF:' || printf('%.3f', duration) || ',' FROM lw
    UNION ALL SELECT user_id, seq * 3 + 2, 'seg/' || seq || '.ts' FROM lw""",
)
def _(t: Tables):
    return src.render_live_playlist(segments(t), "user_id", "seq", "duration", "flag")


@query(
    "w11_startup_release",
    f"""WITH {EV}, {PK}, {CLOCK}, r0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
        COALESCE(CAST(SUM(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS prior FROM t5),
      r1 AS (SELECT *, rn = 1 OR segment <> lag(segment) OVER (PARTITION BY user_id ORDER BY event_id) AS opens FROM r0),
      r2 AS (SELECT *, last_value(CASE WHEN opens THEN ts END IGNORE NULLS) OVER w AS from_t, last_value(CASE WHEN opens THEN prior END IGNORE NULLS) OVER w AS from_b FROM r1 WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
      r3 AS (SELECT *, lag(from_t) OVER w AS was_t, lag(from_b) OVER w AS was_b FROM r2 WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
      r4 AS (SELECT *, COALESCE(was_t + INTERVAL 48 HOUR <= ts, FALSE) AS expired, prior + cents - from_b AS queued FROM r3),
      r5 AS (SELECT *, CASE WHEN expired THEN 'Deadline' WHEN queued > 120000 THEN 'ByteLimit' WHEN COALESCE(elapsed, 0) >= 1800000000 THEN 'TargetDuration' END AS reason,
        CASE WHEN expired THEN was_t + INTERVAL 48 HOUR ELSE ts END AS rel, CASE WHEN expired THEN prior - was_b ELSE queued END AS q FROM r4),
      r6 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY reason IS NULL, CASE WHEN reason IS NULL THEN -rn ELSE rn END) AS pick FROM r5)
    SELECT user_id, rel AS released_at, COALESCE(reason, 'EndOfStream') AS reason, q AS queued FROM r6 WHERE pick = 1""",
)
def _(t: Tables):
    out = m.startup_release(
        clocked(t), "user_id", ["event_id"], "ts", "cents", "elapsed", "segment", 20_000_000, 120_000, 48 * 3600 * 1000,
    )
    return out.withColumns(plain_time("released_at"))


@query(
    "w12_stall_intervals",
    f"""WITH {EV}, o AS (SELECT user_id, event_id, ts, k >= 10 AND event_type IN ('view', 'click', 'purchase') AS out, event_type <> 'error' AS act FROM ev),
      s AS (SELECT *, SUM(CASE WHEN out THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM o),
      p AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS b,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM s WHERE out OR (n = 0 AND act))
    SELECT user_id, b AS stalled_from, b + INTERVAL 24 HOUR AS stale_at, ts AS resumed_at FROM p WHERE ts - b >= INTERVAL 24 HOUR
    UNION ALL SELECT user_id, ts, ts + INTERVAL 24 HOUR, NULL FROM p WHERE back = 1 AND TIMESTAMP '2024-01-31 00:00:00' - ts >= INTERVAL 24 HOUR""",
)
def _(t: Tables):
    df = t.events.withColumns(
        {"out": (F.col("k") >= 10) & F.col("event_type").isin("view", "click", "purchase"), "act": F.col("event_type") != "error"}
    )
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    out = m.stall_intervals(df, "user_id", ["event_id"], "ts", "out", "act", now, 24 * 3600)
    return out.withColumns(plain_time("stalled_from", "stale_at", "resumed_at"))

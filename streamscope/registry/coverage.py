"""Windows and candidates."""

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import peers as p
from .base import EV, LI, WN, Tables, query
from .delivery import expected, held


@query(
    "j2_window_coverage",
    f"WITH {WN} SELECT o_orderkey AS piece, peer FROM orders JOIN wn ON o_orderkey BETWEEN min_piece AND max_piece AND unchoked",
)
def _(t: Tables):
    out = p.window_coverage(
        expected(t).select("stream", "piece"), t.windows, "stream", "piece", "min_piece", "max_piece", "unchoked"
    )
    return out.select("piece", "peer")


@query(
    "j2_window_coverage_wide",
    """WITH w AS (SELECT p_partkey AS peer, p_partkey AS a, p_partkey + CASE WHEN p_size = 50 THEN 1000000000 WHEN p_size = 49 THEN 9000 ELSE p_size END AS b FROM part)
    SELECT o_orderkey AS piece, COUNT(*) AS peers FROM orders JOIN w ON o_orderkey BETWEEN a AND b GROUP BY ALL""",
)
def _(t: Tables):
    """Windows of very different width, counted per piece."""
    width = F.when(F.col("p_size") == 50, 1_000_000_000).when(F.col("p_size") == 49, 9000).otherwise(F.col("p_size"))
    w = t.part.select(
        F.lit("live").alias("stream"), F.col("p_partkey").alias("peer"), F.col("p_partkey").alias("a"),
        (F.col("p_partkey") + width).alias("b"),
    )
    out = p.coverage_counts(expected(t).select("stream", "piece"), w, "stream", "piece", "a", "b")
    return out.filter("peers > 0").select("piece", "peers")


@query("j3_lowest_covered", f"WITH {WN} SELECT peer % 8 AS stream, MIN(min_piece) AS lowest FROM wn WHERE unchoked GROUP BY ALL")
def _(t: Tables):
    return p.lowest_covered(t.windows.withColumn("stream", F.col("peer") % 8), "stream", "min_piece", "unchoked")


@query("j5_refill_candidates", f"WITH {LI} SELECT o_orderkey AS peer FROM orders WHERE o_orderkey NOT IN (SELECT piece FROM li WHERE header > 2) AND o_orderkey NOT IN (SELECT piece FROM li WHERE peer < 50)")
def _(t: Tables):
    known = t.orders.select(F.col("o_orderkey").alias("peer"))
    excluded = t.lineitem.filter("header > 2").select(F.col("piece").alias("peer"))
    active = t.lineitem.filter("peer < 50").select(F.col("piece").alias("peer"))
    return p.refill_candidates(known, excluded, active, ["peer"])


@query(
    "j6_reconnect_candidates",
    f"""WITH {LI}, kn AS (SELECT o_orderkey % 3 AS stream, o_orderkey AS peer FROM orders),
      ex AS (SELECT peer FROM kn WHERE stream = 0 UNION SELECT piece FROM li),
      lf AS (SELECT * FROM kn WHERE peer NOT IN (SELECT peer FROM ex))
    SELECT * FROM lf UNION ALL SELECT * FROM kn WHERE stream NOT IN (SELECT stream FROM lf)""",
)
def _(t: Tables):
    known = t.orders.select((F.col("o_orderkey") % 3).alias("stream"), F.col("o_orderkey").alias("peer"))
    delivered = t.lineitem.select((F.col("piece") % 3).alias("stream"), F.col("piece").alias("peer"))
    excluded = known.filter("stream = 0").unionByName(delivered)
    return p.reconnect_candidates(known, excluded, "stream", "peer")


@query(
    "w9_rank_by_coverage",
    """WITH a AS (SELECT p_partkey % 5 AS stream, p_partkey AS peer, CASE WHEN p_size % 4 > 0 THEN p_partkey END AS mn, CASE WHEN p_size % 4 > 0 THEN p_partkey + p_size * 20 END AS mx FROM part)
    SELECT stream, peer, row_number() OVER (PARTITION BY stream ORDER BY CASE WHEN mn IS NULL THEN 1 WHEN 1000 BETWEEN mn AND mx THEN 0 ELSE 2 END, peer) AS rank FROM a""",
)
def _(t: Tables):
    adverts = t.part.select(
        (F.col("p_partkey") % 5).alias("stream"), F.col("p_partkey").alias("peer"),
        F.expr("case when p_size % 4 > 0 then p_partkey end").alias("mn"),
        F.expr("case when p_size % 4 > 0 then p_partkey + p_size * 20 end").alias("mx"),
        F.lit(1000).alias("needed"),
    )
    return p.rank_by_coverage(adverts, "stream", "peer", "mn", "mx", "needed").select("stream", "peer", "rank")


@query(
    "a22_prefer_window",
    """WITH w AS (SELECT p_partkey % 50 AS stream, p_partkey AS peer, CAST(p_size // 5 AS BIGINT) AS max_piece, CAST(p_size % 5 AS BIGINT) AS position, p_partkey % 3 AS distance FROM part),
      r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY max_piece DESC, position DESC, distance, peer) AS n FROM w)
    SELECT stream, peer, max_piece, position, distance FROM r WHERE n = 1""",
)
def _(t: Tables):
    w = t.part.selectExpr(
        "p_partkey % 50 as stream", "p_partkey as peer", "cast(p_size div 5 as bigint) as max_piece",
        "cast(p_size % 5 as bigint) as position", "p_partkey % 3 as distance",
    )
    return p.prefer_window(w, "stream", "max_piece", "position", "distance", "peer")


@query(
    "w15_evicted_gap_skips",
    f"""WITH {WN}, f AS (SELECT o_orderkey AS reader, o_custkey % 4 AS stream, o_orderkey % 2200 - 200 AS nxt, o_orderdate AS since FROM orders),
      u AS (SELECT peer % 4 AS stream, min_piece + 300 * (peer % 4) AS a, max_piece + 300 * (peer % 4) AS b FROM wn WHERE unchoked),
      fl AS (SELECT stream, MIN(a) AS lo FROM u GROUP BY stream)
    SELECT reader, f.stream, nxt, lo AS jump_to FROM f JOIN fl ON f.stream = fl.stream WHERE since <= TIMESTAMP '1998-06-01' - INTERVAL 2 SECOND AND lo > nxt
      AND NOT EXISTS (SELECT 1 FROM u WHERE u.stream = f.stream AND nxt BETWEEN a AND b)""",
)
def _(t: Tables):
    readers = t.orders.select(
        F.col("o_orderkey").alias("reader"), (F.col("o_custkey") % 4).alias("stream"),
        (F.col("o_orderkey") % 2200 - 200).alias("nxt"), F.col("o_orderdate").cast("timestamp").alias("since"),
    )
    shift = 300 * (F.col("peer") % 4)
    windows = t.windows.select(
        (F.col("peer") % 4).alias("stream"), (F.col("min_piece") + shift).alias("a"), (F.col("max_piece") + shift).alias("b"), "unchoked"
    )
    out = p.evicted_gap_skips(
        readers, windows, "stream", "nxt", "since", F.lit("1998-06-01").cast("timestamp"), "2 seconds", "a", "b", "unchoked"
    )
    return out.select("reader", "stream", "nxt", "jump_to")


@query(
    "w17_window_resume_ok",
    f"WITH {WN} SELECT peer, max_piece >= 1000 + peer % 20 OR (1000 + peer % 20 > 1005 AND max_piece >= 1005) AS ok FROM wn",
)
def _(t: Tables):
    return t.windows.select(
        "peer", fn.window_resume_ok("max_piece", 1000 + F.col("peer") % 20, F.lit(1005)).alias("ok")
    )


def interest(t: Tables):
    return t.events.groupBy("event_type", "user_id").agg(F.min("event_id").alias("first"))


@query(
    "w8_choose_unchoked",
    f"""WITH {EV}, i AS (SELECT event_type, user_id, MIN(event_id) AS first FROM ev GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first) AS n, COUNT(*) OVER (PARTITION BY event_type) AS total FROM i)
    SELECT event_type, user_id, n > 4 AS optimistic FROM r WHERE n <= 4 OR n = 5 + 777 % (total - 4)""",
)
def _(t: Tables):
    return p.choose_unchoked(interest(t), ["event_type"], "user_id", "first", 4, 777).drop("first")


@query(
    "h13_rechoke_rounds",
    f"""WITH {EV}, i AS (SELECT event_type, epoch_us(ts) // 1000000 // 43200 AS tick, user_id, MIN(ts) AS first FROM ev GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY event_type, tick ORDER BY first) AS n, COUNT(*) OVER (PARTITION BY event_type, tick) AS total FROM i)
    SELECT event_type, CAST(tick AS BIGINT) AS tick, user_id, n > 4 AS optimistic FROM r WHERE n <= 4 OR n = 5 + tick % greatest(total - 4, 1)""",
)
def _(t: Tables):
    return p.rechoke_rounds(t.events, "event_type", "user_id", "ts", 43200, 4)


@query(
    "k1_take_trackers",
    """WITH u AS (SELECT page_id % 3 AS stream, page_id, CASE WHEN page_id % 2 = 0 THEN replace(replace(url, 'https://', 'udp://'), 'http://', 'udp://')
        WHEN page_id % 5 = 0 THEN 'UDP://x' ELSE url END || CASE WHEN page_id % 7 = 0 THEN repeat('y', 250) ELSE '' END AS url FROM pages),
      r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY page_id) AS rank FROM u)
    SELECT * FROM r WHERE rank <= 64 AND strlen(url) <= 256 AND starts_with(url, 'udp://')""",
)
def _(t: Tables):
    url = F.expr(
        "case when page_id % 2 = 0 then replace(replace(url, 'https://', 'udp://'), 'http://', 'udp://') "
        "when page_id % 5 = 0 then 'UDP://x' else url end || case when page_id % 7 = 0 then repeat('y', 250) else '' end"
    )
    df = t.read("pages").select((F.col("page_id") % 3).alias("stream"), "page_id", url.alias("url"))
    return p.take_trackers(df, "stream", "page_id", "url").withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "k3_retry_candidates",
    f"""WITH {EV}, a AS (SELECT event_type, user_id, MIN(event_id) AS event_id FROM ev GROUP BY ALL),
      f AS (SELECT * FROM a WHERE user_id % 3 > 0 AND (event_type, user_id) NOT IN (SELECT event_type, user_id FROM ev WHERE k = 9)),
      r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank FROM f)
    SELECT * FROM r WHERE rank <= 16""",
)
def _(t: Tables):
    ev = t.events.select("event_type", "user_id", "event_id", "k")
    active, tried = ev.filter("user_id % 3 = 0"), ev.filter("k = 9")
    out = p.retry_candidates(ev, active, tried, "event_type", "user_id", "event_id", 16)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "u1_merge_sources",
    """WITH a AS (SELECT DISTINCT s_nationkey AS stream, s_suppkey AS peer FROM supplier), b AS (SELECT c_nationkey AS stream, c_custkey AS peer FROM customer),
      e AS (SELECT stream FROM a GROUP BY stream HAVING COUNT(*) >= 5)
    SELECT CAST(stream AS BIGINT) AS stream, peer FROM a UNION SELECT stream, peer FROM b WHERE stream NOT IN (SELECT stream FROM e)""",
)
def _(t: Tables):
    a = t.read("supplier").selectExpr("cast(s_nationkey as bigint) as stream", "s_suppkey as peer")
    b = t.read("customer").selectExpr("cast(c_nationkey as bigint) as stream", "c_custkey as peer")
    return p.merge_sources(a, b, "stream", "peer", 5)


@query(
    "u2_merge_discovered",
    f"""WITH {EV}, kn AS (SELECT event_type, user_id, MIN(event_id) AS event_id FROM ev WHERE k < 20 GROUP BY ALL),
      fo AS (SELECT event_type, user_id, MIN(event_id) AS event_id FROM ev WHERE k >= 20 GROUP BY ALL)
    SELECT event_type, user_id, FALSE AS added, event_id FROM kn UNION ALL SELECT event_type, user_id, TRUE, event_id FROM fo
    WHERE (event_type, user_id) NOT IN (SELECT event_type, user_id FROM kn)""",
)
def _(t: Tables):
    return p.merge_discovered(t.events.filter("k < 20"), t.events.filter("k >= 20"), "event_type", "user_id", "event_id")


@query(
    "u3_rediscovery_reset",
    f"""WITH {EV}, s AS (SELECT user_id % 30 AS stream, k AS peer, event_type FROM ev),
      kn AS (SELECT DISTINCT stream, peer FROM s WHERE event_type <> 'error' OR stream % 2 = 0), fo AS (SELECT DISTINCT stream, peer FROM s WHERE event_type = 'error'),
      fr AS (SELECT DISTINCT stream FROM fo WHERE (stream, peer) NOT IN (SELECT stream, peer FROM kn))
    SELECT DISTINCT stream, peer FROM s WHERE event_type = 'view' AND stream IN (SELECT stream FROM fr)""",
)
def _(t: Tables):
    s = t.events.select((F.col("user_id") % 30).alias("stream"), F.col("k").alias("peer"), "event_type")
    known, found = s.filter("event_type <> 'error' or stream % 2 = 0"), s.filter("event_type = 'error'")
    excluded = s.filter("event_type = 'view'").select("stream", "peer").distinct()
    return p.rediscovery_reset(known, found, excluded, "stream", "peer")

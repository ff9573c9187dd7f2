"""Chunk deliveries, requests and retention on lineitem and orders."""

from pyspark.sql import functions as F

from ..operators import delivery as d
from .base import LI, Tables, plain_time, query

# Chunks 0..6 of each piece; a piece is complete with four distinct chunks.
COMPLETE = f"""{LI}, cp AS (SELECT 'live' AS stream, piece, COUNT(DISTINCT chunk - 1) AS chunks FROM li
  WHERE chunk - 1 BETWEEN 0 AND 3 GROUP BY piece), ok AS (SELECT stream, piece FROM cp WHERE chunks >= 4)"""


def deliveries(t: Tables):
    return t.lineitem.withColumn("stream", F.lit("live")).withColumn("chunk", F.col("chunk") - 1)


def completeness(t: Tables):
    return d.piece_completeness(deliveries(t), "stream", "piece", "chunk", 4)


def complete(t: Tables):
    return completeness(t).filter("complete").select("stream", "piece")


def held(t: Tables):
    """Pieces with any delivery."""
    return deliveries(t).select("stream", "piece").distinct()


def expected(t: Tables):
    return t.orders.select(F.lit("live").alias("stream"), F.col("o_orderkey").alias("piece"), "o_orderdate")


@query("a1_piece_completeness", f"WITH {COMPLETE} SELECT stream, piece, chunks, chunks >= 4 AS complete FROM cp")
def _(t: Tables):
    return completeness(t)


@query(
    "a1_piece_completeness_wide",
    f"""WITH {LI} SELECT peer % 10 AS stream, part AS piece, COUNT(DISTINCT chunk * 20 + nbytes % 20) AS chunks,
      COUNT(DISTINCT chunk * 20 + nbytes % 20) >= 160 AS complete FROM li GROUP BY ALL""",
)
def _(t: Tables):
    """More than 64 chunks per piece: no bit mask."""
    df = t.lineitem.select(
        (F.col("peer") % 10).alias("stream"), F.col("part").alias("piece"),
        (F.col("chunk") * 20 + F.col("nbytes") % 20).alias("chunk"),
    )
    return d.piece_completeness(df, "stream", "piece", "chunk", 160)


@query(
    "a2_covered_bytes",
    f"""WITH {LI}, b AS (SELECT piece, (chunk - 1) * 12 AS s, (chunk - 1) * 12 + nbytes - 2 AS e FROM li),
      v AS (SELECT *, e > s AND e <= 84 AS ok FROM b),
      g AS (SELECT piece, s, e, MAX(e) OVER (PARTITION BY piece ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
        FROM v WHERE ok),
      c AS (SELECT piece, CAST(SUM(greatest(e - greatest(s, COALESCE(m, 0)), 0)) AS BIGINT) AS covered FROM g GROUP BY piece)
    SELECT v.piece, COALESCE(MAX(c.covered), 0) AS covered, COUNT(*) FILTER (NOT ok) AS rejected,
      COALESCE(MAX(c.covered), 0) = 84 AS complete FROM v LEFT JOIN c ON v.piece = c.piece GROUP BY v.piece""",
)
def _(t: Tables):
    blocks = t.lineitem.select(
        "piece", ((F.col("chunk") - 1) * 12).alias("begin"), (F.col("nbytes") - 2).alias("nbytes")
    )
    return d.covered_bytes(blocks, ["piece"], "begin", "nbytes", 84)


@query("a3_piece_window", f"WITH {LI} SELECT part % 4 AS stream, MIN(piece) AS min_piece, MAX(piece) AS max_piece FROM li GROUP BY ALL")
def _(t: Tables):
    df = t.lineitem.select((F.col("part") % 4).alias("stream"), "piece")
    return d.piece_window(df, "stream", "piece")


@query("a3_complete_window", f"WITH {COMPLETE} SELECT stream, MIN(piece) AS min_piece, MAX(piece) AS max_piece FROM ok GROUP BY ALL")
def _(t: Tables):
    return d.piece_window(complete(t), "stream", "piece")


@query(
    "a19_source_stats",
    f"""WITH {LI} SELECT part % 4 AS stream, COUNT(DISTINCT peer) AS peers_served, CAST(SUM(nbytes) AS BIGINT) AS downloaded,
      CAST(SUM(header) AS BIGINT) AS uploaded FROM li GROUP BY ALL""",
)
def _(t: Tables):
    df = t.lineitem.withColumn("stream", F.col("part") % 4)
    return d.source_stats(df, "stream", "peer", "nbytes", "header")


@query(
    "a23_piece_header",
    f"""WITH {LI}, r AS (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY ts, chunk, cents, part, header) AS rn
      FROM li WHERE header <> 0), f AS (SELECT piece, header FROM r WHERE rn = 1)
    SELECT p.piece, COALESCE(f.header, 0) AS header FROM (SELECT DISTINCT piece FROM li) p LEFT JOIN f ON p.piece = f.piece""",
)
def _(t: Tables):
    return d.piece_header(t.lineitem, ["piece"], "header", ["ts", "chunk", "cents", "part", "header"])


@query(
    "w5_contiguous_frontier",
    f"""WITH {LI}, h AS (SELECT DISTINCT piece FROM li), g AS (SELECT piece, piece - row_number() OVER (ORDER BY piece) AS g FROM h WHERE piece >= 57)
    SELECT 'live' AS stream, CASE WHEN MIN(piece) = 57 THEN MAX(piece) FILTER (g = (SELECT MIN(g) FROM g)) + 1
      ELSE 57 END AS next_piece FROM g""",
)
def _(t: Tables):
    return d.contiguous_frontier(deliveries(t), "stream", "piece", 57)


@query(
    "w5_complete_frontier",
    f"""WITH {LI}, h AS (SELECT DISTINCT piece // 100 AS stream, piece % 100 AS piece FROM li),
      c AS (SELECT stream, 3 AS piece FROM (SELECT DISTINCT stream FROM h) UNION SELECT stream, piece + 1 FROM h WHERE piece >= 3)
    SELECT c.stream, CAST(MIN(c.piece) AS BIGINT) AS next_piece FROM c LEFT JOIN h ON c.stream = h.stream AND c.piece = h.piece
    WHERE h.piece IS NULL GROUP BY c.stream""",
)
def _(t: Tables):
    """Many streams of a hundred pieces, read from piece 3."""
    df = t.lineitem.select(F.expr("piece div 100").alias("stream"), (F.col("piece") % 100).alias("piece"))
    return d.contiguous_frontier(df, "stream", "piece", 3)


@query(
    "w10_have_ranges",
    f"""WITH {COMPLETE}, g AS (SELECT piece, piece - row_number() OVER (ORDER BY piece) AS g FROM ok)
    SELECT 'live' AS stream, MIN(piece) AS first_piece, COUNT(*) AS n_pieces FROM g GROUP BY g""",
)
def _(t: Tables):
    # A complete piece had four deliveries at least: more rows than its two edges.
    return d.have_ranges(complete(t), "stream", "piece")


@query(
    "u4_missing_pieces",
    f"""WITH {COMPLETE}, req AS (SELECT DISTINCT piece FROM li WHERE peer = 7)
    SELECT 'live' AS stream, o_orderkey AS piece FROM orders WHERE o_orderkey >= 20
      AND o_orderkey NOT IN (SELECT piece FROM ok) AND o_orderkey NOT IN (SELECT piece FROM req)""",
)
def _(t: Tables):
    need = expected(t).groupBy("stream").agg(F.lit(20).cast("bigint").alias("next"), F.max("piece").alias("head"))
    requested = deliveries(t).filter("peer = 7").select("stream", "piece").distinct()
    return d.missing_pieces(need, complete(t), requested, "stream", "piece", "next", "head")


@query(
    "j4_unserved_requests",
    f"""WITH {LI} SELECT o_orderkey AS piece, o_orderdate AS requested_at FROM orders
    WHERE o_orderdate <= TIMESTAMP '1998-06-01' - INTERVAL 90 DAY AND o_orderkey >= 100
      AND o_orderkey NOT IN (SELECT piece FROM li)""",
)
def _(t: Tables):
    now = F.lit("1998-06-01").cast("timestamp_ntz")
    out = d.unserved_requests(
        expected(t), held(t), ["stream", "piece"], "o_orderdate", now, "90 days", F.lit(100)
    )
    return out.select("piece", F.col("o_orderdate").cast("timestamp_ntz").alias("requested_at"))


@query(
    "j15_servable_blocks",
    f"""WITH {LI}, rq AS (SELECT DISTINCT piece, (chunk - 1) * 10 + header AS begin, nbytes - 3 AS length FROM li),
      hv AS (SELECT piece, chunk - 1 AS chunk, MAX(least(nbytes, 10)) AS held FROM li WHERE ts >= TIMESTAMP '1997-01-01' GROUP BY ALL),
      cv AS (SELECT rq.*, unnest(range(begin // 10, (begin + length - 1) // 10 + 1)) AS chunk FROM rq WHERE length > 0 AND begin + length <= 70),
      nd AS (SELECT cv.*, COALESCE(hv.held >= least(begin + length - cv.chunk * 10, 10), FALSE) AS ok FROM cv
        LEFT JOIN hv ON cv.piece = hv.piece AND cv.chunk = hv.chunk),
      s AS (SELECT piece, begin, length, bool_and(ok) AS ok FROM nd GROUP BY ALL)
    SELECT 'live' AS stream, rq.piece, rq.begin, rq.length, COALESCE(s.ok, FALSE) AS servable FROM rq
    LEFT JOIN s ON rq.piece = s.piece AND rq.begin = s.begin AND rq.length = s.length""",
)
def _(t: Tables):
    li = deliveries(t)
    asked = li.select("stream", "piece", (F.col("chunk") * 10 + F.col("header")).alias("begin"), (F.col("nbytes") - 3).alias("length"))
    # Held are the chunks whose retention has not ended at a date.
    have = li.filter("ts >= timestamp '1997-01-01'").select("stream", "piece", "chunk", F.least("nbytes", F.lit(10)).alias("nbytes"))
    return d.servable_blocks(asked, have, "stream", 70, 10)


@query(
    "j14_range_to_pieces",
    """WITH r AS (SELECT p_partkey, p_partkey * 37 AS s, p_partkey * 37 + p_size * 40 AS e FROM part),
      p AS (SELECT *, unnest(range(s // 500, least(e, 69999) // 500 + 1)) AS piece FROM r WHERE s <= least(e, 69999))
    SELECT p_partkey, piece, greatest(s, piece * 500) - piece * 500 AS skip,
      least(e, 69999, piece * 500 + 499) - greatest(s, piece * 500) + 1 AS emit FROM p""",
)
def _(t: Tables):
    ranges = t.part.select(
        "p_partkey", (F.col("p_partkey") * 37).alias("s"), (F.col("p_partkey") * 37 + F.col("p_size") * 40).alias("e")
    )
    return d.range_to_pieces(ranges, "s", "e", 500, 70000).select("p_partkey", "piece", "skip", "emit")


@query(
    "j13_cached_prefix",
    f"""WITH {LI}, h AS (SELECT DISTINCT piece FROM li), g AS (SELECT piece, piece - row_number() OVER (ORDER BY piece) AS g FROM h),
      r AS (SELECT MIN(piece) AS a, MAX(piece) + 1 AS b FROM g GROUP BY g),
      q AS (SELECT p_partkey, p_partkey * 7 AS f, p_partkey * 7 + p_size AS e FROM part)
    SELECT p_partkey, CASE WHEN b IS NULL THEN 0 ELSE least(b, e) - f END AS cached,
      CASE WHEN b IS NULL THEN e - f ELSE e - least(b, e) END AS to_fetch
    FROM q LEFT JOIN r ON f >= a AND f < b""",
)
def _(t: Tables):
    ranges = t.part.select(
        F.lit("live").alias("stream"), "p_partkey",
        (F.col("p_partkey") * 7).alias("f"), (F.col("p_partkey") * 7 + F.col("p_size")).alias("e"),
    )
    return d.cached_prefix(ranges, deliveries(t), "stream", "piece", "f", "e").select("p_partkey", "cached", "to_fetch")


@query(
    "w6_byte_budget_retention",
    f"""WITH {LI}, z AS (SELECT part % 4 AS stream, piece, CAST(SUM(nbytes) AS BIGINT) AS nbytes FROM li GROUP BY ALL)
    SELECT stream, piece, nbytes, SUM(nbytes) OVER (PARTITION BY stream ORDER BY piece DESC) <= 100000 AS retained FROM z""",
)
def _(t: Tables):
    df = t.lineitem.withColumn("stream", F.col("part") % 4)
    return d.byte_budget_retention(df, "stream", "piece", "nbytes", 100000)


@query(
    "w6_retention_is_ordered",
    f"""WITH {LI}, o AS (SELECT peer, piece, MAX(piece) OVER (PARTITION BY peer ORDER BY part, piece, chunk
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head FROM li WHERE peer % 2 = 0
      UNION ALL SELECT peer, piece, MAX(piece) OVER (PARTITION BY peer ORDER BY piece, part, chunk
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head FROM li WHERE peer % 2 = 1),
      z AS (SELECT peer, MAX(n) AS n FROM (SELECT peer, piece, SUM(nbytes) AS n FROM li GROUP BY ALL) GROUP BY peer),
      b AS (SELECT peer, bool_and(head IS NULL OR piece >= head) AS fine FROM o GROUP BY peer)
    SELECT b.peer, fine AND n <= 90 AS exact FROM b JOIN z ON b.peer = z.peer""",
)
def _(t: Tables):
    arrival = F.when(F.col("peer") % 2 == 0, F.col("part")).otherwise(F.col("piece"))
    tie = F.when(F.col("peer") % 2 == 0, F.col("piece")).otherwise(F.col("part"))
    df = t.lineitem.withColumns({"a": arrival, "b": tie})
    return d.retention_is_ordered(df, "peer", ["a", "b", "chunk"], "piece", "nbytes", 90)


@query(
    "w7_age_retention",
    f"""WITH {LI}, s AS (SELECT part % 4 AS stream, piece, MIN(ts) AS first_seen, MAX(ts) AS latest FROM li GROUP BY ALL),
      n AS (SELECT stream, MAX(latest) AS newest FROM s GROUP BY stream),
      y AS (SELECT s.stream, MIN(piece) AS low FROM s JOIN n ON s.stream = n.stream
        WHERE newest - first_seen < INTERVAL 3 DAY GROUP BY s.stream)
    SELECT s.stream, piece, first_seen, COALESCE(piece >= low, FALSE) AS retained FROM s LEFT JOIN y ON s.stream = y.stream""",
)
def _(t: Tables):
    df = t.lineitem.withColumn("stream", F.col("part") % 4)
    return d.age_retention(df, "stream", "piece", "ts", F.expr("interval 3 days")).withColumns(plain_time("first_seen"))


@query(
    "h9_live_edge",
    f"""WITH {LI}, cp AS (SELECT peer, piece, MAX(ts) AS ts FROM li GROUP BY ALL),
      o AS (SELECT peer, ts, piece, MAX(piece) OVER (PARTITION BY peer ORDER BY ts, piece
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cp)
    SELECT peer, ts, piece, before FROM o WHERE before IS NULL OR piece > before""",
)
def _(t: Tables):
    complete = t.lineitem.groupBy("peer", "piece").agg(F.max("ts").alias("ts"))
    out = d.live_edge(complete, "peer", ["ts", "piece"], "piece")
    return out.select("peer", "ts", "piece", "before").withColumns(plain_time("ts"))


@query(
    "w19_ingest_cursor",
    f"""WITH {LI} SELECT peer, ts, piece, MAX(piece) OVER (PARTITION BY peer ORDER BY ts, piece, chunk, cents, part
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cursor FROM li""",
)
def _(t: Tables):
    cursor, _ = d.ingest_cursor(t.lineitem, "peer", ["ts", "piece", "chunk", "cents", "part"], "piece")
    return cursor.select("peer", "ts", "piece", "cursor").withColumns(plain_time("ts"))


@query(
    "w19_checkpoints",
    f"""WITH RECURSIVE {LI}, v AS (SELECT DISTINCT part % 4 AS stream, cursor FROM (SELECT part, MAX(piece) OVER (
        PARTITION BY part % 4 ORDER BY ts, piece, chunk, cents, part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cursor FROM li)),
      n AS (SELECT a.stream, a.cursor, MIN(b.cursor) AS nxt FROM v a LEFT JOIN v b ON a.stream = b.stream AND b.cursor >= a.cursor + 128 GROUP BY ALL),
      c AS (SELECT stream, MIN(cursor) AS saved FROM v WHERE cursor >= 128 GROUP BY stream
        UNION ALL SELECT c.stream, n.nxt FROM c JOIN n ON c.stream = n.stream AND c.saved = n.cursor WHERE n.nxt IS NOT NULL)
    SELECT stream, saved, saved + 128 AS resume_at FROM c""",
)
def _(t: Tables):
    df = t.lineitem.withColumn("stream", F.col("part") % 4)
    return d.ingest_cursor(df, "stream", ["ts", "piece", "chunk", "cents", "part"], "piece")[1]


@query(
    "w16_far_behind_skips",
    f"""WITH {LI}, o AS (SELECT peer, ts, piece, chunk, piece + nbytes * 40 AS head FROM li),
      m AS (SELECT li.peer, li.ts, li.piece, li.chunk, MAX(piece + nbytes * 40) OVER (PARTITION BY peer ORDER BY piece, ts, chunk, cents, part
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known_head FROM li)
    SELECT peer, ts, piece, chunk, known_head, greatest(known_head - 32, piece + 1) AS jump_to FROM m WHERE known_head - piece > 512""",
)
def _(t: Tables):
    df = t.lineitem.withColumn("head", F.col("piece") + F.col("nbytes") * 40)
    out = d.far_behind_skips(df, "peer", ["piece", "ts", "chunk", "cents", "part"], "head", "piece", 32)
    return out.select("peer", "ts", "piece", "chunk", "known_head", "jump_to").withColumns(plain_time("ts"))


@query(
    "w18_reconnect_gap",
    """WITH e AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'error'),
      n AS (SELECT event_id, user_id, event_id AS nxt, event_id + k - 50 AS wmin FROM e)
    SELECT event_id, user_id, greatest(nxt, wmin) AS resume, CASE WHEN wmin > nxt THEN nxt END AS missed_from,
      greatest(nxt, wmin) - nxt AS missed FROM n""",
)
def _(t: Tables):
    df = t.events.filter("event_type = 'error'").select(
        "event_id", "user_id", F.col("event_id").alias("nxt"), (F.col("event_id") + F.col("k") - 50).alias("wmin")
    )
    return d.reconnect_gap(df, "nxt", "wmin").drop("nxt", "wmin")

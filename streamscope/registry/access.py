"""Catalog, payloads, leases and idle streams."""

from pyspark.sql import functions as F

from ..operators import access as a
from .base import EV, Tables, plain_time, query


@query(
    "j7_resolve_catalog",
    f"""WITH {EV}, r AS (SELECT user_id, event_id, ts FROM ev WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, event_id AS entry FROM ev WHERE event_type = 'view')
    SELECT r.user_id, r.event_id, CASE WHEN r.ts - c.ts < INTERVAL 12 HOUR THEN entry END AS entry,
      COALESCE(r.ts - c.ts < INTERVAL 12 HOUR, FALSE) AS resolved FROM r ASOF LEFT JOIN c ON r.user_id = c.user_id AND r.ts >= c.ts""",
)
def _(t: Tables):
    requests = t.events.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    catalog = t.events.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("entry"))
    return a.resolve_catalog(requests, catalog, "user_id", "ts", "entry", 12 * 3600).drop("ts")


@query(
    "j8_verify_pieces",
    """WITH h AS (SELECT doc_id, sha1(text) AS h FROM documents),
      m AS (SELECT a.doc_id, CASE WHEN a.doc_id % 10 = 0 THEN b.h ELSE a.h END AS expected FROM h a LEFT JOIN h b ON b.doc_id = a.doc_id - 1 WHERE a.doc_id % 10 <> 1)
    SELECT h.doc_id, h.h AS actual, expected, COALESCE(h.h = expected, FALSE) AS ok FROM h LEFT JOIN m ON h.doc_id = m.doc_id""",
)
def _(t: Tables):
    docs = t.read("documents").select("doc_id", "text")
    hashes = docs.select("doc_id", F.sha1("text").alias("expected"))
    shifted = hashes.select((F.col("doc_id") + 1).alias("doc_id"), "expected")
    tens = hashes.filter("doc_id % 10 = 0").select("doc_id").join(shifted, "doc_id", "left")
    manifest = hashes.filter("doc_id % 10 not in (0, 1)").unionByName(tens)
    return a.verify_pieces(docs, manifest, ["doc_id"], "text", "expected")


@query(
    "j10_authorize",
    f"""WITH {EV}, l AS (SELECT user_id, k % 10 AS playback, MAX(ts) + INTERVAL 6 HOUR AS expires FROM ev WHERE event_type = 'signup' GROUP BY ALL)
    SELECT event_id, ev.user_id FROM ev JOIN l ON ev.user_id = l.user_id AND ev.k % 10 = playback AND expires > ts WHERE event_type = 'view'""",
)
def _(t: Tables):
    keyed = t.events.withColumn("playback", F.col("k") % 10)
    leases = keyed.filter("event_type = 'signup'").withColumn("expires_at", F.col("ts") + F.expr("interval 6 hours"))
    asked = keyed.filter("event_type = 'view'").select("user_id", "playback", "event_id", "ts")
    return a.authorize(asked, leases, ["user_id", "playback"], "expires_at", "ts").select("event_id", "user_id")


@query(
    "j12_idle_streams",
    """SELECT c_custkey FROM customer WHERE c_acctbal <= 5000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-08-02' - INTERVAL 200 DAY)
      AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 0)""",
)
def _(t: Tables):
    sessions = t.read("customer").select("c_custkey", F.when(F.col("c_acctbal") > 5000, 1).otherwise(0).alias("subs"))
    hls = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    pending = t.orders.filter("o_orderpriority = '1-URGENT' and o_orderkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey"))
    now = F.lit("1998-08-02").cast("timestamp_ntz")
    return a.idle_streams(sessions, hls, pending, "c_custkey", "subs", "o_orderdate", now, "200 days").select("c_custkey")


@query(
    "k2_lease_capacity",
    f"""WITH {EV} SELECT event_id, ts + INTERVAL 6 HOUR AS expires_at FROM ev WHERE ts + INTERVAL 6 HOUR > TIMESTAMP '2024-01-10'
    ORDER BY ts + INTERVAL 6 HOUR DESC, event_id DESC LIMIT 4096""",
)
def _(t: Tables):
    leases = t.events.select("event_id", (F.col("ts") + F.expr("interval 6 hours")).alias("expires_at"))
    now = F.lit("2024-01-10").cast("timestamp")
    return a.lease_capacity(leases, "event_id", "expires_at", now).withColumns(plain_time("expires_at"))


@query(
    "w20_startup_readiness",
    f"""WITH {EV}, s AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM ev WHERE event_type IN ('view', 'click')),
      r AS (SELECT user_id, event_id, ts FROM ev WHERE event_type = 'signup')
    SELECT r.user_id, event_id, COALESCE(s.ts <= r.ts + INTERVAL 45 HOUR, FALSE) AS ready,
      CASE WHEN s.ts <= r.ts + INTERVAL 45 HOUR THEN greatest(s.ts, r.ts) ELSE r.ts + INTERVAL 45 HOUR END AS answered_at
    FROM r LEFT JOIN s ON r.user_id = s.user_id AND s.n = 6""",
)
def _(t: Tables):
    segments = t.events.filter("event_type in ('view', 'click')").select("user_id", F.col("ts").alias("done_at"))
    requests = t.events.filter("event_type = 'signup'").select("user_id", "event_id", "ts")
    out = a.startup_readiness(segments, requests, "user_id", "done_at", "ts", 6, 45 * 3600)
    return out.drop("ts").withColumns(plain_time("answered_at"))


@query(
    "h8_idle_entries",
    f"""WITH {EV}, l AS (SELECT user_id, MAX(ts) AS last_active, arg_max(event_type, ts) AS kind, arg_max(k, ts) AS k FROM ev GROUP BY user_id)
    SELECT user_id, last_active FROM l WHERE kind <> 'signup' AND k % 3 = 0 AND TIMESTAMP '2024-01-30 12:00:00' - last_active >= INTERVAL 10 HOUR""",
)
def _(t: Tables):
    df = t.events.select(
        "user_id", "ts", F.when(F.col("event_type") == "signup", "broadcast").otherwise("relay").alias("kind"),
        (F.col("k") % 3).alias("producers"),
    )
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return a.idle_entries(df, "user_id", "ts", "kind", "producers", now, 10 * 3600).withColumns(plain_time("last_active"))

"""Journal, replies, addresses and distances."""

from pyspark.sql import functions as F

from ..operators import swarm as s
from .base import EV, Tables, query

ANN = """an AS (SELECT k % 16 AS swarm, user_id AS peer, event_id, CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed'
    WHEN 'error' THEN 'stopped' ELSE 'none' END AS event, cents % 5 AS remaining FROM ev),
  la AS (SELECT swarm, peer, arg_max(event, event_id) AS event, arg_max(remaining, event_id) AS remaining FROM an GROUP BY ALL),
  mb AS (SELECT swarm, peer FROM la WHERE event <> 'stopped')"""

VC = """vc AS (SELECT user_id, event_id, ts, k, event_type, lag(event_type) OVER w AS bt, lag(ts) OVER w AS bts, lag(event_id) OVER w AS bid
  FROM ev WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  co AS (SELECT user_id, event_id, ts, k, COALESCE(bt = 'view' AND ts - bts <= INTERVAL 6 HOUR, FALSE) AS correlated,
    CASE WHEN bt = 'view' AND ts - bts <= INTERVAL 6 HOUR THEN bid END AS query FROM vc WHERE event_type = 'click')"""


def announces(t: Tables):
    kind = F.expr(
        "case event_type when 'signup' then 'started' when 'purchase' then 'completed' when 'error' then 'stopped' else 'none' end"
    )
    return t.events.select(
        (F.col("k") % 16).alias("swarm"), F.col("user_id").alias("peer"), "event_id", "ts",
        kind.alias("event"), (F.col("cents") % 5).alias("remaining"),
    )


def members(t: Tables):
    return s.swarm_members(announces(t), "swarm", "peer", "event", ["ts", "event_id"])


def replies(t: Tables):
    cols = t.events.select("user_id", "event_id", "ts", "k", "event_type", "cents")
    queries = cols.filter("event_type = 'view'").drop("event_type")
    clicks = cols.filter("event_type = 'click'").drop("event_type")
    return queries, s.correlate_replies(queries, clicks, ["user_id"], "ts", "event_id", 6 * 3600)


@query("a4_swarm_members", f"WITH {EV}, {ANN} SELECT * FROM mb")
def _(t: Tables):
    return members(t)


@query("a4_swarm_counts", f"WITH {EV}, {ANN} SELECT swarm, COUNT(*) AS seeders, 0::BIGINT AS leechers FROM mb GROUP BY swarm")
def _(t: Tables):
    return s.swarm_counts(members(t), "swarm")


@query(
    "a5_swarm_seed_leech",
    f"""WITH {EV}, {ANN} SELECT swarm, COUNT(*) FILTER (remaining = 0 OR event = 'completed') AS seeders,
      COUNT(*) FILTER (NOT (remaining = 0 OR event = 'completed')) AS leechers FROM la WHERE event <> 'stopped' GROUP BY swarm""",
)
def _(t: Tables):
    return s.swarm_seed_leech(announces(t), "swarm", "peer", "event", "remaining", ["ts", "event_id"])


@query(
    "j11_tracker_handout",
    f"""WITH {EV}, {ANN} SELECT a.swarm, a.peer, COUNT(b.peer) AS handed_out, MIN(b.peer) AS first_peer, MAX(b.peer) AS last_peer
    FROM mb a LEFT JOIN mb b ON a.swarm = b.swarm AND a.peer <> b.peer GROUP BY ALL""",
)
def _(t: Tables):
    return s.tracker_handout(members(t), "swarm", "peer")


@query("j1_correlate_replies", f"WITH {EV}, {VC} SELECT user_id, event_id, correlated, query FROM co")
def _(t: Tables):
    return replies(t)[1].select("user_id", "event_id", "correlated", "query")


# A user is a node of the walk that its number gives; a response names one more node of the walk.
WALK = """vr AS (SELECT user_id, event_id, ts, k, event_type, lag(event_type) OVER w AS bt, lag(ts) OVER w AS bts
    FROM ev WHERE event_type = 'view' OR (event_type = 'click' AND k % 10 > 1) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type = 'click', event_id)),
  re AS (SELECT user_id % 40 AS walk, user_id, k, COALESCE(bt = 'view' AND ts - bts <= INTERVAL 6 HOUR, FALSE) AS ok FROM vr WHERE event_type = 'click'),
  da AS (SELECT user_id % 40 AS walk, k % 10 AS t, epoch_us(ts) // 86400000000 AS r FROM ev WHERE event_type = 'click'),
  qu AS (SELECT user_id % 40 AS walk, user_id AS node, epoch_us(ts) // 86400000000 AS r FROM ev WHERE event_type = 'view'),
  se AS (SELECT DISTINCT user_id % 40 AS walk, user_id AS node FROM ev WHERE event_type = 'signup'),
  kn AS (SELECT * FROM se UNION SELECT walk, user_id + 40 * (k % 3) FROM re WHERE ok),
  wk AS (SELECT DISTINCT user_id % 40 AS walk FROM ev WHERE event_type IN ('view', 'click', 'signup'))"""


@query(
    "a6_dht_walk_metrics",
    f"""WITH {EV}, {WALK} SELECT walk,
      (SELECT COUNT(*) FROM se WHERE se.walk = wk.walk) AS seeded,
      (SELECT COUNT(*) FROM qu WHERE qu.walk = wk.walk) AS queried,
      (SELECT COUNT(*) FROM re WHERE re.walk = wk.walk AND ok) AS valid,
      (SELECT CAST(COALESCE(SUM(k % 4), 0) AS BIGINT) FROM re WHERE re.walk = wk.walk AND ok) AS peers,
      (SELECT CAST(COALESCE(SUM(k), 0) AS BIGINT) FROM re WHERE re.walk = wk.walk AND ok) AS nodes,
      (SELECT COUNT(*) FROM da WHERE da.walk = wk.walk AND t = 0) AS malformed,
      (SELECT COUNT(*) FROM da WHERE da.walk = wk.walk AND t = 1) AS errors,
      (SELECT COUNT(*) FROM re WHERE re.walk = wk.walk AND NOT ok) AS uncorrelated,
      (SELECT COUNT(*) FROM (SELECT walk, r FROM qu EXCEPT SELECT walk, r FROM da) x WHERE x.walk = wk.walk) AS timeouts,
      (SELECT COUNT(*) FROM (SELECT walk, node FROM kn EXCEPT SELECT walk, node FROM qu) x WHERE x.walk = wk.walk) = 0 AS exhausted
    FROM wk""",
)
def _(t: Tables):
    kind = F.expr("case when k % 10 = 0 then null when k % 10 = 1 then 'e' else 'r' end")
    ev = t.events.withColumns({
        "walk": F.col("user_id") % 40, "node": F.col("user_id"), "kind": kind,
        "day": F.floor(F.unix_seconds("ts") / 86_400), "n_peers": F.col("k") % 4,
    })
    queries, datagrams = ev.filter("event_type = 'view'"), ev.filter("event_type = 'click'")
    answers = s.correlate_replies(queries, datagrams.filter("kind = 'r'"), ["user_id"], "ts", "event_id", 6 * 3600)
    found = answers.filter("correlated").withColumn("node", F.col("user_id") + 40 * (F.col("k") % 3))
    return s.dht_walk_metrics(
        ev.filter("event_type = 'signup'"), queries, datagrams, answers, found, "walk", "node", "day", "kind", "n_peers", "k"
    )


@query(
    "a7_connect_funnel",
    f"""WITH {EV} SELECT user_id, COUNT(*) AS attempts, COUNT(*) FILTER (event_type = 'signup') AS signup, COUNT(*) FILTER (event_type = 'view') AS view,
      COUNT(*) FILTER (event_type = 'click') AS click, COUNT(*) FILTER (event_type = 'purchase') AS purchase, COUNT(*) FILTER (event_type = 'error') AS error
    FROM ev GROUP BY ALL""",
)
def _(t: Tables):
    return s.connect_funnel(t.events, "user_id", "event_type", ["signup", "view", "click", "purchase", "error"])


@query(
    "a8_ip_consensus",
    f"""WITH {EV}, i AS (SELECT user_id, '10.0.0.' || (k % 25) AS ip, COUNT(*) AS n, MAX(event_id) AS o FROM ev GROUP BY ALL),
      l AS (SELECT *, o = MAX(o) OVER (PARTITION BY user_id) AS is_last, SUM(n) OVER (PARTITION BY user_id) AS total,
        MAX(n) OVER (PARTITION BY user_id) AS top FROM i),
      r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, is_last DESC, ip) AS rn FROM l)
    SELECT user_id, ip, top AS agreeing, CAST(total AS BIGINT) AS total FROM r WHERE rn = 1""",
)
def _(t: Tables):
    df = t.events.withColumn("ip", F.concat(F.lit("10.0.0."), (F.col("k") % 25).cast("string")))
    return s.ip_consensus(df, "user_id", "ip", "event_id")


@query("a9_reachable", f"WITH {EV} SELECT user_id, bool_or(k = 42) AS reachable FROM ev GROUP BY ALL")
def _(t: Tables):
    return s.reachable(t.events.withColumn("inbound", F.col("k") == 42), "user_id", "inbound")


@query(
    "j9_cross_check_ips",
    """SELECT COALESCE(c_custkey, s_suppkey * 20) AS node, '10.0.0.' || c_nationkey AS observed, '10.0.0.' || s_nationkey AS mapped,
      CASE WHEN c_custkey IS NULL OR s_suppkey IS NULL THEN 'skipped' WHEN c_nationkey = s_nationkey THEN 'match' ELSE 'mismatch' END AS verdict
    FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20""",
)
def _(t: Tables):
    ip = "concat('10.0.0.', {}) as ip"
    o = t.read("customer").selectExpr("c_custkey as node", ip.format("c_nationkey"))
    m = t.read("supplier").selectExpr("s_suppkey * 20 as node", ip.format("s_nationkey"))
    return s.cross_check_ips(o, m, "node", "ip")


TARGET = "00112233445566778899aabbccddeeff00112233"


@query(
    "k4_closest_nodes",
    f"""WITH n AS (SELECT DISTINCT sha1(text) AS node FROM documents),
      d AS (SELECT node, array_to_string(list_transform(range(0, 40), lambda i: substring('0123456789abcdef',
        1 + xor(strpos('0123456789abcdef', substring(node, i + 1, 1)) - 1, strpos('0123456789abcdef', substring('{TARGET}', i + 1, 1)) - 1), 1)), '') AS distance FROM n)
    SELECT node, distance FROM d ORDER BY distance LIMIT 64""",
)
def _(t: Tables):
    nodes = t.read("documents").select(F.sha1("text").alias("node"))
    return s.closest_nodes(nodes, "node", TARGET, 64)


@query(
    "k4_nearest_to_each",
    """WITH n AS (SELECT DISTINCT sha1(text) AS node FROM documents), t AS (SELECT DISTINCT sha1(url) AS target FROM pages),
      d AS (SELECT target, node, xor(CAST(unhex(node) AS BIT), CAST(unhex(target) AS BIT)) AS x FROM n CROSS JOIN t),
      r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY x) AS rank FROM d)
    SELECT target, node, lower(hex(CAST(x AS BLOB))) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""",
)
def _(t: Tables):
    nodes = t.read("documents").select(F.sha1("text").alias("node"))
    targets = t.read("pages").select(F.sha1("url").alias("target"))
    return s.nearest_to_each(nodes, "node", targets, "target", 8)

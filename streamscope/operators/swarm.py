"""Announces, replies, addresses and node distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.durable import cut
from ..plans.scan import OrderedScan, previous

# Fixed values.
REPLY_TTL_SECONDS = 3
HASH_HEX = 40


def correlate_replies(
    queries: DataFrame,
    replies: DataFrame,
    keys: list[str],
    ts: str,
    ident: str,
    ttl_seconds: int = REPLY_TTL_SECONDS,
) -> DataFrame:
    """Replies with the query each one answers, or ``correlated`` false.

    A key has one query in flight at a time: a newer query replaces an older one and a reply
    consumes it.  So a reply answers the row right before it, if that is a query of the same key
    no older than the time limit.  One scan over both inputs finds this in linear time; joining on
    the key would form every query-reply pair of a busy source first.
    """
    both = queries.select(*keys, ts, ident, F.lit(0).alias("__reply")).unionByName(
        replies.withColumn("__reply", F.lit(1)), allowMissingColumns=True
    )
    before = F.struct(F.col("__reply").alias("r"), F.col(ts).alias("t"), F.col(ident).alias("i"))
    scan = OrderedScan(both, keys, [ts, "__reply", ident]).add(__q=previous(before))
    age = F.unix_micros(ts) - F.unix_micros("__q.t")
    hit = F.coalesce((F.col("__q.r") == 0) & (age <= ttl_seconds * 1_000_000), F.lit(False))
    return (
        scan.df.filter("__reply = 1")
        .withColumns({"correlated": hit, "query": F.when(hit, F.col("__q.i"))})
        .drop("__reply", "__q")
    )


def correlate_reply_stream(
    queries: DataFrame,
    replies: DataFrame,
    keys: list[str],
    query_ts: str,
    reply_ts: str,
    ttl_seconds: int,
    watermark: str,
) -> DataFrame:
    """Streaming form for keys that are not reused within the time limit: an interval join with
    watermarks on both sides, each query consumed once."""
    q = queries.withWatermark(query_ts, watermark).alias("q")
    r = replies.withWatermark(reply_ts, watermark).alias("r")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"q.{k}") == F.col(f"r.{k}"))
    inside = same & F.expr(
        f"r.{reply_ts} >= q.{query_ts} AND r.{reply_ts} <= q.{query_ts} + interval {ttl_seconds} seconds"
    )
    pairs = r.join(q, inside, "inner").select(
        *[F.col(f"q.{k}").alias(k) for k in keys],
        F.col(f"q.{query_ts}"),
        # As a value, not as a second event time: the deduplication below may follow only one.
        (F.col(f"r.{reply_ts}") + F.expr("interval 0 seconds")).alias(reply_ts),
    )
    return pairs.dropDuplicates([*keys, query_ts])


def dht_walk_metrics(
    seeds: DataFrame,
    queries: DataFrame,
    datagrams: DataFrame,
    responses: DataFrame,
    found: DataFrame,
    walk: str,
    node: str,
    round_no: str,
    kind: str,
    n_peers: str,
    n_nodes: str,
) -> DataFrame:
    """Counters of each walk: what it began with, asked, got back, refused and waited for in vain.

    ``datagrams`` are all that arrived: ``kind`` is ``r`` for a response, ``e`` for an error, null
    when unreadable. Errors and unreadable ones are counted as they are and answer nothing;
    ``responses`` are the others, as ``correlate_replies`` marks them. ``found`` holds the nodes
    that correlated responses named. A timeout is a round of queries in which no datagram came. A
    walk is exhausted when it has asked every node it began with or was told of.
    """
    def counted(df: DataFrame, **counters: Column) -> DataFrame:
        return df.select(walk, *[c.cast("bigint").alias(n) for n, c in counters.items()])

    one, ok, what = F.lit(1), F.col("correlated"), F.col(kind)
    rounds = queries.select(walk, round_no).distinct()
    silent = rounds.join(datagrams.select(walk, round_no).distinct(), [walk, round_no], "left_anti")
    known = seeds.select(walk, node).unionByName(found.select(walk, node)).distinct()
    unasked = known.join(queries.select(walk, node).distinct(), [walk, node], "left_anti")
    parts = [
        counted(seeds.select(walk, node).distinct(), seeded=one),
        counted(queries, queried=one),
        counted(
            responses,
            valid=ok.cast("int"),
            peers=F.when(ok, F.col(n_peers)),
            nodes=F.when(ok, F.col(n_nodes)),
            uncorrelated=(~ok).cast("int"),
        ),
        counted(datagrams, errors=(what == "e").cast("int"), malformed=what.isNull().cast("int")),
        counted(silent, timeouts=one),
        counted(unasked, __unasked=one),
    ]
    names = "seeded queried valid peers nodes malformed errors uncorrelated timeouts __unasked".split()
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    sums = union.groupBy(walk).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return sums.withColumn("exhausted", F.col("__unasked") == 0).drop("__unasked")


def latest_announces(
    df: DataFrame, swarm: str, peer: str, event: str, order: list[str], extra: tuple[str, ...] = ()
) -> DataFrame:
    newest = F.max_by(F.struct(event, *extra), F.struct(*order))
    return df.groupBy(swarm, peer).agg(newest.alias("s")).select(swarm, peer, "s.*")


def swarm_members(
    df: DataFrame, swarm: str, peer: str, event: str, order: list[str]
) -> DataFrame:
    """Current members: peers whose latest announce is not ``stopped``."""
    latest = latest_announces(df, swarm, peer, event, order)
    return latest.filter(F.col(event) != "stopped").select(swarm, peer)


def swarm_counts(members: DataFrame, swarm: str) -> DataFrame:
    """What the tracker reports: every member counts as a seeder."""
    return members.groupBy(swarm).agg(
        F.count(F.lit(1)).alias("seeders"), F.lit(0).cast("bigint").alias("leechers")
    )


def swarm_seed_leech(
    df: DataFrame, swarm: str, peer: str, event: str, left: str, order: list[str]
) -> DataFrame:
    """Members by role: complete (nothing left or ``completed``) or still fetching."""
    latest = latest_announces(df, swarm, peer, event, order, (left,)).filter(F.col(event) != "stopped")
    complete = F.coalesce((F.col(left) == 0) | (F.col(event) == "completed"), F.lit(False))
    return latest.groupBy(swarm).agg(
        F.count_if(complete).alias("seeders"), F.count_if(~complete).alias("leechers")
    )


def tracker_handout(members: DataFrame, swarm: str, peer: str) -> DataFrame:
    """What each announcer is told: how many *other* members there are, and the ends of that list.

    The list itself is the swarm's member table without the announcer; writing it out for every
    announcer would be quadratic in the swarm, so it stays a lookup in ``members``.
    """
    ends = members.groupBy(swarm).agg(
        F.count(F.lit(1)).alias("__n"), F.min(peer).alias("__lo"), F.max(peer).alias("__hi")
    )
    inner = members.join(ends, swarm).filter(
        (F.col(peer) > F.col("__lo")) & (F.col(peer) < F.col("__hi"))
    )
    second = inner.groupBy(swarm).agg(F.min(peer).alias("__lo2"), F.max(peer).alias("__hi2"))
    both = members.join(ends.join(second, swarm, "left"), swarm)
    alone = F.col("__n") == 1

    def end(own: str, next_in: str, opposite: str) -> Column:
        inner_end = F.coalesce(F.col(next_in), F.col(opposite))
        return F.when(alone, None).when(F.col(peer) == F.col(own), inner_end).otherwise(F.col(own))

    return both.select(
        swarm,
        peer,
        (F.col("__n") - 1).alias("handed_out"),
        end("__lo", "__lo2", "__hi").alias("first_peer"),
        end("__hi", "__hi2", "__lo").alias("last_peer"),
    )


def connect_funnel(df: DataFrame, stream: str, stage: str, stages: list[str]) -> DataFrame:
    """Attempts and outcomes by stage, one column per stage."""
    return (
        df.groupBy(stream)
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            *[F.count_if(F.col(stage) == s).alias(s) for s in stages],
        )
    )


def ip_consensus(df: DataFrame, node: str, ip: str, order: str) -> DataFrame:
    """The address most often reported; a tie goes to the latest report, else to the smallest."""
    per_ip = df.groupBy(node, ip).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("o"))
    picked = per_ip.groupBy(node).agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col(ip).alias("ip"))).alias("most"),
        F.max(F.struct("o", F.col(ip).alias("ip"), "n")).alias("last"),
        F.sum("n").alias("total"),
    )
    tied = F.col("last.n") == -F.col("most.n")
    return picked.select(
        node,
        F.when(tied, F.col("last.ip")).otherwise(F.col("most.ip")).alias(ip),
        (-F.col("most.n")).alias("agreeing"),
        "total",
    )


def reachable(df: DataFrame, node: str, inbound: str) -> DataFrame:
    """A node is reachable once any inbound connection was seen."""
    return df.groupBy(node).agg((F.count_if(F.col(inbound)) > 0).alias("reachable"))


def cross_check_ips(observed: DataFrame, mapped: DataFrame, node: str, ip: str) -> DataFrame:
    """Observed against mapped address per node; skipped where one of them is missing."""
    o = observed.select(node, F.col(ip).alias("observed"))
    m = mapped.select(node, F.col(ip).alias("mapped"))
    both = o.join(m, node, "full")
    verdict = (
        F.when(F.col("observed").isNull() | F.col("mapped").isNull(), "skipped")
        .when(F.col("observed") == F.col("mapped"), "match")
        .otherwise("mismatch")
    )
    return both.withColumn("verdict", verdict)


def xor_distance(node_hex: Column, target_hex: Column | str) -> Column:
    """XOR of two 40-digit ids as hex text, which sorts like the number."""
    step = 10
    target = F.lit(target_hex) if isinstance(target_hex, str) else target_hex

    def part(ids: Column, at: int) -> Column:
        return F.conv(F.substring(ids, at + 1, step), 16, 10).cast("bigint")

    parts = [
        F.lpad(F.hex(part(node_hex, at).bitwiseXOR(part(target, at))), step, "0")
        for at in range(0, HASH_HEX, step)
    ]
    return F.lower(F.concat(*parts))


def closest_nodes(nodes: DataFrame, node: str, target_hex: str, k: int) -> DataFrame:
    """The ``k`` distinct ids nearest to the target, by a distributed top-k."""
    return (
        nodes.select(node)
        .distinct()
        .withColumn("distance", xor_distance(F.col(node), target_hex))
        .orderBy("distance")
        .limit(k)
    )


def nearest_to_each(
    nodes: DataFrame, node: str, targets: DataFrame, target: str, k: int, room: int = 4
) -> DataFrame:
    """For each distinct target the ``k`` nearest distinct ids: target, node, distance, rank.

    Ids are hex text; those of a target's own prefix are nearer than all others, and below any
    prefix the children come in the order of their digit XOR the target's.  So each target descends
    the tree of prefixes by counts alone: children that fit whole are taken, and only the one that
    holds more than is still needed is followed, until it has at most ``room`` times ``k`` ids.
    Then prefixes are looked up, at most ``room + 1`` times ``k`` ids a target, and ranked.  Targets
    never meet all nodes, and a level's counts are the prefixes that some target follows.
    """
    ids = cut(nodes.select(F.lower(node).alias("id")).filter("id is not null").distinct())
    state = targets.select(F.lower(target).alias("target")).filter("target is not null").distinct()
    state = cut(state.select("target", F.lit("").alias("prefix"), F.lit(k).cast("bigint").alias("need")))
    wanted = []
    for depth in range(HASH_HEX):
        if state.isEmpty():
            break
        followed = state.select("prefix").distinct()
        prefix, digit = F.substring("id", 1, depth), F.substring("id", depth + 1, 1)
        children = (
            ids.groupBy(prefix.alias("prefix"), digit.alias("digit"))
            .agg(F.count(F.lit(1)).alias("n"))
            .join(followed, "prefix", "left_semi")
            .groupBy("prefix")
            .agg(F.collect_list(F.struct("digit", "n")).alias("children"))
        )
        own = F.conv(F.substring("target", depth + 1, 1), 16, 10).cast("int")
        ordered = F.array_sort(
            F.transform("children", lambda c: F.struct(
                F.conv(c["digit"], 16, 10).cast("int").bitwiseXOR(own).alias("o"), c["digit"].alias("digit"), c["n"].alias("n"),
            ))
        )
        nothing = F.struct(
            F.col("need").alias("left"), F.array().cast("array<string>").alias("whole"),
            F.lit(None).cast("string").alias("next"), F.lit(0).cast("bigint").alias("rest"), F.lit(0).cast("bigint").alias("n"),
        )

        def take(acc: Column, c: Column) -> Column:
            return (
                F.when(acc["left"] <= 0, acc)
                .when(c["n"] <= acc["left"], F.struct(
                    (acc["left"] - c["n"]).alias("left"), F.concat(acc["whole"], F.array(c["digit"])).alias("whole"),
                    acc["next"].alias("next"), acc["rest"].alias("rest"), acc["n"].alias("n"),
                ))
                .otherwise(F.struct(
                    F.lit(0).cast("bigint").alias("left"), acc["whole"].alias("whole"), c["digit"].alias("next"),
                    acc["left"].alias("rest"), c["n"].alias("n"),
                ))
            )

        step = cut(
            state.join(children, "prefix").select("target", "prefix", F.aggregate(ordered, nothing, take).alias("t"))
        )
        few = (F.col("t.n") <= room * k) | F.lit(depth + 1 == HASH_HEX)
        taken = F.concat("t.whole", F.when(few & F.col("t.next").isNotNull(), F.array("t.next")).otherwise(F.array().cast("array<string>")))
        wanted.append(
            step.select(
                "target", F.explode(F.transform(taken, lambda d: F.concat("prefix", d))).alias("prefix")
            ).join(
                ids.withColumn("prefix", F.substring("id", 1, depth + 1)), "prefix"
            ).select("target", "id")
        )
        state = step.filter(F.col("t.next").isNotNull() & ~few).select(
            "target", F.concat("prefix", "t.next").alias("prefix"), F.col("t.rest").alias("need")
        )
    if not wanted:
        wanted = [state.select("target", F.col("prefix").alias("id"))]
    nearest = W.partitionBy("target").orderBy("distance")
    return (
        reduce(DataFrame.unionByName, wanted)
        .withColumn("distance", xor_distance(F.col("id"), F.col("target")))
        .withColumn("rank", F.row_number().over(nearest))
        .filter(F.col("rank") <= k)
        .select("target", F.col("id").alias("node"), "distance", "rank")
    )

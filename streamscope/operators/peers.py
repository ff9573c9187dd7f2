"""Peers: what their windows cover, which to try next, how sources of peers are combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.network import MAX_TRACKER_URL_BYTES, MAX_TRACKERS
from ..plans.ranges import range_join
from ..plans.scan import OrderedScan, running_count, running_sum, total_of


def window_coverage(
    pieces: DataFrame,
    windows: DataFrame,
    stream: str,
    piece: str,
    min_piece: str,
    max_piece: str,
    unchoked: str | None = None,
    bucket: int = 512,
) -> DataFrame:
    """Which peers can serve which pieces: an unchoked window that contains the piece."""
    usable = windows if unchoked is None else windows.filter(F.col(unchoked))
    return range_join(pieces, usable, [stream], piece, min_piece, max_piece, bucket)


def coverage_counts(
    pieces: DataFrame,
    windows: DataFrame,
    stream: str,
    piece: str,
    min_piece: str,
    max_piece: str,
    unchoked: str | None = None,
) -> DataFrame:
    """How many peers can serve each piece, without a row for each pair.

    A window adds one at its first piece and takes it away after its last; the running sum over
    these edges is the count, however many windows overlap or how wide they claim to be.
    """
    usable = windows.filter(F.col(min_piece) <= F.col(max_piece))
    if unchoked is not None:
        usable = usable.filter(F.col(unchoked))
    edge = F.explode(
        F.array(
            F.struct(F.col(min_piece).alias("at"), F.lit(1).alias("n")),
            F.struct((F.col(max_piece) + 1).alias("at"), F.lit(-1).alias("n")),
        )
    )
    edges = usable.select(stream, edge.alias("e")).groupBy(stream, F.col("e.at").alias("__at")).agg(
        F.sum("e.n").alias("__n")
    )
    asked = pieces.withColumns({"__at": F.col(piece), "__kind": F.lit(1)})
    both = asked.unionByName(edges.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    scan = OrderedScan(both, stream, ["__at", "__kind"]).add(__peers=running_sum(F.col("__n")))
    return scan.df.filter("__kind = 1").select(
        *pieces.columns, F.coalesce("__peers", F.lit(0)).alias("peers")
    )


def lowest_covered(windows: DataFrame, stream: str, min_piece: str, unchoked: str) -> DataFrame:
    """The lowest piece any unchoked peer still holds."""
    return windows.filter(F.col(unchoked)).groupBy(stream).agg(F.min(min_piece).alias("lowest"))


def prefer_window(
    df: DataFrame, stream: str, max_piece: str, position: str, distance: str, peer: str
) -> DataFrame:
    """The best upstream: highest max, then position, then nearest; equal ones by peer."""
    best = F.min(
        F.struct(
            (-F.col(max_piece)).alias("m"), (-F.col(position)).alias("p"),
            F.col(distance).alias("d"), F.col(peer).alias("peer"),
        )
    )
    return df.groupBy(stream).agg(best.alias("b")).select(
        stream,
        F.col("b.peer").alias(peer),
        (-F.col("b.m")).alias(max_piece),
        (-F.col("b.p")).alias(position),
        F.col("b.d").alias(distance),
    )


def rank_by_coverage(
    adverts: DataFrame,
    stream: str,
    ord: str,
    min_piece: str,
    max_piece: str,
    needed: str,
) -> DataFrame:
    """Adverts ranked: covering windows, then unknown, then not covering; arrival order inside."""
    covers = F.col(needed).between(F.col(min_piece), F.col(max_piece))
    unknown = F.col(min_piece).isNull() | F.col(max_piece).isNull()
    group = F.when(unknown, 1).when(covers, 0).otherwise(2)
    grouped = adverts.withColumn("__group", group)
    before = grouped.groupBy(stream).agg(
        F.count_if(F.col("__group") == 0).alias("__n0"), F.count_if(F.col("__group") <= 1).alias("__n1")
    )
    ranked = OrderedScan(grouped, [stream, "__group"], ord).add(__n=running_count())
    offset = F.when(F.col("__group") == 0, 0).when(F.col("__group") == 1, F.col("__n0")).otherwise(F.col("__n1"))
    return (
        ranked.df.join(before, stream)
        .withColumn("rank", F.col("__n") + offset)
        .drop("__group", "__n", "__n0", "__n1")
    )


def choose_unchoked(
    df: DataFrame,
    keys: list[str],
    peer: str,
    order: str,
    n: int,
    tick: Column | int,
) -> DataFrame:
    """The first ``n`` interested peers, plus one optimistic pick that rotates with the tick."""
    tick = F.lit(tick) if isinstance(tick, int) else tick
    scan = OrderedScan(df, keys, [order, peer]).add(
        __rank=running_count(), __total=total_of("count", F.lit(1))
    )
    optimistic = n + 1 + F.pmod(tick, F.greatest(F.col("__total") - n, F.lit(1)))
    picked = scan.df.filter((F.col("__rank") <= n) | (F.col("__rank") == optimistic))
    return picked.withColumn("optimistic", F.col("__rank") > n).drop("__rank", "__total")


def rechoke_rounds(
    df: DataFrame, stream: str, peer: str, ts: str, tick_seconds: int, n: int
) -> DataFrame:
    """``choose_unchoked`` for each tick, over the peers seen in it in order of first interest."""
    tick = F.expr(f"unix_seconds({ts}) div {tick_seconds}")
    seen = df.groupBy(stream, tick.alias("tick"), peer).agg(F.min(ts).alias("__first"))
    return choose_unchoked(seen, [stream, "tick"], peer, "__first", n, F.col("tick")).drop("__first")


def refill_candidates(
    known: DataFrame, excluded: DataFrame, active: DataFrame, keys: list[str]
) -> DataFrame:
    """Known peers that are neither excluded nor in use; columns such as an order are kept."""
    out = excluded.select(*keys).unionByName(active.select(*keys)).distinct()
    return known.join(out, keys, "left_anti")


def reconnect_candidates(
    known: DataFrame, excluded: DataFrame, stream: str, peer: str
) -> DataFrame:
    """Known peers that are not excluded; all of a stream's peers when none would be left."""
    left = known.join(excluded.select(stream, peer).distinct(), [stream, peer], "left_anti")
    return left.unionByName(known.join(left.select(stream).distinct(), stream, "left_anti"))


def retry_candidates(
    adverts: DataFrame,
    active: DataFrame,
    tried: DataFrame,
    stream: str,
    peer: str,
    ord: str,
    n: int,
) -> DataFrame:
    """The first ``n`` advertised peers per stream that are new and not in use."""
    keys = [stream, peer]
    once = adverts.groupBy(*keys).agg(F.min(ord).alias(ord))
    out = active.select(*keys).unionByName(tried.select(*keys)).distinct()
    fresh = once.join(out, keys, "left_anti")
    first = W.partitionBy(stream).orderBy(ord, peer)
    return fresh.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n)


def take_trackers(
    df: DataFrame, stream: str, ord: str, url: str, n: int = MAX_TRACKERS
) -> DataFrame:
    """Of each stream's first ``n`` trackers, those that are short lowercase udp URLs."""
    first = W.partitionBy(stream).orderBy(ord)
    usable = (F.octet_length(url) <= MAX_TRACKER_URL_BYTES) & F.col(url).startswith("udp://")
    return (
        df.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n).filter(usable)
    )


def evicted_gap_skips(
    frontier: DataFrame,
    windows: DataFrame,
    stream: str,
    next_piece: str,
    stuck_since: str,
    now: Column,
    timeout: str,
    min_piece: str,
    max_piece: str,
    unchoked: str,
) -> DataFrame:
    """Readers stuck on a piece that no unchoked peer holds any more, and where they jump to.

    ``frontier`` may hold many readers of a stream.  Whether a piece is covered is whether its
    coverage count is above zero; the jump needs only each stream's lowest covered piece.
    """
    usable = windows.filter(F.col(unchoked))
    stuck = frontier.filter(F.col(stuck_since) <= now - F.expr(f"interval {timeout}"))
    covered = (
        coverage_counts(
            stuck.select(stream, next_piece).distinct(), usable, stream, next_piece, min_piece, max_piece
        )
        .filter("peers > 0")
        .select(stream, next_piece)
    )
    floor = lowest_covered(windows, stream, min_piece, unchoked)
    return (
        stuck.join(covered, [stream, next_piece], "left_anti")
        .join(floor, stream)
        .filter(F.col("lowest") > F.col(next_piece))
        .withColumnRenamed("lowest", "jump_to")
    )


def merge_sources(
    first: DataFrame, second: DataFrame, stream: str, peer: str, target: int
) -> DataFrame:
    """The first source's peers alone where it has at least ``target``, else both, each once."""
    a = first.select(stream, peer).distinct()
    enough = a.groupBy(stream).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= target)
    b = second.select(stream, peer).join(enough.select(stream), stream, "left_anti")
    return a.unionByName(b).distinct()


def merge_discovered(known: DataFrame, found: DataFrame, stream: str, peer: str, ord: str) -> DataFrame:
    """Known peers followed by the found ones not known yet (``added``), each once."""
    both = known.select(stream, peer, F.col(ord), F.lit(False).alias("added")).unionByName(
        found.select(stream, peer, F.col(ord), F.lit(True).alias("added"))
    )
    first = F.min(F.struct("added", ord))
    return both.groupBy(stream, peer).agg(first.alias("f")).select(stream, peer, "f.added", f"f.{ord}")


def rediscovery_reset(
    known: DataFrame, found: DataFrame, excluded: DataFrame, stream: str, peer: str
) -> DataFrame:
    """The exclusions that stay: a stream whose discovery found nothing new loses all of its own."""
    keys = [stream, peer]
    fresh = found.select(*keys).join(known.select(*keys), keys, "left_anti").select(stream).distinct()
    return excluded.join(fresh, stream, "left_semi")

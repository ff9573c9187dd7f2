"""Chunk deliveries: completeness, coverage, frontiers, ranges, requests and retention."""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.expand import expand
from ..plans.fold import Fold, Rows, State, sliced_fold
from ..plans.scan import OrderedScan, last_value, previous, running_max, running_sum

# Fixed values.
MAX_REQUEST_BYTES = 16_384
CHECKPOINT_PIECES = 128

#: Checkpoint intervals of a stream that one task folds at a time.
SLICE_INTERVALS = 64


def piece_completeness(
    df: DataFrame, stream: str, piece: str, chunk: str, chunks_per_piece: int
) -> DataFrame:
    """Distinct chunks per piece inside the geometry, and whether the piece is complete.

    Up to 64 chunks fit one bit mask, which combines before the shuffle: a piece delivered a
    billion times still sends one row per map task.
    """
    inside = df.filter(F.col(chunk).between(0, chunks_per_piece - 1))
    if chunks_per_piece <= 64:
        bit = F.expr(f"shiftleft(1L, cast({chunk} as int))")
        chunks = F.bit_count(F.bit_or(bit)).cast("bigint")
    else:
        chunks = F.count_distinct(F.col(chunk))
    return (
        inside.groupBy(stream, piece)
        .agg(chunks.alias("chunks"))
        .withColumn("complete", F.col("chunks") >= chunks_per_piece)
    )


def covered_bytes(
    df: DataFrame, keys: list[str], begin: str, nbytes: str, piece_len: int
) -> DataFrame:
    """Union length of a piece's blocks; empty and out-of-range blocks are counted apart.

    Blocks are first reduced to the furthest end per begin, so a piece never has more rows than
    distinct offsets, however often it was delivered.
    """
    end = F.col(begin) + F.col(nbytes)
    good = (F.col(nbytes) > 0) & (F.col(begin) >= 0) & (end <= piece_len)
    blocks = df.groupBy(*keys, F.col(begin).alias("__begin")).agg(
        F.max(F.when(good, end)).alias("__end"),
        F.count_if(~good).alias("__rejected"),
    )
    reached = OrderedScan(blocks, keys, "__begin").add(
        __before=running_max(F.col("__end"), exclusive=True)
    )
    new = F.greatest(
        F.col("__end") - F.greatest(F.col("__begin"), F.coalesce(F.col("__before"), F.lit(0))), F.lit(0)
    )
    return (
        reached.df.groupBy(*keys)
        .agg(
            F.coalesce(F.sum(new), F.lit(0)).alias("covered"),
            F.sum("__rejected").alias("rejected"),
        )
        .withColumn("complete", F.col("covered") == piece_len)
    )


def piece_window(df: DataFrame, stream: str, piece: str) -> DataFrame:
    """Lowest and highest piece per stream (filter to complete pieces for that variant)."""
    return df.groupBy(stream).agg(F.min(piece).alias("min_piece"), F.max(piece).alias("max_piece"))


def piece_header(df: DataFrame, keys: list[str], header: str, order: list[str]) -> DataFrame:
    """The earliest non-zero header of each piece; zero when only placeholders arrived."""
    real = F.col(header) != 0
    first = F.min_by(F.col(header), F.when(real, F.struct(*order)))
    return df.groupBy(*keys).agg(F.coalesce(first, F.lit(0)).alias("header"))


def _edges(pieces: DataFrame, stream: str, piece: str) -> DataFrame:
    """Where runs of pieces start and stop, without sorting the pieces.

    Each piece marks itself and the place after it.  A place marked only as "after" is where a run
    stops, one marked only as "itself" is where a run starts.  The aggregation is on
    (stream, place), so one stream holding most pieces spreads over all tasks.
    """
    marks = pieces.select(
        stream,
        F.explode(
            F.array(
                F.struct(F.col(piece).alias("at"), F.lit(True).alias("self")),
                F.struct((F.col(piece) + 1).alias("at"), F.lit(False).alias("self")),
            )
        ).alias("m"),
    ).select(stream, F.col("m.at").alias("at"), F.col("m.self").alias("self"))
    return (
        marks.groupBy(stream, "at")
        .agg(F.bool_or("self").alias("here"), F.bool_or(~F.col("self")).alias("after"))
        .filter("here <> after")
        .select(stream, "at", F.col("here").alias("starts"))
    )


def contiguous_frontier(pieces: DataFrame, stream: str, piece: str, start: int = 0) -> DataFrame:
    """The next needed piece per stream: the first one at or after ``start`` that is missing.

    No sort and no join: like the edges of runs, missing places are found by an aggregation on
    (stream, place).  Pieces may repeat.
    """
    # Everything below the start counts as held: each row also marks the start as "after".
    low = F.lit(start).cast("bigint")
    held = F.struct(F.col(piece).cast("bigint").alias("at"), F.lit(True).alias("self"))
    after = F.struct((F.col(piece) + 1).cast("bigint").alias("at"), F.lit(False).alias("self"))
    origin = F.struct(low.alias("at"), F.lit(False).alias("self"))
    later = F.col(piece) >= start
    marks = pieces.select(
        stream, F.explode(F.when(later, F.array(held, after, origin)).otherwise(F.array(origin))).alias("m")
    )
    return (
        marks.groupBy(stream, F.col("m.at").alias("at"))
        .agg(F.bool_or("m.self").alias("here"))
        .filter("not here")
        .groupBy(stream)
        .agg(F.min("at").alias("next_piece"))
    )


def have_ranges(pieces: DataFrame, stream: str, piece: str) -> DataFrame:
    """Contiguous runs of pieces as (first, count).  Pieces may repeat.

    Only the edges of runs are put in order.
    """
    edges = _edges(pieces, stream, piece)
    paired = OrderedScan(edges, stream, "at").add(first_piece=previous(F.col("at")))
    return paired.df.filter("not starts").select(
        stream, "first_piece", (F.col("at") - F.col("first_piece")).alias("n_pieces")
    )


def missing_pieces(
    need: DataFrame,
    have: DataFrame,
    requested: DataFrame,
    stream: str,
    piece: str,
    next_piece: str,
    head: str,
    cap: int | None = None,
) -> DataFrame:
    """Pieces from ``next`` to ``head`` that are neither held nor requested.

    With ``cap`` only the next ``cap`` places are looked at, whatever head a peer claims; the
    bound is applied before the range is expanded.
    """
    last = F.col(head) if cap is None else F.least(F.col(head), F.col(next_piece) + (cap - 1))
    span = need.select(stream, F.col(next_piece).alias("__low"), last.alias("__high"))
    wanted = expand(span, "__low", "__high", piece).select(stream, piece)
    taken = have.select(stream, piece).unionByName(requested.select(stream, piece))
    return wanted.join(taken, [stream, piece], "left_anti")


def unserved_requests(
    requests: DataFrame,
    done: DataFrame,
    keys: list[str],
    ts: str,
    now: Column,
    timeout: Column | str,
    frontier: Column | None = None,
) -> DataFrame:
    """Requests older than ``timeout`` that nothing completed, at or after the frontier."""
    gap = F.expr(f"interval {timeout}") if isinstance(timeout, str) else timeout
    waiting = requests.filter(F.col(ts) <= now - gap)
    if frontier is not None:
        waiting = waiting.filter(F.col(keys[-1]) >= frontier)
    return waiting.join(done.select(*keys).distinct(), keys, "left_anti")


def servable_blocks(
    requests: DataFrame,
    have: DataFrame,
    stream: str,
    piece_len: int,
    chunk_len: int,
    max_length: int = MAX_REQUEST_BYTES,
) -> DataFrame:
    """Whether each (piece, begin, length) request can be answered from the chunks in ``have``.

    Every chunk a request covers must be held with enough bytes.  A request covers at most
    ``max_length / chunk_len + 1`` chunks, so the expansion is bounded; invalid requests are
    answered without it.
    """
    keys = [stream, "piece", "begin", "length"]
    end = F.col("begin") + F.col("length")
    valid = (
        (F.col("length") > 0) & (F.col("length") <= max_length) & (F.col("begin") >= 0) & (end <= piece_len)
    )
    asked = requests.select(*keys).distinct().withColumn("__valid", valid)
    covering = F.when(
        F.col("__valid"), F.expr(f"sequence(begin div {chunk_len}, (begin + length - 1) div {chunk_len})")
    )
    wanted = asked.withColumn("chunk", F.explode_outer(covering)).withColumn(
        "__need", F.least(end - F.col("chunk") * chunk_len, F.lit(chunk_len))
    )
    held = have.groupBy(stream, "piece", "chunk").agg(F.max("nbytes").alias("__held"))
    enough = F.coalesce(F.col("__held") >= F.col("__need"), F.lit(False))
    return (
        wanted.join(held, [stream, "piece", "chunk"], "left")
        .groupBy(*keys)
        .agg(F.bool_and(F.col("__valid") & enough).alias("servable"))
    )


def range_to_pieces(
    ranges: DataFrame, start: str, end: str, piece_len: int, total: int
) -> DataFrame:
    """Pieces covering each byte range (inclusive ends), with bytes to skip and bytes to emit."""
    last = F.least(F.col(end), F.lit(total - 1))
    base = F.col("piece") * piece_len
    low = F.greatest(F.col(start), base)
    high = F.least(last, base + (piece_len - 1))
    asked = ranges.filter((F.col(start) <= last) & (F.col(start) >= 0)).withColumns(
        {
            "__low": F.expr(f"{start} div {piece_len}"),
            "__high": F.expr(f"least({end}, {total - 1}L) div {piece_len}"),
        }
    )
    return expand(asked, "__low", "__high", "piece").drop("__low", "__high").withColumns(
        {"skip": low - base, "emit": high - low + 1}
    )


def cached_prefix(
    ranges: DataFrame,
    have: DataFrame,
    stream: str,
    piece: str,
    first: str,
    end: str,
) -> DataFrame:
    """How many pieces from each range's start are held without a gap (``end`` is exclusive).

    The held runs are looked up by their start, so neither ranges nor runs are expanded.
    """
    runs = have_ranges(have, stream, piece).select(
        stream,
        F.col("first_piece").alias("__at"),
        (F.col("first_piece") + F.col("n_pieces")).alias("__stop"),
    )
    asked = ranges.select("*", F.col(first).alias("__at"), F.lit(1).alias("__kind"))
    both = asked.unionByName(runs.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    looked = OrderedScan(both, stream, ["__at", "__kind"]).add(
        __run=last_value(F.col("__stop"))
    )
    cached = F.greatest(
        F.least(F.coalesce(F.col("__run"), F.lit(0)), F.col(end)) - F.col(first), F.lit(0)
    )
    return looked.df.filter("__kind = 1").select(
        *ranges.columns, cached.alias("cached"), (F.col(end) - F.col(first) - cached).alias("to_fetch")
    )


def source_stats(
    df: DataFrame, stream: str, peer: str, down: str, up: str, approximate: bool = False
) -> DataFrame:
    """Distinct peers and bytes moved per stream."""
    peers = F.approx_count_distinct(peer) if approximate else F.count_distinct(peer)
    return df.groupBy(stream).agg(
        peers.alias("peers_served"), F.sum(down).alias("downloaded"), F.sum(up).alias("uploaded")
    )


def byte_budget_retention(
    df: DataFrame, stream: str, piece: str, nbytes: str, budget: int
) -> DataFrame:
    """What remains when the lowest pieces are dropped until the total fits the budget.

    Exact when pieces arrive in order and none exceeds the budget (``retention_is_ordered`` tells).
    """
    sizes = df.groupBy(stream, piece).agg(F.sum(nbytes).alias("nbytes"))
    scan = OrderedScan(sizes, stream, piece, descending=True).add(
        __held=running_sum(F.col("nbytes"))
    )
    return scan.df.withColumn("retained", (F.col("__held") <= budget) & (F.lit(budget) > 0)).drop("__held")


def retention_is_ordered(
    df: DataFrame, stream: str, order: list[str], piece: str, nbytes: str, budget: int
) -> DataFrame:
    """Per stream: is ``byte_budget_retention`` exact?"""
    seen = OrderedScan(df, stream, order).add(__head=running_max(F.col(piece), exclusive=True)).df
    ordered = seen.groupBy(stream).agg(
        F.bool_and(F.coalesce(F.col(piece) >= F.col("__head"), F.lit(True))).alias("__ordered")
    )
    largest = (
        df.groupBy(stream, piece).agg(F.sum(nbytes).alias("__n")).groupBy(stream).agg(F.max("__n").alias("__n"))
    )
    return ordered.join(largest, stream).select(
        stream, (F.col("__ordered") & (F.col("__n") <= budget)).alias("exact")
    )


def age_retention(df: DataFrame, stream: str, piece: str, ts: str, retention: Column) -> DataFrame:
    """What remains when pieces are dropped from the lowest while older than ``retention``.

    Dropping stops at the first young piece, so the result is everything from the lowest young
    piece on.  Age is measured against the newest data of the stream.
    """
    seen = df.groupBy(stream, piece).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("__latest"))
    newest = seen.groupBy(stream).agg(F.max("__latest").alias("__newest"))
    young = (
        seen.join(newest, stream)
        .filter(F.col("__newest") - F.col("first_seen") < retention)
        .groupBy(stream)
        .agg(F.min(piece).alias("__lowest_young"))
    )
    kept = F.coalesce(F.col(piece) >= F.col("__lowest_young"), F.lit(False))
    return (
        seen.join(young, stream, "left")
        .select(stream, piece, "first_seen", kept.alias("retained"))
    )


def live_edge(complete: DataFrame, stream: str, order: list[str], piece: str) -> DataFrame:
    """Complete pieces above all that came before them: what a peer newly advertises, one by one.

    ``before`` is the piece advertised last. Pieces that arrive below the head are never told.
    """
    scan = OrderedScan(complete, stream, order).add(before=running_max(F.col(piece), exclusive=True))
    return scan.df.filter(F.col("before").isNull() | (F.col(piece) > F.col("before")))


def checkpoint_fold(interval: int, start: int) -> Fold:
    """Saves a value that is ``interval`` past the last one saved.

    In a slice, what is saved last depends only on the first value saved there; neighbouring first
    values mostly lead to the same last one, so a few limits describe the slice.
    """

    def step(rows: Rows, state: State) -> tuple[list[tuple], State]:
        last, values, saved = state["last"] if state else start, rows["cursor"], []
        at = int(np.searchsorted(values, last + interval))
        while at < len(values):
            last = int(values[at])
            saved.append((last,))
            at = int(np.searchsorted(values, last + interval))
        return saved, {"last": last}

    def describe(rows: Rows) -> dict:
        values = rows["cursor"]
        following = np.searchsorted(values, values + interval).tolist()
        ends, limits = values.tolist(), []
        # What was saved last lies before the slice, so the first value saved here is near its start.
        near = following[0] if values[0] > start else len(ends) - 1
        for n in reversed(range(len(ends))):
            if following[n] < len(ends):
                ends[n] = ends[following[n]]
            if n <= near and (not limits or ends[n] != limits[-1][1]):
                limits.append((int(values[n]), ends[n]))
        return {"limits": limits[::-1]}

    def enter(described: dict, state: State) -> State:
        """A first saved value up to a limit ends in the value beside the limit."""
        last, limits = state["last"] if state else start, described["limits"]
        at = bisect.bisect_left(limits, last + interval, key=lambda x: x[0])
        return {"last": limits[at][1] if at < len(limits) else last}

    return Fold(step, describe, enter)


def ingest_cursor(
    df: DataFrame,
    stream: str,
    order: list[str],
    piece: str,
    interval: int = CHECKPOINT_PIECES,
    start: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(cursor, checkpoints): the monotone next piece on every row, and the saved positions.

    A position is saved once the cursor is ``interval`` past the last one; a restart resumes at
    the saved position plus ``interval``.
    """
    cursor = (
        OrderedScan(df, stream, order)
        .add(cursor=running_max(F.col(piece)))
        .df
    )
    # Saving depends only on the distinct cursor values.
    values = cursor.select(stream, F.col("cursor").cast("bigint").alias("cursor")).distinct()
    checkpoints = sliced_fold(
        values, [stream], ["cursor"], SLICE_INTERVALS * interval, checkpoint_fold(interval, start), "saved bigint"
    ).withColumn("resume_at", F.col("saved") + interval)
    return cursor, checkpoints


def far_behind_skips(
    df: DataFrame,
    stream: str,
    order: list[str],
    head: str,
    next_piece: str,
    prefetch: int,
    limit: int = 512,
) -> DataFrame:
    """Rows where a reader is more than ``limit`` behind the highest head seen, and its jump."""
    scan = OrderedScan(df, stream, order).add(known_head=running_max(F.col(head)))
    target = F.greatest(F.col("known_head") - prefetch, F.col(next_piece) + 1)
    return scan.df.filter(F.col("known_head") - F.col(next_piece) > limit).withColumn("jump_to", target)


def reconnect_gap(df: DataFrame, next_piece: str, window_min: str) -> DataFrame:
    """Per reconnect: where reading resumes, and the range of pieces missed in between."""
    resume = F.greatest(F.col(next_piece), F.col(window_min))
    return df.withColumns(
        {
            "resume": resume,
            "missed_from": F.when(resume > F.col(next_piece), F.col(next_piece)),
            "missed": resume - F.col(next_piece),
        }
    )

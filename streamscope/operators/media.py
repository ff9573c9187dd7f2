"""Media time: clocks, segments, the live window, start-up and stalls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.fold import sliced_fold, sliced_scan
from ..plans.scan import OrderedScan, last_value, running_sum
from .clock import clock_fold, release_fold
from .segmenter import segment_fold

# Fixed values.
PCR_MODULUS = 1 << 33
PCR_HERTZ = 90_000
LIVE_WINDOW_SEGMENTS = 8
TABLE_PACKETS = 2
STALE_SECONDS = 12

#: Packets of a stream that one task folds at a time.
SLICE_PACKETS = 1 << 16


def pcr_segments(
    df: DataFrame,
    stream: str,
    order: list[str],
    pid: str,
    pcr: str,
    discontinuity: str,
) -> DataFrame:
    """Clock segments: ``segment`` number and ``elapsed`` ticks on the rows that carry the clock.

    A flagged packet ends the segment and is not part of the clock.  The first PID with a PCR after
    it is the clock.  A forward step of more than half the 33-bit range is a step backwards: that
    packet opens the next segment.
    """
    rows = df.withColumns({
        "__pid": F.col(pid).cast("double"), "__pcr": F.col(pcr).cast("double"),
        "__flag": F.coalesce(F.col(discontinuity), F.lit(False)),
    })
    uses = ["__pid", "__pcr", "__flag"]
    scan = sliced_scan(rows, [stream], order, SLICE_PACKETS, clock_fold(), uses, "segment bigint, elapsed bigint")
    return scan.drop(*uses)


def hls_segments(
    df: DataFrame,
    stream: str,
    packet: str,
    pid: str,
    pcr: str,
    access_point: str,
    discontinuity: str,
    target_seconds: float,
    max_packets: int | None = None,
    table_packets: int = TABLE_PACKETS,
) -> DataFrame:
    """Cut a packet timeline into segments: seq, start_pkt, end_pkt, duration, discontinuity.

    Where a segment ends depends on where it began, so the cuts are a fold.  It only sees packets
    that can matter (flag, clock or access point) and, with a packet limit, each stream's last
    packet, before which a limit may have been reached.  Slices of packet numbers are folded side by
    side (``sliced_fold``); a slice is no longer than the packet limit.
    """
    every = df.select(
        F.col(stream),
        F.col(packet).cast("bigint").alias("pkt"),
        F.col(pid).cast("bigint").alias("pid"),
        F.col(pcr).cast("double").alias("pcr"),
        F.coalesce(F.col(access_point), F.lit(False)).alias("access"),
        F.coalesce(F.col(discontinuity), F.lit(False)).alias("flag"),
    )
    tells = F.col("flag") | F.col("pcr").isNotNull() | F.col("access")
    rows = every.filter(tells)
    if max_packets is not None:
        last = F.max_by(F.struct(*every.columns), F.struct(F.col("pkt"), tells.alias("tells")))
        rows = rows.unionByName(every.groupBy(stream).agg(last.alias("p")).select("p.*").filter(~tells))
    width = SLICE_PACKETS if max_packets is None else min(SLICE_PACKETS, max(1, max_packets - table_packets))
    fold = segment_fold(target_seconds, max_packets, table_packets)
    schema = "seq bigint, start_pkt bigint, end_pkt bigint, duration double, discontinuity boolean"
    return sliced_fold(rows, [stream], ["pkt"], width, fold, schema)


def hls_live_window(
    segments: DataFrame,
    stream: str,
    seq: str,
    discontinuity: str,
    window: int = LIVE_WINDOW_SEGMENTS,
) -> DataFrame:
    """The newest ``window`` segments, with how many segments and marks have left the window.

    Ranking stops at ``window`` rows per map task; the counts are plain aggregates.
    """
    newest = W.partitionBy(stream).orderBy(F.col(seq).desc())
    flagged = F.count_if(F.col(discontinuity))
    inside = W.partitionBy(stream)  # over at most ``window`` rows
    kept = (
        segments.withColumn("__rank", F.row_number().over(newest))
        .filter(F.col("__rank") <= max(window, 1))
        .drop("__rank")
        .withColumns({"__kn": F.count(F.lit(1)).over(inside), "__kd": flagged.over(inside)})
    )
    all_counts = segments.groupBy(stream).agg(F.count(F.lit(1)).alias("__n"), flagged.alias("__d"))
    return (
        kept.join(all_counts, stream)
        .withColumns(
            {
                "media_seq": F.col("__n") - F.col("__kn"),
                "discontinuity_seq": F.col("__d") - F.col("__kd"),
            }
        )
        .drop("__kn", "__kd", "__n", "__d")
    )


def advisory_start(
    window: DataFrame,
    stream: str,
    seq: str,
    duration: str,
    longest: DataFrame | None = None,
) -> DataFrame:
    """How far from the live edge to start: three target durations, one segment further if there
    is room.  Null when the window is too short.

    ``window`` is a live window (``hls_live_window``), a handful of rows per stream; ``longest``
    is the longest segment ever cut per stream, which sets the target duration.
    """
    if longest is None:
        longest = window.groupBy(stream).agg(F.max(duration).alias("longest"))
    w = W.partitionBy(stream).orderBy(F.col(seq).desc())
    walked = (
        window.select(stream, seq, duration)
        .withColumn("__suffix", F.sum(duration).over(w.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("__older", F.lead("__suffix").over(w))
        # Nothing before the oldest segment: it is never a start.
        .withColumn("__oldest", F.lead(seq).over(w).isNull())
        .withColumn("__second", F.lead(seq, 2).over(w).isNull())
        .join(longest, stream)
    )
    safe = ~F.col("__oldest") & (F.col("__suffix") >= 3 * F.ceil("longest"))
    offset = F.when(F.col("__second"), F.col("__suffix")).otherwise(F.col("__older"))
    return walked.groupBy(stream).agg(
        F.round(F.min_by(offset, F.when(safe, F.col("__suffix"))), 3).alias("start_offset")
    )


def startup_release(
    df: DataFrame,
    stream: str,
    order: list[str],
    ts: str,
    nbytes: str,
    elapsed: str,
    segment: str,
    target_ms: int,
    max_bytes: int,
    timeout_ms: int,
    bitrate: str | None = None,
) -> DataFrame:
    """When and why each stream's start-up buffer is released.

    Bytes over the limit, else enough media, else the deadline; a row that begins a clock segment
    (after a flag or a step backwards) empties the buffer and starts over.  ``segment`` and
    ``elapsed``, clock ticks since then, are those of ``pcr_segments``; without a clock the
    bit rate is used.  A deadline lies between two arrivals: it has fired before a row that comes
    at or after it.
    """
    if target_ms == 0:
        first = F.struct(*order)
        return df.groupBy(stream).agg(F.min_by(ts, first).alias("released_at")).select(
            stream, "released_at", F.lit("Disabled").alias("reason"), F.lit(0).cast("bigint").alias("queued")
        )
    # No column of a literal: Spark would drop it from one of the two uses of the rows, and then they
    # are computed and shuffled twice.
    rate = [] if bitrate is None else [F.col(bitrate).cast("double").alias("__rate")]
    rows = df.select(
        stream,
        *order,
        F.unix_micros(F.col(ts).cast("timestamp")).alias("__t"),
        F.coalesce(F.col(nbytes).cast("bigint"), F.lit(0)).alias("__bytes"),
        F.col(elapsed).cast("double").alias("__elapsed"),
        *rate,
        F.coalesce(F.col(segment).cast("bigint"), F.lit(-1)).alias("__segment"),
    )
    fold = release_fold(target_ms, max_bytes, timeout_ms)
    slices = sliced_fold(rows, [stream], order, SLICE_PACKETS, fold, "t bigint, reason string, queued bigint, at bigint")
    chosen = slices.groupBy(stream).agg(
        F.coalesce(
            F.min_by(F.struct("t", "reason", "queued"), F.when(F.col("reason").isNotNull(), F.col("at"))),
            F.max_by(F.struct("t", F.lit("EndOfStream").alias("reason"), "queued"), "at"),
        ).alias("e")
    )
    kind = df.schema[ts].dataType
    return chosen.select(
        stream, F.timestamp_micros("e.t").cast(kind).alias("released_at"), "e.reason", "e.queued"
    )


def stall_intervals(
    df: DataFrame,
    stream: str,
    order: list[str],
    ts: str,
    output: str,
    activity: str,
    now: Column,
    timeout_seconds: int = STALE_SECONDS,
) -> DataFrame:
    """Gaps of at least the timeout between two rows of progress, or from the last one to ``now``.

    Output is progress; before a stream's first output, so is any activity.  A stall that is still
    open has a null ``resumed_at``.
    """
    scan = (
        OrderedScan(df, stream, order)
        .add(__outputs=running_sum(F.col(output).cast("bigint")))
        .select(__progress=F.col(output) | ((F.col("__outputs") == 0) & F.col(activity)))
        .add(stalled_from=last_value(F.when(F.col("__progress"), F.col(ts)), exclusive=True))
    )
    progress = scan.df.filter("__progress")
    closed = progress.select(stream, "stalled_from", F.col(ts).alias("resumed_at"))
    last = progress.groupBy(stream).agg(F.max_by(ts, F.struct(*order)).alias("stalled_from"))
    waits = closed.unionByName(last.withColumn("resumed_at", F.lit(None).cast(df.schema[ts].dataType)))
    end = F.coalesce("resumed_at", now)
    gap = F.unix_micros(end) - F.unix_micros("stalled_from")
    return waits.filter(gap >= timeout_seconds * 1_000_000).select(
        stream,
        "stalled_from",
        (F.col("stalled_from") + F.expr(f"interval {timeout_seconds} seconds")).alias("stale_at"),
        "resumed_at",
    )

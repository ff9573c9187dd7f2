"""Tumbling, sliding and session windows, on batches and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.expand import expand
from ..plans.scan import OrderedScan, previous, running_sum


def second_sums(df: DataFrame, stream: str, ts: str, nbytes: str, width: int = 1) -> DataFrame:
    """Bytes per ``width`` seconds, only where there were any."""
    bucket = F.expr(f"unix_seconds({ts}) div {width}")
    return df.groupBy(stream, bucket.alias("second")).agg(F.sum(nbytes).alias("nbytes"))


def bucket_seconds(
    df: DataFrame, playback: DataFrame, stream: str, ts: str, nbytes: str, width: int = 1
) -> DataFrame:
    """Bytes per ``width`` seconds for the whole playback window, empty ones as zero.

    ``playback`` has one row per stream with its bounds ``first`` and ``until``. Buckets are
    numbered since the epoch. Batch only: for a stream use ``bucket_stream`` and fill the landed
    result.
    """
    sums = second_sums(df, stream, ts, nbytes, width)
    grid = expand(playback, "first", "until", "second").select(stream, "second")
    return grid.join(sums, [stream, "second"], "left").select(
        stream, "second", F.coalesce("nbytes", F.lit(0)).alias("nbytes")
    )


def bucket_stream(
    sdf: DataFrame, stream: str, ts: str, nbytes: str, watermark: str, width: str = "1 second"
) -> DataFrame:
    return (
        sdf.withWatermark(ts, watermark)
        .groupBy(stream, F.window(ts, width).alias("w"))
        .agg(F.sum(nbytes).alias("nbytes"))
        .select(stream, F.col("w.start").alias("second"), "nbytes")
    )


def rolling_rates(
    df: DataFrame,
    stream: str,
    ts: str,
    nbytes: str,
    size: str = "60 seconds",
    slide: str = "10 seconds",
    watermark: str | None = None,
) -> DataFrame:
    """Samples and bytes per sliding window; give ``watermark`` on a stream."""
    if watermark:
        df = df.withWatermark(ts, watermark)
    return (
        df.groupBy(stream, F.window(ts, size, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("samples"), F.sum(nbytes).alias("nbytes"))
        .select(stream, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "samples", "nbytes")
    )


def viewer_sessions(
    df: DataFrame, stream: str, ts: str, grace_seconds: int
) -> DataFrame:
    """Runs of activity with gaps below ``grace_seconds``; a session ends ``grace`` after its last.

    On a batch, sessions are numbered by a scan and then aggregated, so a stream with very many
    events is not gathered in one task; on a stream ``session_window`` keeps the state.
    """
    grace = f"{grace_seconds} seconds"
    if df.isStreaming:
        return (
            df.groupBy(stream, F.session_window(ts, grace).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(stream, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
        )
    gap = F.unix_micros(ts) - F.unix_micros("__before")
    scan = (
        OrderedScan(df, stream, ts)
        .add(__before=previous(F.col(ts)))
        .select(__new=F.coalesce(gap >= grace_seconds * 1_000_000, F.lit(True)).cast("bigint"))
        .add(__session=running_sum(F.col("__new")))
    )
    return (
        scan.df.groupBy(stream, "__session")
        .agg(
            F.min(ts).alias("start"),
            (F.max(ts) + F.expr(f"interval {grace}")).alias("end"),
            F.count(F.lit(1)).alias("n"),
        )
        .drop("__session")
    )


def dedupe_deliveries(
    df: DataFrame, keys: list[str], ts: str | None = None, watermark: str | None = None
) -> DataFrame:
    """Each (stream, piece, begin) once; on a stream, repeats within the watermark are dropped."""
    if df.isStreaming:
        return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)
    return df.select(*keys).distinct()


def lease_expiry(df: DataFrame, token: str, ts: str, at: Column, ttl_seconds: int = 6 * 3600) -> DataFrame:
    """Tokens with the time they expire and whether that has passed at ``at``."""
    expires = F.max(ts) + F.expr(f"interval {ttl_seconds} seconds")
    return (
        df.groupBy(token)
        .agg(expires.alias("expires_at"))
        .withColumn("expired", F.col("expires_at") <= at)
    )

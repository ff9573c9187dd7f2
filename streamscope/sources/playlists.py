"""Media playlists as ordered lines (stream, line_no, line).

A playlist is a list of lines, so it is rendered as rows and never gathered into one value: a
stream with a very long playlist costs no more per task than a short one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F



def _lines(*parts: tuple[Column, Column]) -> Column:
    """(position, text) pairs as an array, null texts left out."""
    pairs = F.array(*[F.struct(p.alias("line_no"), t.alias("line")) for p, t in parts])
    return F.filter(pairs, lambda x: x["line"].isNotNull())


def _seconds(duration: Column) -> Column:
    return F.when(duration.isNotNull(), F.format_string("%.3f", duration))


def _emit(df: DataFrame, stream: str, lines: Column) -> DataFrame:
    return df.select(stream, F.explode(lines).alias("l")).select(stream, "l.line_no", "l.line")


def render_media_playlist(
    df: DataFrame, stream: str, seq: str, duration: str, live: bool
) -> DataFrame:
    """Header, one entry of two lines per segment, and an end mark unless ``live``.

    Header lines have numbers below zero, entries twice their sequence number.
    """
    per_stream = df.groupBy(stream).agg(
        F.max(duration).alias("__max"), F.min(seq).alias("__first"), F.max(seq).alias("__last")
    )
    target = F.greatest(F.ceil("__max"), F.lit(1))
    header = _emit(
        per_stream,
        stream,
        _lines(
            (F.lit(-4).cast("bigint"), F.lit("#EXTM3U")),
            (F.lit(-3).cast("bigint"), F.lit("#EXT-X-VERSION:3")),
            (F.lit(-2).cast("bigint"), F.concat(F.lit("#EXT-X-TARGETDURATION:"), target.cast("string"))),
            (F.lit(-1).cast("bigint"), F.concat(F.lit("#EXT-X-MEDIA-SEQUENCE:"), F.col("__first").cast("string"))),
            (F.col("__last") * 2 + 2, F.lit(None).cast("string") if live else F.lit("#EXT-X-ENDLIST")),
        ),
    )
    entries = _emit(
        df,
        stream,
        _lines(
            (F.col(seq) * 2, F.concat(F.lit("#EXTINF:"), _seconds(F.col(duration)), F.lit(","))),
            (F.col(seq) * 2 + 1, F.concat(F.lit("seg"), F.col(seq).cast("string"), F.lit(".ts"))),
        ),
    )
    return header.unionByName(entries)


def render_live_playlist(
    df: DataFrame,
    stream: str,
    seq: str,
    duration: str,
    discontinuity: str,
    window: int = 8,
    prefix: str = "seg",
) -> DataFrame:
    """The rolling playlist: only the newest ``window`` segments, with the start hint and the
    counts of what has already left the window."""
    from ..operators.media import advisory_start, hls_live_window

    kept = hls_live_window(df, stream, seq, discontinuity, window)
    longest = df.groupBy(stream).agg(F.max(duration).alias("__longest"))
    start = advisory_start(kept, stream, seq, duration, longest=longest.withColumnRenamed("__longest", "longest"))
    head = (
        kept.groupBy(stream)
        .agg(
            F.first("media_seq").alias("__media_seq"),
            F.first("discontinuity_seq").alias("__disc_seq"),
        )
        .join(longest, stream)
        .join(start.select(stream, "start_offset"), stream, "left")
    )
    header = _emit(
        head,
        stream,
        _lines(
            (F.lit(-6).cast("bigint"), F.lit("#EXTM3U")),
            (F.lit(-5).cast("bigint"), F.lit("#EXT-X-VERSION:3")),
            (F.lit(-4).cast("bigint"), F.concat(F.lit("#EXT-X-TARGETDURATION:"), F.ceil("__longest").cast("string"))),
            (
                F.lit(-3).cast("bigint"),
                F.concat(F.lit("#EXT-X-START:TIME-OFFSET=-"), _seconds(F.col("start_offset")), F.lit(",PRECISE=NO")),
            ),
            (F.lit(-2).cast("bigint"), F.concat(F.lit("#EXT-X-MEDIA-SEQUENCE:"), F.col("__media_seq").cast("string"))),
            (
                F.lit(-1).cast("bigint"),
                F.when(
                    F.col("__disc_seq") != 0,
                    F.concat(F.lit("#EXT-X-DISCONTINUITY-SEQUENCE:"), F.col("__disc_seq").cast("string")),
                ),
            ),
        ),
    )
    entries = _emit(
        kept,
        stream,
        _lines(
            (F.col(seq) * 3, F.when(F.col(discontinuity), F.lit("#EXT-X-DISCONTINUITY"))),
            (F.col(seq) * 3 + 1, F.concat(F.lit("#EXTINF:"), _seconds(F.col(duration)), F.lit(","))),
            (
                F.col(seq) * 3 + 2,
                F.concat(F.lit(f"{prefix}/"), F.col(seq).cast("string"), F.lit(".ts")),
            ),
        ),
    )
    return header.unionByName(entries)

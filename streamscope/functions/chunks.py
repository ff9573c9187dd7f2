"""Piece and chunk geometry, and byte ranges."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.scan import OrderedScan, running_sum

# Fixed values.
CHUNK_LENGTH = 16_384
MAX_PIECE_LENGTH = 8 * 1024 * 1024
MAX_CHUNKS_PER_PIECE = 65_535
MAX_OFFSET = Decimal(2**64 - 1)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chunk_address(
    df: DataFrame,
    stream: str,
    order: list[str],
    nbytes: str,
    piece_len: int,
    chunk_len: int,
    start: int = 0,
) -> DataFrame:
    """Where each write of a stream lands: ``piece``, ``chunk`` and ``begin`` of its first byte."""
    scan = OrderedScan(df, stream, order).add(
        offset=running_sum(F.col(nbytes), exclusive=True)
    )
    inside = F.pmod(F.col("offset"), F.lit(piece_len))
    return scan.df.withColumns(
        {
            "piece": F.lit(start) + F.expr(f"offset div {piece_len}"),
            "chunk": F.expr(f"(offset % {piece_len}) div {chunk_len}"),
            "begin": inside,
        }
    )


def geometry_ok(piece_len: Column | str, chunk_len: Column | str) -> Column:
    """Pieces of at most 8 MiB that are a whole number (up to 65,535) of 16 KiB chunks."""
    p, c = _col(piece_len), _col(chunk_len)
    whole = (
        (c == CHUNK_LENGTH)
        & (p > 0)
        & (p <= MAX_PIECE_LENGTH)
        & (F.pmod(p, F.lit(CHUNK_LENGTH)) == 0)
        & (p / CHUNK_LENGTH <= MAX_CHUNKS_PER_PIECE)
    )
    return F.coalesce(whole, F.lit(False))


def vod_eligible(piece_hashes: Column | str, length: Column | str, multifile: Column | str) -> Column:
    """On-demand content: a non-empty hash list, a length, and a single file."""
    return F.coalesce(
        (F.size(_col(piece_hashes)) > 0) & (_col(length) > 0) & ~_col(multifile), F.lit(False)
    )


def _offset(text: Column) -> Column:
    """An unsigned 64-bit number, or null."""
    number = F.ltrim(text, F.lit("+")).try_cast("decimal(20,0)")
    return F.when(number <= MAX_OFFSET, number)


def byte_range(spec: Column | str, total: Column | str) -> Column:
    """A ``Range`` header against ``total`` bytes: struct of outcome, first and last byte.

    ``full`` when the header is absent or is not one plain byte range, ``unsatisfiable`` when it
    is one but lies outside the content, else ``satisfiable``.
    """
    spec, total = _col(spec), _col(total)
    parts = r"^bytes=\s*(\+?[0-9]+)?\s*-\s*(\+?[0-9]+)?\s*$"
    single = F.coalesce(spec.rlike(parts), F.lit(False))
    first_text, last_text = F.regexp_extract(spec, parts, 1), F.regexp_extract(spec, parts, 2)
    first, last = _offset(first_text), _offset(last_text)
    has_first, has_last = first_text != "", last_text != ""
    outcome = (
        F.when(~single | (~has_first & ~has_last), "full")
        .when((has_first & first.isNull()) | (has_last & last.isNull()), "full")
        .when(~has_first, F.when(last == 0, "unsatisfiable").otherwise("satisfiable"))
        .when(first >= total, "unsatisfiable")
        .when(has_last & (first > last), "unsatisfiable")
        .otherwise("satisfiable")
    )
    start = F.when(has_first, first).otherwise(F.greatest(total - last, F.lit(0)))
    end = F.when(has_first & has_last, F.least(last, total - 1)).otherwise(total - 1)
    served = outcome == "satisfiable"
    return F.struct(
        outcome.alias("outcome"),
        F.when(served, start.cast("bigint")).alias("start"),
        F.when(served, end.cast("bigint")).alias("end"),
    )

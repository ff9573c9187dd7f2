"""Live windows that peers advertise, and where to start reading from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values.
NO_PIECE = 0xFFFFFFFF
PREFETCH_UNBUFFERED = 32
PREFETCH_BUFFERED_UNKNOWN_RATE = 8


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def window_normalize(df: DataFrame, min_piece: str, max_piece: str, position: str) -> DataFrame:
    """Usable windows only, with min and position forced into [0, max]."""
    top = F.col(max_piece)
    low = F.least(F.greatest(F.coalesce(F.col(min_piece), F.lit(0)), F.lit(0)), top)
    at = F.greatest(F.least(F.coalesce(F.col(position), top), top), low)
    return df.filter(top >= 0).withColumns({position: at, min_piece: low})


def window_or_null(min_piece: Column | str, max_piece: Column | str) -> Column:
    """The inclusive window, or null when an end is a placeholder or the window is inverted."""
    low, high = _col(min_piece), _col(max_piece)
    usable = ~low.isin(0, NO_PIECE) & ~high.isin(0, NO_PIECE) & (low <= high)
    return F.when(usable, F.struct(low.alias("min"), high.alias("max")))


def live_start_piece(min_piece: Column | str, position: Column | str, buffer: Column | int) -> Column:
    """``buffer`` pieces behind the position, but never before the window."""
    behind = F.greatest(_col(position) - buffer, F.lit(0))
    return F.greatest(behind, _col(min_piece))


def prefetch_pieces(
    target_ms: Column | str, bitrate: Column | str, piece_len: Column | str, sig_len: Column | int
) -> Column:
    """Pieces that hold ``target_ms`` of media, plus two."""
    target, rate = _col(target_ms), _col(bitrate)
    payload = F.greatest(_col(piece_len) - sig_len, F.lit(1)).cast("decimal(20,0)")
    bits = target.cast("decimal(19,0)") * rate.cast("decimal(19,0)")
    known = F.ceil(bits / (payload * 8000)).cast("bigint") + 2
    unknown = F.when(target == 0, PREFETCH_UNBUFFERED).otherwise(PREFETCH_BUFFERED_UNKNOWN_RATE)
    return F.when(rate.isNull(), unknown.cast("bigint")).otherwise(known)


def window_resume_ok(max_piece: Column | str, next_piece: Column | str, head: Column | str) -> Column:
    """Whether a reconnecting reader at ``next`` can go on from a window ending at ``max``."""
    top, nxt, head = _col(max_piece), _col(next_piece), _col(head)
    return (top >= nxt) | ((nxt > head) & (top >= head))

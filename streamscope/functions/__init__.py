"""Column expressions: filters and projections that stay inside whole-stage codegen."""

from .chunks import byte_range, chunk_address, geometry_ok, vod_eligible
from .network import address_class, ipv4_number, tracker_class
from .peers import live_start_piece, prefetch_pieces, window_normalize, window_or_null, window_resume_ok
from .selectors import name_ok, stream_key
from .text import bounded_categories, bounded_text

__all__ = [
    "address_class", "bounded_categories", "bounded_text", "byte_range", "chunk_address",
    "geometry_ok", "ipv4_number", "live_start_piece", "name_ok", "prefetch_pieces", "stream_key",
    "tracker_class", "vod_eligible", "window_normalize", "window_or_null", "window_resume_ok",
]

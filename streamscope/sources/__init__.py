"""Readers for what a fleet leaves in the lake, and writers for reports and playlists."""

from .journal import announces_from, read_announces
from .logs import oplog_from, read_oplog
from .packets import packet_fields, read_ts_packets
from . import samples
from .playlists import render_live_playlist, render_media_playlist
from .samples import (
    native_status, process_samples_from, read_process_samples, read_soak_streams,
    read_status_samples, soak_streams_from, status_from,
)
from .sinks import write_lines, write_verdicts

__all__ = [
    "announces_from", "native_status", "oplog_from", "packet_fields", "process_samples_from",
    "read_announces", "read_oplog", "read_process_samples", "read_soak_streams",
    "read_status_samples", "read_ts_packets", "render_live_playlist", "render_media_playlist",
    "soak_streams_from", "status_from", "write_lines", "write_verdicts",
]

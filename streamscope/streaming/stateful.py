"""Operators that carry per-stream state across micro-batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.segmenter import PCR_MODULUS, Segmenter, packet_rows
from .state import fold_stream

STALE_SECONDS = 12
ENTRY_TTL_SECONDS = 300


def _pcr(value) -> int | None:
    return None if value is None or pd.isna(value) else int(value)


def stream_clock(
    sdf: DataFrame, stream: str, packet: str, pid: str, pcr: str, discontinuity: str
) -> DataFrame:
    """The clock of ``pcr_segments`` on a stream: packet, segment, elapsed ticks."""

    def step(rows: pd.DataFrame, state: dict | None):
        s = state or {"segment": 0, "pid": None, "start": None, "last": None}
        out = []
        for pkt, p, value, flag in zip(rows["pkt"], rows["pid"], rows["pcr"], rows["flag"]):
            value = _pcr(value)
            elapsed = None
            if flag:
                s = {"segment": s["segment"] + 1, "pid": None, "start": None, "last": None}
            elif value is not None and s["pid"] in (None, int(p)):
                if s["last"] is not None and (value - s["last"]) % PCR_MODULUS > PCR_MODULUS // 2:
                    s = {"segment": s["segment"] + 1, "pid": None, "start": None, "last": None}
                s["pid"], s["last"] = int(p), value
                if s["start"] is None:
                    s["start"] = value
                elapsed = (value - s["start"]) % PCR_MODULUS
            out.append((int(pkt), s["segment"], elapsed))
        return out, s

    rows = sdf.select(
        stream,
        F.col(packet).alias("pkt"),
        F.col(pid).alias("pid"),
        F.col(pcr).alias("pcr"),
        F.coalesce(F.col(discontinuity), F.lit(False)).alias("flag"),
    )
    return fold_stream(rows, [stream], ["pkt"], "pkt bigint, segment bigint, elapsed bigint", step)


def stream_segments(
    sdf: DataFrame,
    stream: str,
    packet: str,
    pid: str,
    pcr: str,
    access_point: str,
    discontinuity: str,
    target_seconds: float,
    max_packets: int | None = None,
    window: int = 8,
    table_packets: int = 2,
) -> DataFrame:
    """``hls_segments`` on a stream, each segment with what has left the live window by then."""

    def step(rows: pd.DataFrame, state: dict | None):
        state = state or {"cutter": None, "marks": [], "gone": 0}
        cutter = Segmenter(target_seconds, max_packets, table_packets, state["cutter"])
        out = []
        for row in cutter.feed(packet_rows(rows)):
            state["marks"].append(row[4])
            if len(state["marks"]) > window:
                state["gone"] += bool(state["marks"].pop(0))
            out.append((*row, max(0, row[0] + 1 - window), state["gone"]))
        state["cutter"] = cutter.state()
        return out, state

    rows = sdf.select(
        stream,
        F.col(packet).alias("pkt"),
        F.col(pid).alias("pid"),
        F.col(pcr).cast("double").alias("pcr"),
        F.coalesce(F.col(access_point), F.lit(False)).alias("access"),
        F.coalesce(F.col(discontinuity), F.lit(False)).alias("flag"),
    )
    # With a limit the latest packet matters too, whatever it holds: it may lie beyond the limit.
    rows = rows.filter("flag or pcr is not null or access") if max_packets is None else rows
    schema = (
        "seq bigint, start_pkt bigint, end_pkt bigint, duration double, discontinuity boolean, "
        "media_seq bigint, discontinuity_seq bigint"
    )
    return fold_stream(rows, [stream], ["pkt"], schema, step)


def stream_live_edge(sdf: DataFrame, stream: str, order: list[str], piece: str) -> DataFrame:
    """Complete pieces above all before them, which are what a peer newly advertises."""

    def step(rows: pd.DataFrame, state: dict | None):
        head = state["head"] if state else None
        out = []
        for p in rows["piece"]:
            if head is None or p > head:
                head = int(p)
                out.append((head,))
        return out, {"head": head}

    rows = sdf.select(
        stream, *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(piece).alias("piece")
    )
    return fold_stream(
        rows, [stream], [f"o{i}" for i in range(len(order))], "advertised bigint", step
    )


def stall_alerts(
    sdf: DataFrame,
    stream: str,
    order: list[str],
    ts: str,
    output: str,
    activity: str,
    watermark: str,
    timeout_seconds: int = STALE_SECONDS,
) -> DataFrame:
    """``stall_intervals`` live: an alert when progress is overdue, by the next row or by a timer.

    The first stall is retried. One with no output since the stall before excludes the peer, and
    nothing more is reported until it progresses again.
    """
    timeout = timeout_seconds * 1_000_000

    def overdue(s: dict, now: int, out: list) -> None:
        while s["deadline"] is not None and s["deadline"] <= now:
            exclude = s["outputs"] == s["at_last_stall"]
            out.append((s["deadline"], exclude))
            s["at_last_stall"] = s["outputs"]
            s["deadline"] = None if exclude else s["deadline"] + timeout

    def step(rows: pd.DataFrame, state: dict | None):
        s = state or {"deadline": None, "outputs": 0, "at_last_stall": None}
        out: list = []
        for at, gave, active in zip(rows["at"], rows["gave"], rows["active"]):
            overdue(s, int(at), out)
            if gave or (s["outputs"] == 0 and active):
                s["outputs"] += bool(gave)
                s["deadline"] = int(at) + timeout
        return out, s

    def due(s: dict) -> int | None:
        return None if s["deadline"] is None else -(-s["deadline"] // 1000)

    def on_due(s: dict, now_ms: int):
        out: list = []
        overdue(s, now_ms * 1000, out)
        return out, s

    rows = sdf.withWatermark(ts, watermark).select(
        stream,
        F.col(ts),
        *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)],
        F.unix_micros(ts).alias("at"),
        F.col(output).alias("gave"),
        F.col(activity).alias("active"),
    )
    return fold_stream(
        rows,
        [stream],
        [f"o{i}" for i in range(len(order))],
        "stale_at_us bigint, excluded boolean",
        step,
        due,
        on_due,
    )


def reap_idle_entries(
    sdf: DataFrame,
    key: str,
    ts: str,
    kind: str,
    producers: str,
    watermark: str,
    ttl_seconds: int = ENTRY_TTL_SECONDS,
) -> DataFrame:
    """``idle_entries`` live: an entry is reaped once it has been idle for the whole limit."""
    ttl = ttl_seconds * 1_000_000

    def reapable(s: dict) -> bool:
        return s["kind"] != "broadcast" and s["producers"] <= 0

    def step(rows: pd.DataFrame, state: dict | None):
        s, out = state, []
        for at, kind_, n in zip(rows["at"], rows["kind"], rows["producers"]):
            if s and not s.get("gone") and reapable(s) and int(at) - s["at"] >= ttl:
                out.append((s["at"],))
            s = {"at": int(at), "kind": kind_, "producers": int(n)}
        return out, s

    def due(s: dict) -> int | None:
        return None if s.get("gone") or not reapable(s) else -(-(s["at"] + ttl) // 1000)

    def on_due(s: dict, now_ms: int):
        return [(s["at"],)], {**s, "gone": True}

    rows = sdf.withWatermark(ts, watermark).select(
        key,
        F.col(ts),
        F.unix_micros(ts).alias("at"),
        F.col(kind).alias("kind"),
        F.col(producers).alias("producers"),
    )
    return fold_stream(rows, [key], ["at"], "last_active_us bigint", step, due, on_due)


def stream_catalog(
    requests: DataFrame,
    catalog: DataFrame,
    key: str,
    ts: str,
    ident: str,
    value: str,
    ttl_seconds: int = 300,
) -> DataFrame:
    """``resolve_catalog`` with both sides live: each request with the entry known at its time."""

    def step(rows: pd.DataFrame, state: dict | None):
        s = state or {"value": None, "at": None}
        out = []
        for at, is_request, i, v in zip(rows["at"], rows["is_request"], rows["ident"], rows["value"]):
            at = int(at)
            if not is_request:
                s = {"value": v, "at": at}
                continue
            fresh = s["at"] is not None and at - s["at"] < ttl_seconds * 1_000_000
            out.append((i, s["value"] if fresh else None, fresh))
        return out, s

    none = F.lit(None).cast("string")
    asked = requests.select(
        key,
        F.unix_micros(ts).alias("at"),
        F.lit(True).alias("is_request"),
        F.col(ident).cast("string").alias("ident"),
        none.alias("value"),
    )
    known = catalog.select(
        key,
        F.unix_micros(ts).alias("at"),
        F.lit(False).alias("is_request"),
        none.alias("ident"),
        F.col(value).cast("string").alias("value"),
    )
    schema = "ident string, value string, resolved boolean"
    return fold_stream(asked.unionByName(known), [key], ["at", "is_request"], schema, step)


def stream_checkpoints(
    sdf: DataFrame, stream: str, order: list[str], piece: str, interval: int = 128, start: int = 0
) -> DataFrame:
    """Positions ``ingest_cursor`` would save, as they are reached."""

    def step(rows: pd.DataFrame, state: dict | None):
        last = state["last"] if state else start
        out = []
        for value in rows["piece"]:
            if value >= last + interval:
                last = int(value)
                out.append((last, last + interval))
        return out, {"last": last}

    rows = sdf.select(
        stream, *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(piece).alias("piece")
    )
    return fold_stream(
        rows, [stream], [f"o{i}" for i in range(len(order))], "saved bigint, resume_at bigint", step
    )

"""The clock of a packet timeline and the start-up buffer, as folds over slices of it."""

from __future__ import annotations

from itertools import repeat

import numpy as np

from ..plans.fold import Fold, Rows, State
from .segmenter import PCR_HERTZ, PCR_MODULUS

_HALF = PCR_MODULUS // 2


def _backwards(step) -> bool:
    """A forward step of more than half the clock's range is a step backwards."""
    return step % PCR_MODULUS > _HALF


_NAN = float("nan")


def _packets(rows: Rows):
    """Flag, PID and clock of each packet. Most slices hold a few rows, for which a plain walk is
    many times as fast as arrays, and no slice holds so many that it would matter."""
    return zip(*(rows[n].tolist() for n in ("__flag", "__pid", "__pcr")))


def clock_fold() -> Fold:
    """Segment number and ticks since its start; rows have __pid, __pcr (NaN if none), __flag.

    State: the clock's PID, its last value, the value at which the segment began, and the segment.
    What enters a slice matters only before its first flag, and there only by the PID and those
    values; so that part is described for each PID and the rest by its outcome.
    """

    def step(rows: Rows, state: State) -> tuple[list, State]:
        state = state or {"pid": None, "last": None, "start": None, "segment": 0}
        pid, last, start, segment = (state[k] for k in ("pid", "last", "start", "segment"))
        segments, elapsed = [], []
        for flag, p, v in _packets(rows):
            ticks = _NAN
            if flag:
                pid = last = start = None
                segment += 1
            elif v == v and p == p and (pid is None or p == pid):
                v = int(v)
                if pid is None:
                    pid, start = int(p), v
                elif _backwards(v - last):
                    start = v
                    segment += 1
                last = v
                ticks = (v - start) % PCR_MODULUS
            segments.append(segment)
            elapsed.append(ticks)
        after = {"segment": segment, "pid": pid, "last": last, "start": start}
        return [np.array(segments, np.int64), np.array(elapsed, float)], after

    def describe(rows: Rows) -> dict:
        heads: dict[int, list] = {}
        first = pid = last = start = None
        flags = body = 0
        for flag, p, v in _packets(rows):
            if flag:
                pid = last = start = None
                flags += 1
            elif v == v and p == p:
                p, v = int(p), int(v)
                if not flags:
                    head = heads.setdefault(p, [v, v, None, 0])
                    first = p if first is None else first
                    if _backwards(v - head[1]):
                        head[2] = v
                        head[3] += 1
                    head[1] = v
                elif pid is None:
                    pid, last, start = p, v, v
                elif p == pid:
                    if _backwards(v - last):
                        start = v
                        body += 1
                    last = v
        tail = None if pid is None else [pid, last, start]
        return {"heads": heads, "first": first, "flags": flags, "body": body, "tail": tail}

    def enter(described: dict, state: State) -> State:
        state = state or {"pid": None, "last": None, "start": None, "segment": 0}
        pid, last, start, segment = (state[k] for k in ("pid", "last", "start", "segment"))
        fresh = pid is None
        pid = described["first"] if fresh else pid
        head = described["heads"].get(str(pid))
        if head:
            back = not fresh and _backwards(head[0] - last)
            segment += head[3] + back
            start = head[2] if head[3] else head[0] if fresh or back else start
            last = head[1]
        segment += described["flags"] + described["body"]
        if described["flags"]:
            pid, last, start = described["tail"] or (None, None, None)
        return {"pid": pid, "last": last, "start": start, "segment": segment}

    return Fold(step, describe, enter)


def release_fold(target_ms: int, max_bytes: int, timeout_ms: int) -> Fold:
    """When a stream's start-up buffer would be released in a slice: one row for each slice.

    Rows have __t (microseconds), __bytes, __elapsed (ticks or NaN), __segment
    and, if known, __rate (bits a second or NaN). Output: t, reason (null if nothing releases it here; then t and queued are those
    of the last row), queued, at (the row's number in the stream). State: rows and bytes so far, the
    segment of the last row, and the time and the bytes at which the buffer was last emptied.
    """

    def step(rows: Rows, state: State) -> tuple[list[tuple], State]:
        state = state or {"rows": 0, "bytes": 0, "segment": None, "t": None, "b": 0}
        upto, segment, since, level = (state[k] for k in ("bytes", "segment", "t", "b"))
        found = None
        rates = rows["__rate"].tolist() if "__rate" in rows else repeat(_NAN)
        columns = (rows[c].tolist() for c in ("__t", "__bytes", "__elapsed", "__segment"))
        for n, (rate, t, size, elapsed, here) in enumerate(zip(rates, *columns)):
            prior, upto = upto, upto + size
            deadline = None if since is None else since + 1000 * timeout_ms
            held = prior - level
            if since is None or here != segment:
                segment, since, level = here, t, prior
            if found is not None:
                continue
            queued = upto - level
            media_us = elapsed * 1_000_000 / PCR_HERTZ
            if not media_us > 0:
                media_us = queued * 8_000_000 / rate if rate > 0 else 0
            if deadline is not None and deadline <= t:
                found = (deadline, "Deadline", held, state["rows"] + n)
            elif queued > max_bytes:
                found = (t, "ByteLimit", queued, state["rows"] + n)
            elif media_us >= 1000 * target_ms:
                found = (t, "TargetDuration", queued, state["rows"] + n)
        row = found or (t, None, queued, state["rows"] + n)
        rows_after = state["rows"] + n + 1
        return [row], {"rows": rows_after, "bytes": upto, "segment": segment, "t": since, "b": level}

    def describe(rows: Rows) -> dict:
        """Rows, bytes; first and last segment; first time; the last change, with the bytes before."""
        segment, size = rows["__segment"], rows["__bytes"]
        inside = np.flatnonzero(segment[1:] != segment[:-1]) + 1
        change = None
        if len(inside):
            change = [int(rows["__t"][inside[-1]]), int(size[: inside[-1]].sum())]
        return {
            "rows": len(size), "bytes": int(size.sum()), "first": int(segment[0]), "last": int(segment[-1]), "t": int(rows["__t"][0]),
            "change": change,
        }

    def enter(described: dict, state: State) -> State:
        so_far = state["bytes"] if state else 0
        if described["change"]:
            t, b = described["change"][0], so_far + described["change"][1]
        elif state is None or state["segment"] != described["first"]:
            t, b = described["t"], so_far
        else:
            t, b = state["t"], state["b"]
        rows = described["rows"] + (state["rows"] if state else 0)
        return {"rows": rows, "bytes": so_far + described["bytes"], "segment": described["last"], "t": t, "b": b}

    return Fold(step, describe, enter)

"""The segment fold: cutting one stream's packets, and describing what a slice of them does."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from ..plans.fold import Fold, Rows, State

# Fixed values.
PCR_MODULUS = 1 << 33
PCR_HERTZ = 90_000


class Segmenter:
    """Cuts one stream's packets into segments.

    Only packets with a flag, a clock value or an access point need to be fed.  With a packet limit
    a cut can fall on a packet in between, so the limit is checked before each fed packet.
    """

    FIELDS = ("opened", "pid", "origin", "latest", "pending", "seq")

    def __init__(self, target: float, limit: int | None, tables: int, state: State = None):
        self.target, self.limit, self.tables = target, limit, tables
        self.opened = None  # first packet of the open segment
        self.pid = self.origin = self.latest = None  # clock PID, its value at the start and now
        self.pending = False  # the next segment follows a break
        self.seq = 0
        for name, value in (state or {}).items():
            setattr(self, name, value)

    def state(self) -> dict:
        return {name: getattr(self, name) for name in self.FIELDS}

    def feed(self, rows: list[tuple]) -> list[tuple]:
        done: list[tuple] = []
        for row in rows:
            self.take(row, done)
        return done

    def take(self, row: tuple, done: list[tuple]) -> None:
        """One packet: its number, PID, clock, access point, flag."""
        pkt, pid, pcr, is_access, is_flag = row
        at_limit = self._advance_to(pkt, done)
        if is_flag:
            self._abandon()
            return
        if self.opened is None:
            if is_access and (self.limit is None or self.tables < self.limit):
                self._open(pkt, pid, pcr)
            return
        if not self._tick(pid, pcr):
            self._abandon()
        elif self._reached() and (at_limit or is_access):
            self._finish(pkt, done)
        elif at_limit:
            self._abandon()
            if is_access:
                self._open(pkt, pid, pcr)

    def _advance_to(self, pkt: int, done: list[tuple]) -> bool:
        """Handle limits reached by plain packets before ``pkt``; is ``pkt`` itself the one?"""
        if self.limit is None:
            return False
        while self.opened is not None:
            beyond = self.opened + self.limit - self.tables
            if beyond >= pkt:
                return beyond == pkt
            if self._reached():
                self._finish(beyond, done)
            else:
                self._abandon()
        return False

    def _open(self, pkt, pid, pcr) -> None:
        self.opened = pkt
        self.pid = self.origin = self.latest = None
        self._tick(pid, pcr)

    def _abandon(self) -> None:
        self.opened = self.pid = self.origin = self.latest = None
        self.pending = True

    def _tick(self, pid, pcr) -> bool:
        """Advance the clock; false on a step backwards."""
        if pcr is None or self.pid not in (None, pid):
            return True
        if self.latest is not None and (pcr - self.latest) % PCR_MODULUS > PCR_MODULUS // 2:
            return False
        self.pid, self.latest = pid, pcr
        if self.origin is None:
            self.origin = pcr
        return True

    def _ticks(self):
        if self.origin is None:
            return None
        ticks = (self.latest - self.origin) % PCR_MODULUS
        return ticks if ticks <= PCR_MODULUS // 2 else None

    def _reached(self) -> bool:
        ticks = self._ticks()
        return ticks is not None and ticks >= self.target * PCR_HERTZ

    def _finish(self, next_pkt, done) -> None:
        """Close the open segment before ``next_pkt``, which starts the next one on its clock."""
        seconds = round(self._ticks() / PCR_HERTZ, 3)
        done.append((self.seq, self.opened, next_pkt - 1, seconds, self.pending))
        self.seq += 1
        self.pending = False
        self.opened = next_pkt
        self.origin = self.latest


Node = tuple  # (next row, open packet, PID, origin, latest)
NOTHING = (None, None, None, None)


class SliceOfPackets:
    """What a slice does to any segment that is open, or to none, when the slice begins.

    Once a segment has begun at an access point inside the slice, what follows depends on that
    packet, the clock's PID and its value alone, not on what entered.  So the end of the slice is
    found once for each access point at which an entering segment may meet its first or second cut,
    by following one cut to the next until another packet's way is joined.  Those are in the first
    two target durations: a segment on a clock of the slice has reached the target by the end of
    the first, or by the end of the second if its packet limit cut it in between.  The limit cuts a
    segment once in a slice at most, as a slice is no longer than the limit.

    The rest of the slice is kept as well, for segments on a clock that it does not show or that
    have been open for half the clock's range, but without clock values that cannot matter: those
    not beside an access point, a flag or a step backwards.  With a packet limit such a value could
    matter only if the clock ran through its whole range, 26 hours, within one limit; it is kept
    where the clock advances by JUMP in a slice.

    An end is (open packet, PID, origin, latest, segments, pending); pending is None while it is as
    at the start.
    """

    JUMP = 1 << 28

    def __init__(self, rows: list[tuple], target: float, limit: int | None, tables: int):
        self.rows, self.options = rows, (target, limit, tables)
        self.known: dict[Node, tuple] = {}

    def _after(self, node: Node, limited: bool = True) -> tuple[Node | None, Segmenter]:
        """The next node: a segment begun or given up at a row; None at the slice's end."""
        target, limit, tables = self.options
        cutter = Segmenter(target, limit if limited else None, tables)
        cutter.opened, cutter.pid, cutter.origin, cutter.latest = node[1:]
        cutter.pending = None
        for n in range(node[0], len(self.rows)):
            cutter.take(self.rows[n], [])
            begun = cutter.opened == self.rows[n][0] and cutter.opened != node[1]
            if begun or (cutter.opened is None and node[1] is not None):
                return (n + 1, cutter.opened, cutter.pid, cutter.origin, cutter.latest), cutter
        return None, cutter

    def end(self, node: Node | None) -> tuple:
        """The end of the slice from a node."""
        way = []
        while node is not None and node not in self.known:
            following, cutter = self._after(node)
            way.append((node, cutter.seq, cutter.pending))
            if following is None:
                last = (cutter.opened, cutter.pid, cutter.origin, cutter.latest, 0, None)
            node = following
        if node is not None:
            last = self.known[node]
        for passed, segments, pending in reversed(way):
            last = (*last[:4], last[4] + segments, pending if last[5] is None else last[5])
            self.known[passed] = last
        return last

    def _two_cuts(self, pid: int) -> int:
        """Rows in which a segment on this clock meets two cuts or is given up."""
        node: Node = (0, self.rows[0][0] - 1, pid, None, None)
        for _ in range(2):
            node, _ = self._after(node, limited=False)
            if node is None:
                return len(self.rows)
            if node[1] is None:
                break
        return node[0]

    def _telling(self) -> list[bool]:
        """Which rows can matter when no packet limit falls between rows."""
        kept = [access or flag for _, _, _, access, flag in self.rows]
        held: dict[int, int] = {}  # the last row of each clock, if not kept
        values: dict[int, tuple[int, int]] = {}  # last kept value and last value of each clock
        fresh = True  # no clock value since an access point or flag
        for n, (_, pid, pcr, access, flag) in enumerate(self.rows):
            if pcr is not None:
                told, before = values.get(pid, (pcr, pcr))
                back = (pcr - before) % PCR_MODULUS > PCR_MODULUS // 2
                if back or (pcr - told) % PCR_MODULUS > PCR_MODULUS // 2:
                    if pid in held:
                        kept[held.pop(pid)] = True
                    told = before
                if back or fresh or kept[n] or pid not in values:
                    kept[n], told, fresh = True, pcr, False
                    held.pop(pid, None)
                else:
                    held[pid] = n
                values[pid] = (told, pcr)
            if access or flag:
                for p, m in held.items():
                    kept[m] = True
                    values[p] = (self.rows[m][2], values[p][1])
                held.clear()
                fresh = True
        for m in held.values():
            kept[m] = True
        return kept

    def _jumps(self) -> bool:
        seen: dict[int, int] = {}
        passed: dict[int, int] = {}
        for _, pid, pcr, _, _ in self.rows:
            if pcr is not None:
                passed[pid] = passed.get(pid, 0) + (pcr - seen.get(pid, pcr)) % PCR_MODULUS
                seen[pid] = pcr
        return max(passed.values(), default=0) >= self.JUMP

    def described(self) -> dict:
        rows, limit = self.rows, self.options[1]
        access = next((n + 1 for n, r in enumerate(rows) if r[3]), len(rows))
        pids = {pid for _, pid, pcr, _, _ in rows if pcr is not None}
        kept = max([access, *map(self._two_cuts, pids)])
        starts: list[tuple] = []
        latest: dict[int, int] = {}
        for n, (pkt, pid, pcr, is_access, _) in enumerate(rows[:kept]):
            if pcr is not None:
                latest[pid] = pcr
            if is_access:
                starts.append((n + 1, pkt, None if pcr is None else pid, pcr, pcr))
                starts += [(n + 1, pkt, p, v, v) for p, v in latest.items()]
        # From the back, so that each way soon joins one that is known.
        ends = {node: self.end(node) for node in reversed(starts)}
        telling = self._telling()
        first = [r for n, r in enumerate(rows[:kept]) if limit is not None or telling[n]]
        whole = limit is not None and self._jumps()
        rest = [r for n, r in enumerate(rows[kept:], kept) if whole or telling[n]]
        return {
            "first": first, "rest": json.dumps(rest),
            "ends": [[*node[1:4], end] for node, end in ends.items()],
        }


def enter(target: float, limit: int | None, tables: int, described: dict, state: State) -> dict:
    """The state after a slice, from its description and the state before it."""
    cutter = Segmenter(target, limit, tables, state)
    ends = {tuple(e[:3]): e[3] for e in described["ends"]}

    def rows() -> Iterator[list]:
        yield from described["first"]
        yield from json.loads(described["rest"])

    for row in rows():
        cutter.take(row, [])
        if cutter.opened == row[0] and cutter.origin == cutter.latest:
            end = ends.get((row[0], cutter.pid, cutter.latest))
            if end is not None:
                pending = cutter.pending if end[5] is None else end[5]
                return dict(zip(Segmenter.FIELDS, (*end[:4], pending, cutter.seq + end[4])))
    return cutter.state()


def packet_rows(rows: Rows) -> list[tuple]:
    """Rows for `Segmenter.feed` from columns; a missing clock is NaN."""
    clocks = (None if v is None or math.isnan(v) else int(v) for v in rows["pcr"].tolist())
    pkts, pids, access, flags = (rows[n].tolist() for n in ("pkt", "pid", "access", "flag"))
    return list(zip(pkts, pids, clocks, access, flags))


def segment_fold(target: float, limit: int | None, tables: int) -> Fold:
    def step(rows: Rows, state: State) -> tuple[list[tuple], State]:
        cutter = Segmenter(target, limit, tables, state)
        return cutter.feed(packet_rows(rows)), cutter.state()

    return Fold(
        step,
        lambda rows: SliceOfPackets(packet_rows(rows), target, limit, tables).described(),
        lambda described, state: enter(target, limit, tables, described, state),
    )

"""Position rules whose exits depend on the entry, as machines over chunks of a pair's bars."""
from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np

from ..core.scan import Arrays, FiniteMachine, Machine, next_true

FLAT, LONG, SHORT = 0, 1, 2
SIDE = np.array([0.0, 1.0, -1.0])


@dataclass(frozen=True)
class ClassMachine(FiniteMachine):
    """Open against the spread on a revert call at a high |z|; close on a small |z|, a diverge call or a sign flip."""

    entry_z: float = 1.5
    exit_z: float = 0.5
    out: str = "signal"
    columns = ("latest_spread_z", "current_spread", "pred_class")

    @property
    def makes(self) -> dict[str, str]:
        return {self.out: "double"}

    def maps(self, a: Arrays) -> np.ndarray:
        z = np.abs(np.nan_to_num(a["latest_spread_z"].astype(float)))
        side = np.sign(np.nan_to_num(a["current_spread"].astype(float)))
        call = np.nan_to_num(a["pred_class"].astype(float), nan=-1.0)
        enters = (call == 0) & (z >= self.entry_z)
        leaves = (z <= self.exit_z) | (call == 2)
        out = np.empty((len(z), 3), dtype=np.int8)
        out[:, FLAT] = np.where(enters & (side < 0), LONG, np.where(enters & (side > 0), SHORT, FLAT))
        out[:, LONG] = np.where(leaves | (side > 0), FLAT, LONG)
        out[:, SHORT] = np.where(leaves | (side < 0), FLAT, SHORT)
        return out

    def values(self, states: np.ndarray) -> dict[str, Any]:
        return {self.out: SIDE[states]}


class TradeMachine(Machine):
    """A trade runs from an entry bar to the exit that this entry fixes; the exit bar itself enters nothing.

    A chunk's summary says, for every bar at which a trade from before may end, which state the chunk ends in if the
    bar after it begins flat."""

    def entries(self, a: Arrays) -> np.ndarray:
        raise NotImplementedError

    def exits(self, a: Arrays, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit bar of every entry, n if it lies beyond the chunk; whether this exit halts the key)."""
        raise NotImplementedError

    def _ends(self, a: Arrays, entries: np.ndarray, exits: np.ndarray, halts: np.ndarray) -> np.ndarray:
        """By p from 0 to n: the entry whose trade is open at the end if bar p begins flat; -1 flat, -2 halted."""
        n, out = len(next(iter(a.values()))), np.full(len(entries) + 1, -1, dtype=np.int64)
        follows = np.searchsorted(entries, exits + 1)
        for k in range(len(entries) - 1, -1, -1):
            out[k] = entries[k] if exits[k] >= n else -2 if halts[k] else out[follows[k]]
        return out[np.searchsorted(entries, np.arange(n + 1))]

    def trades(self, a: Arrays, begin: int) -> list[tuple[int, int, bool]]:
        """(entry, exit, halts) of all trades from bar ``begin`` on."""
        entries = np.flatnonzero(self.entries(a))
        exits, halts = self.exits(a, entries)
        out, k = [], int(np.searchsorted(entries, begin))
        while k < len(entries):
            out.append((int(entries[k]), int(exits[k]), bool(halts[k])))
            if halts[k] and exits[k] < len(self.entries(a)):
                break
            k = int(np.searchsorted(entries, exits[k] + 1))
        return out


@dataclass(frozen=True)
class ExitMachine(TradeMachine):
    """Leave at ``stop``, and by mode at a small |z|, after ``max_hold`` bars or when z has changed sign; settings stand in the rows."""

    enter: float = 2.0
    exit_z: float = 0.5
    out: str = "position"
    columns = ("z", "exit_mode", "stop", "max_hold")

    @property
    def makes(self) -> dict[str, str]:
        return {self.out: "double"}

    def first(self, a: Arrays) -> tuple:
        return (0.0, 0)

    def _leaves(self, a: Arrays) -> np.ndarray:
        """Bars that end any trade, whatever its entry."""
        z = np.abs(a["z"].astype(float))
        out = ~np.isfinite(z) | (z >= a["stop"][0])
        return out | (z <= self.exit_z) if a["exit_mode"][0] == "z" else out

    def _cap(self, a: Arrays) -> float:
        return max(2.0, float(a["max_hold"][0])) if a["exit_mode"][0] in ("time", "conv") else np.inf

    def _next(self, a: Arrays) -> dict[float, np.ndarray]:
        """By the side of z at the entry: the next bar that ends such a trade."""
        sign, leaves = np.sign(a["z"].astype(float)), self._leaves(a)
        conv = a["exit_mode"][0] == "conv"
        return {s: next_true(leaves | (sign != s) if conv else leaves) for s in (1.0, -1.0)}

    def entries(self, a: Arrays) -> np.ndarray:
        z = np.abs(a["z"].astype(float))
        return (z >= self.enter) & (z < a["stop"][0]) & np.isfinite(z)

    def exits(self, a: Arrays, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, ends = len(a["z"]), self._next(a)
        up = a["z"][entries].astype(float) > 0
        by_rule = np.where(up, ends[1.0][entries + 1], ends[-1.0][entries + 1])
        return np.minimum(by_rule, np.minimum(np.ceil(entries + self._cap(a) - 1), n)).astype(np.int64), np.zeros(len(entries), dtype=bool)

    def summary(self, a: Arrays) -> tuple:
        n, entries = len(a["z"]), np.flatnonzero(self.entries(a))
        opened = self._ends(a, entries, *self.exits(a, entries))
        ends = {s: int(x[0]) for s, x in self._next(a).items()}
        reach = max([0, *(min(e, n - 1) + 1 for e in ends.values())])  # a trade from before ends at this bar at the latest
        if np.isinf(self._cap(a)):  # and only there
            keep = sorted({0, *(e + 1 for e in ends.values() if e < n)})
            return n, ends, self._cap(a), {p: self._state(a, opened[p]) for p in keep}
        return n, ends, self._cap(a), {p: self._state(a, opened[p]) for p in range(reach + 1)}

    def _state(self, a: Arrays, entry: int) -> tuple:
        return (0.0, 0) if entry < 0 else (float(np.sign(a["z"][entry])), len(a["z"]) - int(entry))

    def _leave_at(self, state: tuple, n: int, ends: dict, cap: float) -> int:
        side, age = state
        return int(min(ends[side], np.ceil(max(0.0, cap - age - 1)), n))

    def advance(self, state: tuple, summary: tuple) -> tuple:
        n, ends, cap, after = summary
        if not state[0]:
            return after[0]
        x = self._leave_at(state, n, ends, cap)
        return (state[0], state[1] + n) if x >= n else after[x + 1]

    def rows(self, a: Arrays, state: tuple) -> dict[str, Any]:
        out, begin = np.zeros(len(a["z"])), 0
        if state[0]:
            x = self._leave_at(state, len(out), {s: int(e[0]) for s, e in self._next(a).items()}, self._cap(a))
            out[:x], begin = -state[0], x + 1
        for e, x, _ in self.trades(a, begin):
            out[e:x] = -np.sign(a["z"][e])
        return {self.out: out}


@dataclass(frozen=True)
class BreakMachine(TradeMachine):
    """Leave at a small or missing z, when the long leg crashes, either leg moves against the trade, or the loss is too high.

    A break may halt the key. The state is (side, entry log prices, P&L so far, last log prices); side 2 is halted."""

    enter: float = 2.0
    exit_z: float = 0.5
    fall: float = np.inf
    rise: float = np.inf
    loss: float = np.inf
    halt: bool = False
    out: str = "position"
    columns = ("z", "la", "lb")

    @property
    def makes(self) -> dict[str, str]:
        return {self.out: "double"}

    def first(self, a: Arrays) -> tuple:
        return (0.0, 0.0, 0.0, 0.0, float(a["la"][0]), float(a["lb"][0]))

    def _z(self, a: Arrays) -> np.ndarray:
        return np.abs(a["z"].astype(float))

    def _calm(self, a: Arrays) -> np.ndarray:
        z = self._z(a)
        return ~np.isfinite(z) | (z <= self.exit_z)

    def _moves(self, a: Arrays) -> np.ndarray:
        """Sum of the spread's moves since the chunk's first bar; moves from or to a missing price count as none."""
        d = np.nan_to_num(np.diff(a["la"].astype(float))) - np.nan_to_num(np.diff(a["lb"].astype(float)))
        return np.concatenate([[0.0], np.cumsum(d)])

    def entries(self, a: Arrays) -> np.ndarray:
        z = self._z(a)
        return np.isfinite(z) & (z >= self.enter)

    def _broken(self, side: float, a0: float, b0: float, gain: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
        up, down = (la - a0, lb - b0) if side > 0 else (lb - b0, la - a0)
        with np.errstate(invalid="ignore"):
            return (up < -self.fall) | (down > self.rise) | (gain < -self.loss)

    def exits(self, a: Arrays, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, moves, la, lb = len(a["z"]), self._moves(a), a["la"].astype(float), a["lb"].astype(float)
        calm = next_true(self._calm(a))
        out, halts = np.empty(len(entries), dtype=np.int64), np.zeros(len(entries), dtype=bool)
        for k, e in enumerate(entries):
            side, to = -np.sign(a["z"][e]), calm[e + 1]
            broken = self._broken(side, la[e], lb[e], side * (moves[e + 1:to] - moves[e]), la[e + 1:to], lb[e + 1:to])
            at = int(np.argmax(broken)) if broken.any() else -1
            out[k] = to if at < 0 else e + 1 + at
            halts[k] = at >= 0 and self.halt
        return out, halts

    def _records(self, a: Arrays) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Bars at which the extremes of prices and moves are reached anew, up to the first calm bar, and their values."""
        to = int(next_true(self._calm(a))[0])
        out = {}
        for name, values in (("la", a["la"].astype(float)), ("lb", a["lb"].astype(float)), ("moves", self._moves(a))):
            for end, run in (("low", np.fmin), ("high", np.fmax)):
                best = run.accumulate(values[:to])
                new = np.flatnonzero(np.concatenate([np.isfinite(best[:1]), (best[1:] != best[:-1]) & np.isfinite(best[1:])]))
                out[f"{name}_{end}"] = (new, best[new])
        return out

    def summary(self, a: Arrays) -> tuple:
        n, entries, calm = len(a["z"]), np.flatnonzero(self.entries(a)), int(next_true(self._calm(a))[0])
        opened = self._ends(a, entries, *self.exits(a, entries))
        records = self._records(a)
        begin = {0, min(calm + 1, n), *(int(p) + 1 for at, _ in records.values() for p in at)}
        ends = (float(a["la"][0]), float(a["lb"][0]), float(a["la"][-1]), float(a["lb"][-1]))
        return n, calm, records, float(self._moves(a)[-1]), ends, {p: self._state(a, opened[p]) for p in begin}

    def _state(self, a: Arrays, entry: int) -> tuple:
        ends = (float(a["la"][-1]), float(a["lb"][-1]))
        if entry < 0:
            return (0.0 if entry == -1 else 2.0, 0.0, 0.0, 0.0, *ends)
        side, moves = float(-np.sign(a["z"][entry])), self._moves(a)
        return (side, float(a["la"][entry]), float(a["lb"][entry]), float(side * (moves[-1] - moves[entry])), *ends)

    def _gap(self, state: tuple, la: float, lb: float) -> float:
        """The spread's move from the bar before a chunk to its first one."""
        return float(np.nan_to_num(la - state[4]) - np.nan_to_num(lb - state[5]))

    def advance(self, state: tuple, summary: tuple) -> tuple:
        n, calm, records, moved, (la0, lb0, la1, lb1), after = summary
        side, a0, b0, gain = state[:4]
        if side == 2.0:
            return (2.0, 0.0, 0.0, 0.0, la1, lb1)
        if side == 0.0:
            return after[0]
        gain += side * self._gap(state, la0, lb0)
        long = side > 0
        tests = [(*records["la_low" if long else "lb_low"], lambda v: v - (a0 if long else b0) < -self.fall),
                 (*records["lb_high" if long else "la_high"], lambda v: v - (b0 if long else a0) > self.rise),
                 (*records["moves_low" if long else "moves_high"], lambda v: gain + side * v < -self.loss)]
        hits = [int(at[np.argmax(hit)]) for at, values, test in tests if (hit := test(values)).any()]
        x = min([calm, *hits])
        if x >= n:
            return (side, a0, b0, gain + side * moved, la1, lb1)
        return (2.0, 0.0, 0.0, 0.0, la1, lb1) if x < calm and self.halt else after[x + 1]

    def rows(self, a: Arrays, state: tuple) -> dict[str, Any]:
        n, begin = len(a["z"]), 0
        out = np.zeros(n)
        if state[0] == 2.0:
            return {self.out: out}
        if state[0]:
            side, a0, b0, gain = state[:4]
            gain += side * self._gap(state, float(a["la"][0]), float(a["lb"][0]))
            calm = int(next_true(self._calm(a))[0])
            broken = self._broken(side, a0, b0, gain + side * self._moves(a)[:calm], a["la"][:calm].astype(float), a["lb"][:calm].astype(float))
            x = int(np.argmax(broken)) if broken.any() else calm
            out[:x], begin = side, x + 1
            if x < calm and self.halt:
                return {self.out: out}
        for e, x, _ in self.trades(a, begin):
            out[e:x] = -np.sign(a["z"][e])
        return {self.out: out}


@dataclass(frozen=True)
class CooldownMachine(Machine):
    """Greedy thinning: an event counts when ``gap`` bars have passed since the last counted one. The state is that bar."""

    gap: int
    idx: str = "i"
    makes = {"_keep": "boolean"}

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.idx,)

    def first(self, a: Arrays) -> float:
        return -np.inf

    def _follows(self, v: np.ndarray) -> np.ndarray:
        return np.searchsorted(v, v + self.gap)

    def summary(self, a: Arrays) -> tuple:
        v = a[self.idx].astype(np.int64)
        follows, ends = self._follows(v), v.astype(float)
        for k in range(len(v) - 1, -1, -1):
            if follows[k] < len(v):
                ends[k] = ends[follows[k]]
        m = int(np.searchsorted(v, v[0] + self.gap)) + 1  # a bar counted before the chunk blocks none after these
        return v[:m], ends[:m]

    def advance(self, state: float, summary: tuple) -> float:
        v, ends = summary
        k = int(np.searchsorted(v, state + self.gap))
        return float(ends[k]) if k < len(v) else state

    def rows(self, a: Arrays, state: float) -> dict[str, Any]:
        v = a[self.idx].astype(np.int64)
        follows, keep, k = self._follows(v), np.zeros(len(v), dtype=bool), int(np.searchsorted(v, state + self.gap))
        while k < len(v):
            keep[k], k = True, int(follows[k])
        return {"_keep": keep}

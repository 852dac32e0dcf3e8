"""The token bucket as a function that composes.

A bucket's state is a whole number of units: ``unit`` of them are a token and a
microsecond refills ``step``, so every sum and comparison is exact. What a
stretch of requests does to the tokens at hand when its first request comes is
a function of pieces: on each piece the tokens left at its end either grow with
those at hand, or are the same throughout (the bucket filled up on the way).
The functions compose, so a stretch of one client's log can be cut anywhere:
the parts' functions are made side by side, a prefix over them gives each part
the tokens at its start, and all parts are then decided side by side. Steps are
over the requests of a part, arrays over the parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np

#: Requests of a part, and rows that a task holds at once.
PART = 64
ROWS = 1 << 18

NONE = np.iinfo(np.int64).max

#: (from, tokens left there, the same throughout), sorted; a piece ends where the next begins, the last at the capacity.
Pieces = list[tuple[int, int, bool]]


@dataclass(frozen=True)
class Rules:
    unit: int
    step: int
    cap: int
    idle: int | None  # microseconds

    @property
    def refill(self) -> int:
        """Microseconds after which any bucket is full."""
        return -(-self.cap // self.step)

    def resets(self, gap: np.ndarray) -> np.ndarray:
        """Whether the bucket is full after so many microseconds whatever it held."""
        return (gap >= self.refill) | (gap > self.idle) if self.idle is not None else gap >= self.refill


def rules(rpm: float, burst: float, idle_seconds: float | None) -> Rules:
    """``rpm`` and ``burst`` are taken as fractions with denominators of up to a million."""
    rate = Fraction(rpm).limit_denominator(1_000_000) / 60_000_000
    cap = Fraction(burst).limit_denominator(1_000_000)
    if rate <= 0 or cap <= 0:
        raise ValueError("rpm and burst must be positive")
    unit = rate.denominator * cap.denominator
    if cap * unit >= 1 << 61:
        raise ValueError("rpm and burst need more than 61 bits")
    return Rules(unit, int(rate * unit), int(cap * unit), None if idle_seconds is None else round(idle_seconds * 1_000_000))


def refills(gap: np.ndarray, r: Rules) -> np.ndarray:
    """Units that come in so many microseconds, the capacity at most."""
    return np.clip(gap, 0, r.refill) * r.step


def functions(add: np.ndarray, there: np.ndarray, r: Rules) -> list[Pieces]:
    """Of each row (a part) the function from the tokens at hand at its first request to those left after
    its last. add: units that come before each request (the first column isn't used); there: which requests a part has."""
    n, length = add.shape
    lo, val, flat = np.zeros((n, 1), np.int64), np.zeros((n, 1), np.int64), np.zeros((n, 1), bool)
    for j in range(length):
        on = there[:, j:j + 1] & (lo != NONE)
        if j:
            val = np.where(on, val + add[:, j:j + 1], val)
        end = np.concatenate([lo[:, 1:], np.full((n, 1), NONE)], axis=1)
        end = np.where(end == NONE, r.cap + 1, end)
        full = on & (val >= r.cap)
        val, flat = np.where(full, r.cap, val), flat | full
        # within a piece that grows, from some point on the bucket fills up
        fills = on & ~flat & (val + (end - lo) - 1 > r.cap)
        lo_full = np.where(fills, lo + (r.cap - val), NONE)
        end = np.where(fills, lo_full, end)
        # and from some point on the request passes
        passes = on & (val >= r.unit)
        splits = on & ~passes & ~flat & (val + (end - lo) - 1 >= r.unit)
        lo_pass = np.where(splits, lo + (r.unit - val), NONE)
        after = r.cap - r.unit if r.cap >= r.unit else r.cap
        lo = np.concatenate([lo, lo_pass, lo_full], axis=1)
        val = np.concatenate([np.where(passes, val - r.unit, val), np.zeros_like(val), np.full_like(val, after)], axis=1)
        flat = np.concatenate([flat, np.zeros_like(flat), np.ones_like(flat)], axis=1)
        order = np.argsort(lo, axis=1, kind="stable")
        lo, val, flat = (np.take_along_axis(x, order, axis=1) for x in (lo, val, flat))
        # pieces that go on as the one before are one
        line = np.where(flat | (lo == NONE), val, val - lo)
        same = (line[:, 1:] == line[:, :-1]) & (flat[:, 1:] == flat[:, :-1])
        lo[:, 1:][same] = NONE
        order = np.argsort(lo, axis=1, kind="stable")[:, :max(1, int((lo != NONE).sum(axis=1).max()))]
        lo, val, flat = (np.take_along_axis(x, order, axis=1) for x in (lo, val, flat))
    return [[(a, v, f) for a, v, f in zip(*p) if a != NONE] for p in zip(lo.tolist(), val.tolist(), flat.tolist())]


def value(f: Pieces, x: int) -> int:
    lo, v, flat = next(p for p in reversed(f) if p[0] <= x)
    return v if flat else v + x - lo


def then(f: Pieces, add: int, g: Pieces, cap: int) -> Pieces:
    """g after f and a refill."""
    out: Pieces = []

    def put(lo: int, v: int, flat: bool) -> None:
        if out and out[-1][2] == flat and out[-1][1] == (v if flat else v - lo + out[-1][0]):
            return
        out.append((lo, v, flat))

    for k, (lo, v, flat) in enumerate(f):
        end = f[k + 1][0] if k + 1 < len(f) else cap + 1
        v += add
        if flat or v >= cap:
            put(lo, value(g, min(v, cap)), True)
            continue
        top = v + end - lo - 1  # the last value of the piece
        for i, (a, w, still) in enumerate(g):
            b = g[i + 1][0] if i + 1 < len(g) else cap + 1
            if b > v and a <= min(top, cap):
                put(lo + max(a - v, 0), w if still else w + max(v - a, 0), still)
        if top > cap:
            put(lo + cap - v, value(g, cap), True)
    return out


def parts(client: np.ndarray, us: np.ndarray, before: tuple[int, int] | None, r: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by client and time: where parts begin, whether each begins with a full bucket, and the
    units that come before each row. before: (client, time) of the row in front, if there is one."""
    n = len(client)
    gap = np.diff(us, prepend=us[0])
    new = np.diff(client, prepend=client[0]) != 0
    if before is None or before[0] != client[0]:
        new[0] = True
    else:
        gap[0] = us[0] - before[1]
    resets = new | r.resets(gap)
    run = np.cumsum(resets)  # rows of one run since its reset
    at = np.arange(n)
    since = at - np.maximum.accumulate(np.where(resets, at, 0))
    starts = np.flatnonzero(resets | (since % PART == 0) | (at == 0) | (np.diff(run, prepend=run[0]) != 0))
    return starts, resets[starts], refills(np.where(new, 0, gap), r)


def table(starts: np.ndarray, add: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of each part, which of them it has, and the units before each."""
    size = np.diff(starts, append=len(add))
    there = np.arange(int(size.max()))[None, :] < size[:, None]
    rows = np.where(there, starts[:, None] + np.arange(there.shape[1])[None, :], 0)
    return rows, there, np.where(there, add[rows], 0)


def through(client: np.ndarray, us: np.ndarray, before: tuple[int, int] | None, f: Pieces | None, r: Rules) -> Pieces:
    """The function from the state at a task's first row to that after these rows. f: up to the row in front; None
    if there is none. Only the rows from the last reset on are looked at."""
    starts, full, add = parts(client, us, before, r)
    known = np.flatnonzero(full)
    if before is None and f is None:
        known = known[known > 0]  # what was before a task's first row isn't known here
    if len(known):
        cut = int(starts[known[-1]])
        starts, add = starts[known[-1]:] - cut, add[cut:]
        f = None
    elif f is None:
        add = add.copy()
        add[0] = 0
    _, there, a = table(starts, add)
    made = functions(a, there, r)
    for k, g in enumerate(made):
        if f is None:
            f = [(0, value(g, r.cap), True)] if len(known) else g
        else:
            f = then(f, int(add[starts[k]]), g, r.cap)
    return f


def decide(client: np.ndarray, us: np.ndarray, before: tuple[int, int] | None, x: int, r: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Whether each request passes and the tokens left after it; x: those left after the row in front."""
    starts, full, add = parts(client, us, before, r)
    rows, there, a = table(starts, add)
    at_hand = np.where(full, r.cap, -1)
    later = np.flatnonzero(~full)
    if len(later):
        # parts that others follow are needed as functions
        goes_on = np.unique(later - 1)
        goes_on = goes_on[goes_on >= 0]
        made = dict(zip(goes_on.tolist(), functions(a[goes_on], there[goes_on], r))) if len(goes_on) else {}
        for k in later.tolist():
            left = x if k == 0 else value(made[k - 1], int(at_hand[k - 1]))
            at_hand[k] = min(r.cap, left + int(add[starts[k]]))
    state, passed, left = at_hand.astype(np.int64), np.zeros(len(us), bool), np.zeros(len(us), np.int64)
    for j in range(rows.shape[1]):
        on = there[:, j]
        if j:
            state = np.where(on, np.minimum(r.cap, state + a[:, j]), state)
        ok = on & (state >= r.unit)
        state = np.where(ok, state - r.unit, state)
        passed[rows[on, j]], left[rows[on, j]] = ok[on], state[on]
    return passed, left


def blocks(batches: Iterator, columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of Arrow batches, about ROWS rows at a time."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append([b.column(c).to_numpy(zero_copy_only=False) for c in columns])
            n += b.num_rows
        if n >= ROWS:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]

"""Generators of packed time-ordered ids, over any clock that is a function without arguments."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from ..functions.scalars import MAX_SEQ, SEQ_BITS, WORKER_BITS


class ClockExhausted(Exception):
    """A scripted clock has no reading left."""


class ClockBackwards(RuntimeError):
    """The clock went back further than the policy allows."""


def scripted(steps: Iterable[int]) -> Callable[[], int]:
    """A clock that gives each step once."""
    left = iter(steps)

    def read() -> int:
        try:
            return next(left)
        except StopIteration:
            raise ClockExhausted from None

    return read


def packed(ts: int, worker: int, seq: int) -> int:
    return ts << (WORKER_BITS + SEQ_BITS) | worker << SEQ_BITS | seq


class _Issuer:
    def __init__(self, worker: int, clock: Callable[[], int]):
        self.worker, self.clock = worker, clock
        self.last, self.seq = -1, 0

    def next_id(self) -> int:
        raise NotImplementedError

    def issued(self, n: int) -> list[int]:
        """Up to n ids; a refusal or the end of the clock ends the list."""
        out = []
        try:
            while len(out) < n:
                out.append(self.next_id())
        except (ClockBackwards, ClockExhausted):
            pass
        return out


class NaiveGenerator(_Issuer):
    """Believes the clock and lets the sequence wrap, so it repeats ids."""

    def next_id(self) -> int:
        ts = self.clock()
        self.seq = self.seq + 1 & MAX_SEQ if ts == self.last else 0
        self.last = ts
        return packed(ts, self.worker, self.seq)


class Generator(_Issuer):
    """Strictly rising ids. A clock that goes back is refused (error), waited for within a bound (wait), or passed over by issuing at the last time (hold); a used-up sequence waits for the next millisecond."""

    def __init__(self, worker: int, clock: Callable[[], int], policy: str = "error", wait_max_ms: int = 500):
        super().__init__(worker, clock)
        if policy not in ("error", "wait", "hold"):
            raise ValueError(policy)
        self.policy, self.wait_max_ms = policy, wait_max_ms

    def next_id(self) -> int:
        ts = self.clock()
        behind = self.last - ts
        if behind > 0:
            if self.policy == "error" or self.policy == "wait" and behind > self.wait_max_ms:
                raise ClockBackwards(behind)
            if self.policy == "hold":
                ts = self.last
            while ts < self.last:
                ts = self.clock()
        if ts == self.last and self.seq == MAX_SEQ:
            while ts <= self.last:
                ts = self.clock()
        self.seq = self.seq + 1 if ts == self.last else 0
        self.last = ts
        return packed(ts, self.worker, self.seq)

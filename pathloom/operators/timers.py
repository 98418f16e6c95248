"""The inactivity timer that splits a key's activity into sessions, for batch and stream alike."""

from __future__ import annotations

import numpy as np

_NEVER = np.iinfo(np.int64).min


class Timer:
    """The open session of a key, and a timer that runs out ``gap`` after its last event.

    An event up to the timer extends the session and sets the timer anew; a later one, or an event of another key, finds it
    expired: the session is emitted and the next one opened. Events come in order; pieces of a session that were put
    together before (start, last, n) count as events that last (those of several keys at once must be disjoint).
    """

    def __init__(self, gap: int, start: int = 0, last: int = _NEVER, n: int = 0):
        self.gap, self.start, self.last, self.n = gap, start, last, n

    def advance(self, start: np.ndarray, last: np.ndarray | None = None, n: np.ndarray | None = None, other: np.ndarray | None = None):
        """Takes in events in order of ``start``, ``other`` telling which are of another key than the one before. Returns of each
        session that ends: start, last, n, the position of its first event (-1: in an earlier call) and of the event that ended it."""
        if not len(start):
            none = np.empty(0, np.int64)
            return none, none, none, none, none
        reach = start if last is None else last if other is not None else np.maximum.accumulate(last)
        set_by = np.r_[self.last, reach[:-1]]
        if last is not None:
            set_by = np.maximum(set_by, self.last)
        expired = (start - self.gap > set_by) | (set_by == _NEVER)
        if other is not None:
            expired |= other
        at = np.flatnonzero(expired)
        many = np.ones(len(start), np.int64) if n is None else n
        edge = np.r_[0, np.cumsum(many)]
        own = np.r_[-1, at]
        begin = np.r_[self.start, start[at]]
        until = np.r_[at, len(start)] - 1
        end = np.where(until >= 0, np.maximum(reach[until], self.last if last is not None else _NEVER), self.last)
        count = np.diff(np.r_[-self.n, edge[at], edge[-1]])
        some = 0 if self.n else 1  # nothing was open
        self.start, self.last, self.n = int(begin[-1]), int(end[-1]), int(count[-1])
        return begin[some:-1], end[some:-1], count[some:-1], own[some:-1], at[some:] if some else at

    def expire(self, now: int | None = None) -> tuple[int, int, int] | None:
        """The open session if its timer has run out at ``now`` (None: the input has ended), else None."""
        if not self.n or (now is not None and now <= self.last + self.gap):
            return None
        out = self.start, self.last, self.n
        self.start, self.last, self.n = 0, _NEVER, 0
        return out

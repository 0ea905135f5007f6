"""Shared-folder tables, naming and evaluation helpers used by the corpus operators, and choices among spans."""

from bisect import bisect_left

from ..functions.shared import fresh, once, shared_dir, shared_path, spread, staged

__all__ = ["Apart", "Overlaps", "fresh", "once", "shared_dir", "shared_path", "spread", "staged"]


class Apart:
    """Spans that do not overlap, kept in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, a: int, b: int) -> bool:
        """Takes the span unless it overlaps one that is there."""
        i = bisect_left(self.starts, b)
        if i and self.ends[i - 1] > a:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


class Overlaps:
    """Whether a span overlaps any of the given ones, which may overlap each other."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.reach = [], [0]
        for a, b in sorted(spans):
            self.starts.append(a)
            self.reach.append(max(b, self.reach[-1]))

    def __call__(self, a: int, b: int) -> bool:
        return self.reach[bisect_left(self.starts, b)] > a

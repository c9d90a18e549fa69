"""Id runs of the cuts of texts: each different cut is encoded once per worker and then looked up.

The cuts of a batch are looked up, new ones are encoded together, and the ids of all are gathered by array operations. A worker's memo is bounded: when it is full, the cuts used least
recently are forgotten, which costs time and never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np

#: Cuts that a worker remembers.
MEMO_ENTRIES = 350_000

Runs = tuple[np.ndarray, np.ndarray]


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``values[starts[k]:starts[k] + sizes[k]]`` end to end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


class CutMemo:
    """Runs of 32-bit ids (or other numbers) by cut. ``make`` encodes a list of new cuts: all ids end to end, and the run
    lengths."""

    def __init__(self, make: Callable[[list[str]], Runs], most: int = MEMO_ENTRIES, dtype: type = np.int32) -> None:
        self.make, self.most, self.batch, self.dtype = make, most, 0, dtype
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.sizes, self.used = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def places(self, cuts: list[str]) -> np.ndarray:
        """The entry of each cut."""
        self.batch += 1
        if len(self.index) > self.most:
            self._forget()
        at = np.fromiter(map(self.index.get, cuts, repeat(-1)), np.int64, len(cuts))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = list(dict.fromkeys(map(cuts.__getitem__, missing)))
            self._add(new, *self.make(new))
            at[missing] = [self.index[cuts[i]] for i in missing]
        self.used[at] = self.batch
        return at

    def _add(self, new: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.starts)
        self.index.update(zip(new, range(first, first + len(new)), strict=True))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes.astype(np.int32))
        self.ids = np.append(self.ids, ids.astype(self.dtype))
        self.used = np.append(self.used, np.zeros(len(new), np.int32))

    def _forget(self) -> None:
        kept = np.flatnonzero(self.used > np.median(self.used))[-self.most // 2 :]
        place = np.full(len(self.used), -1, np.int64)
        place[kept] = np.arange(len(kept))
        self.index = {cut: k for cut, k in zip(self.index, place[np.fromiter(self.index.values(), np.int64, len(self.index))].tolist(), strict=True) if k >= 0}
        self.ids = gathered(self.ids, self.starts[kept], self.sizes[kept])
        self.sizes, self.used = self.sizes[kept], self.used[kept]
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes

    def encode(self, cuts: list[list[str]]) -> Runs:
        """Of the cuts of some texts: all ids end to end, and the offsets of the texts."""
        return self._of_places(self.places(list(chain.from_iterable(cuts))), np.array([len(own) for own in cuts], np.int64))

    def _of_places(self, at: np.ndarray, numbers: np.ndarray) -> Runs:
        sizes = self.sizes[at]
        ends = np.append(0, np.cumsum(sizes))
        bounds = np.append(0, np.cumsum(numbers)).astype(np.int64)
        return gathered(self.ids, self.starts[at], sizes), ends[bounds]


def joined(parts: list[Runs]) -> Runs:
    """Several (ids, offsets) end to end."""
    offsets = [np.zeros(1, np.int64)]
    for _, own in parts:
        offsets.append(own[1:] + offsets[-1][-1])
    return np.concatenate([p for p, _ in parts] or [np.zeros(0, np.int32)]), np.concatenate(offsets)

"""Id runs of texts whose cuts are parted by one space each, looked up by the bytes of the cuts.

The bytes of a batch are taken as arrays: cuts and the symbols at their ends are found, each of up to 31 bytes is held in
four numbers, and all are looked up at once in a hash table of numbers. No cut that is known becomes a Python string, so a
worker remembers many. Entries are compared in full; a cut that is longer, or whose hash belongs to another, goes to a memo
of strings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from vademecum.llm.cuts import CutMemo, Runs, gathered

#: Cuts that a worker remembers, and strings.
MEMO_ENTRIES, MEMO_STRINGS = 1_200_000, 20_000
#: Words of eight bytes in a key, and bytes of a cut that it holds beside its size.
WORDS, MOST_BYTES = 4, 31
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: ASCII symbols, and bytes of Latin letters up to U+024F; ``_odd_places`` excepts the other characters that begin alike.
SYMBOLS, LETTERS = np.zeros(256, bool), np.zeros(256, bool)
for _first, _last in ("!/", ":@", "[`", "{~"):
    SYMBOLS[ord(_first) : ord(_last) + 1] = True
for _first, _last in ((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xBF), (0xC3, 0xC9)):
    LETTERS[_first : _last + 1] = True
#: Symbols at the end of a word that are a cut of their own.
TAIL = 4


def _spread(words: np.ndarray) -> np.ndarray:
    """Carries high bits to low ones, which products would leave alone."""
    return words ^ (words >> np.uint64(29))


def _odd_places(raw: np.ndarray) -> np.ndarray:
    """The bytes that don't belong to a Latin letter. The capital I with a dot doesn't count as one: its lower case ends
    with a mark, which joins symbols."""
    odd = np.take(~LETTERS, raw)
    for lead, is_odd in ((0xC3, lambda x: (x == 0x97) | (x == 0xB7)), (0xC4, lambda x: x == 0xB0), (0xC9, lambda x: x >= 0x90)):
        at = np.flatnonzero(raw == lead)
        odd[at[is_odd(raw[at + 1])]] = True
    return np.flatnonzero(odd)


def tails(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cuts made of Latin letters, after a line break or not, and one to four ASCII symbols; and where the symbols begin."""
    rows = np.flatnonzero(SYMBOLS[raw[ends - 1]])
    if not len(rows):
        return rows, rows
    stem = ends[rows] - 1
    for _ in range(TAIL - 1):
        stem -= SYMBOLS[raw[stem - 1]]
    first = starts[rows] + (raw[starts[rows]] == 10)
    odd = np.append(-1, _odd_places(raw))
    fine = (stem > first) & (odd[np.searchsorted(odd, stem) - 1] == first - 1)  # white space before letters alone
    return rows[fine], stem[fine]


class SpacedMemo:
    """Runs of ids by cut. ``make`` encodes a list of new cuts: all ids end to end, and the run lengths. The symbols at the
    end of a word are a cut of their own; ``mark`` goes before them where they are given to ``make``. When the memo is full,
    the cuts used least recently are forgotten."""

    def __init__(self, make: Callable[[list[str]], Runs], mark: str = "", most: int = MEMO_ENTRIES) -> None:
        self.make, self.mark, self.most, self.batch = make, mark, most, 0
        self.strings = CutMemo(lambda cuts: self.make(cuts), MEMO_STRINGS)
        self.entries, self.n_ids, self.ids = 0, 0, np.zeros(1 << 12, np.int32)
        self.keys = np.zeros((1 << 10, WORDS), np.uint64)
        self.hashes, self.starts = np.zeros(1 << 10, np.uint64), np.zeros(1 << 10, np.int64)
        self.sizes, self.used = np.zeros(1 << 10, np.int32), np.zeros(1 << 10, np.int32)
        self._table(1 << 12)

    def encode(self, texts: list[str | None]) -> Runs:
        """All ids of the texts end to end, and the offsets of the texts. Null or empty: none."""
        self.batch += 1
        if self.entries > self.most:
            self._forget()
        text = " ".join(filter(None, texts)).encode()
        bounds = np.append(0, np.cumsum([t.count(" ") + 1 if t else 0 for t in texts], dtype=np.int64))
        if not bounds[-1]:
            return np.zeros(0, np.int32), bounds
        raw = np.frombuffer(text + bytes(8 * WORDS), np.uint8)
        spaces = np.flatnonzero(raw == 32)
        starts, ends = np.append(0, spaces + 1), np.append(spaces, len(text))
        split, stems = tails(raw, starts, ends)
        tail = np.zeros(len(starts), bool)
        if len(split):
            starts, ends, tail = np.insert(starts, split + 1, stems), np.insert(ends, split, stems), np.insert(tail, split + 1, True)
            bounds += np.searchsorted(split, bounds)
        begin, sizes = self._runs(text, raw, starts, ends, tail)
        return gathered(self.ids, begin, sizes), np.append(0, np.cumsum(sizes, dtype=np.int64))[bounds]

    def _runs(self, text: bytes, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each cut begin in ``ids``, and how many it has."""

        def strings(rows: np.ndarray) -> list[str]:
            places = zip(starts[rows].tolist(), ends[rows].tolist(), tail[rows].tolist(), strict=True)
            return [self.mark + text[a:b].decode() if own else text[a:b].decode() for a, b, own in places]

        keys, hashes = self._keys(raw, starts, ends - starts, tail)
        at = self._found(hashes)
        short = ends - starts <= MOST_BYTES
        missing = np.flatnonzero((at < 0) & short)
        if len(missing):
            _, first, place = np.unique(hashes[missing], return_index=True, return_inverse=True)
            rows = missing[first]
            at[missing] = self.entries + place
            self._add(keys[rows], hashes[rows], *self.make(strings(rows)))
        unlike = (self.keys.take(at, axis=0, mode="wrap") != keys).view(np.uint32).ravel()  # the four comparisons as one number
        self.used[at] = self.batch
        begin, sizes = self.starts[at], self.sizes[at]
        rows = np.flatnonzero((unlike != 0) | ~short)
        if len(rows):  # their ids lie behind those of the entries, for this batch
            place = self.strings.places(strings(rows))
            sizes[rows] = self.strings.sizes[place]
            ids = gathered(self.strings.ids, self.strings.starts[place], sizes[rows])
            self._reserve(0, len(ids))
            self.ids[self.n_ids : self.n_ids + len(ids)] = ids
            begin[rows] = self.n_ids + np.cumsum(sizes[rows]) - sizes[rows]
        return begin, sizes

    @staticmethod
    def _keys(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of each cut as four numbers, the last with its size and whether it is a tail; and their hash."""
        eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        keys = np.zeros((len(starts), WORDS), np.uint64)
        keys[:, 0] = words = eight[starts] & MASKS[np.minimum(sizes, 8)]
        hashes = _spread(words) * FACTORS[0]
        rows = np.flatnonzero(sizes > 8)
        for k in range(1, WORDS):
            rows = rows[sizes[rows] > 8 * k]
            words = eight[starts[rows] + 8 * k] & MASKS[np.minimum(sizes[rows] - 8 * k, 8)]
            keys[rows, k] = words
            hashes[rows] += _spread(words) * FACTORS[k]
        kind = (np.minimum(sizes, 127) | tail.astype(np.int64) << 7).astype(np.uint64)
        keys[:, -1] |= kind << np.uint64(56)
        hashes = (_spread(hashes) + kind) * FACTORS[2]
        return keys, _spread(hashes) * FACTORS[3]

    def _table(self, slots: int) -> None:
        """A new table of this many slots, a power of two, with all entries. An entry is in the first slot from its own on
        that was free."""
        self.slots, self.shift = np.full(slots, -1, np.int32), np.uint64(65 - slots.bit_length())
        self._place(np.arange(self.entries, dtype=np.int32))

    def _place(self, new: np.ndarray) -> None:
        slot = (self.hashes[new] >> self.shift).astype(np.int64)
        while len(new):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]  # of several for one slot the last gets it
            left = self.slots[slot] != new
            new, slot = new[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _found(self, hashes: np.ndarray) -> np.ndarray:
        """The entry with each hash, or -1."""
        slot = (hashes >> self.shift).astype(np.int64)
        at = self.slots[slot].astype(np.int64)
        rows = np.flatnonzero((self.hashes[at] != hashes) & (at >= 0))
        while len(rows):
            slot[rows] = (slot[rows] + 1) & (len(self.slots) - 1)
            at[rows] = self.slots[slot[rows]]
            rows = rows[(self.hashes[at[rows]] != hashes[rows]) & (at[rows] >= 0)]
        return at

    def _reserve(self, entries: int, ids: int) -> None:
        """Makes room for more entries and ids."""

        def longer(values: np.ndarray, size: int) -> np.ndarray:
            return values if size <= len(values) else np.concatenate([values, np.zeros((max(size, len(values) * 5 // 4) - len(values), *values.shape[1:]), values.dtype)])

        size = self.entries + entries
        self.keys, self.hashes, self.starts, self.sizes, self.used = (longer(x, size) for x in (self.keys, self.hashes, self.starts, self.sizes, self.used))
        self.ids = longer(self.ids, self.n_ids + ids)

    def _add(self, keys: np.ndarray, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self._reserve(len(hashes), len(ids))
        new = slice(self.entries, self.entries + len(hashes))
        self.keys[new], self.hashes[new], self.sizes[new], self.used[new] = keys, hashes, sizes, self.batch
        self.starts[new] = self.n_ids + np.cumsum(sizes) - sizes
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.entries, self.n_ids = new.stop, self.n_ids + len(ids)
        if 2 * self.entries > len(self.slots):
            self._table(1 << (2 * self.entries).bit_length())
        else:
            self._place(np.arange(new.start, new.stop, dtype=np.int32))

    def _forget(self) -> None:
        used = self.used[: self.entries]
        kept = np.flatnonzero(used > np.median(used))[-self.most // 2 :]
        starts, sizes = self.starts[kept], self.sizes[kept]
        ids = gathered(self.ids, starts, sizes)
        self.entries, self.n_ids = len(kept), len(ids)
        self.ids[: self.n_ids] = ids
        for values in (self.keys, self.hashes, self.sizes, self.used):
            values[: len(kept)] = values[kept]
        self.starts[: len(kept)] = np.cumsum(sizes, dtype=np.int64) - sizes
        self._table(len(self.slots))

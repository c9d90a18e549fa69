"""Words, word hashes and small batch helpers shared by the text operators.

A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed and
carriage return; ``bytes.split()`` cuts UTF-8 at exactly those six bytes.
"""

from __future__ import annotations

import numpy as np
import xxhash

SPACES = " \t\n\x0b\x0c\r"
#: Entries a worker keeps in a memo before starting it anew; bounds memory, never changes results.
MEMO_ENTRIES = 150_000


class WordHashes(dict):
    """64-bit hash of each word, remembered per worker."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value


def hash_words(texts: list[str | None], memo: WordHashes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch end to end, and the offsets (length ``len(texts) + 1``) of each text."""
    if len(memo) > MEMO_ENTRIES:
        memo.clear()
    parts, offsets = [], np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = (raw.lower() if lower else raw).split()
        offsets[i + 1] = offsets[i] + len(words)
        if words:
            parts.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: xor-shifts and odd multiplications."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hash of every run of ``width`` words; windows of the whole array, cut by the caller."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    n = len(words) - width + 1
    value = np.zeros(n, np.uint64)
    for k in range(width):
        value = mix64(value + words[k : k + n] + np.uint64(k + 1)) if k == width - 1 else (value + words[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
    return value

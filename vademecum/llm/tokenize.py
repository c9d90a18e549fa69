"""Token ids by the tokenizers library.

Byte-level and word-end BPE tokenizers part a text at white space before they merge anything, so the ids of a text are
those of its cuts one after the other: words, with the white space before them where the tokenizer keeps it. Each
different cut is encoded by the library once per worker and then looked up. The symbols at the end of a word are a cut of
their own, and where the tokenizer lower-cases, so are ASCII letters beforehand. New cuts are encoded many at a time, as one
text in which the tokenizer's own special token parts them; its id parts their ids again.

Texts that hold the string of an added token (these become its id, as in the library) and texts with uneven white
space, and all texts of a tokenizer that doesn't part like that, go to the library whole. Null texts count as empty.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np

from vademecum.llm.cuts import Runs, joined
from vademecum.llm.spaced import SpacedMemo

#: Cuts that are encoded as one text, and characters up to which they are.
JOINED, JOINED_CHARS = 200, 20_000
#: The characters at which str.split() parts but regular expressions of the tokenizers don't.
ONLY_SPLIT = re.compile("[\x1c-\x1f]")
#: White space other than a space and a line break.
OTHER_WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
#: The marks that make one character with some lower-case ASCII letter, but not with its upper case (as in U+01F0).
LOWER_MARKS = ["\u0308", "\u030a", "\u030c", "\u0331", "\u0344"]
UNEVEN = ["  ", " \n", "\n ", "\n\n"]


class TokenIds:
    """Encodes batches of texts with one tokenizer file. One instance per worker and file."""

    _open: dict[str, TokenIds] = {}

    @classmethod
    def open(cls, path: str) -> TokenIds:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        added = config.get("added_tokens") or []
        self.added = [t["content"] for t in added]
        plain = [t for t in added if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])]
        self.separator, self.separator_id = (plain[0]["content"], plain[0]["id"]) if plain else (None, -1)
        normalizer, splitter = json.dumps(config.get("normalizer")), json.dumps(config.get("pre_tokenizer"))
        byte_level = '"ByteLevel"' in splitter and '"add_prefix_space": true' not in splitter
        self.words, self.spaced, self.front = False, False, 0
        if self.separator and byte_level and "Replace" in normalizer and "\\\\s+" in normalizer and config["model"].get("end_of_word_suffix"):
            self.words = True
            self.ends = self._marked(lambda t: t.endswith(config["model"]["end_of_word_suffix"]))
            self.lowers = '"Lowercase"' in normalizer
            self.memo = SpacedMemo(self._of_letters)
        elif self.separator and byte_level and '"Split"' not in splitter and '"use_regex": false' not in splitter and config.get("normalizer") is None:
            self.spaced = True
            self.front = len(self._whole(["\n"])[0])
            self.begins = self._marked(lambda t: t.startswith("Ġ"))
            self.memo = SpacedMemo(self._after_white, mark=" ")

    def _marked(self, is_marked: Callable[[str], bool]) -> np.ndarray:
        """Of every id whether its token is marked."""
        vocabulary = self.tokenizer.get_vocab()
        out = np.zeros(max(vocabulary.values()) + 1, bool)
        out[[i for t, i in vocabulary.items() if is_marked(t)]] = True
        return out

    def _spaced_words(self, text: str) -> str | None:
        """The cuts of a tokenizer that drops white space, with one space between them; null where they aren't known.
        ASCII letters are lower-cased beforehand where the tokenizer does so, but not where that could join a mark."""
        if self.lowers and not any(map(text.__contains__, LOWER_MARKS)):
            text = text.lower() if text.isascii() else text.encode().lower().decode()
            if any(map(text.__contains__, self.added)):
                return None
        if self._even(text):
            return text.replace("\n", " ")
        return None if ONLY_SPLIT.search(text) else " ".join(text.split())

    @staticmethod
    def _even(text: str) -> bool:
        """Whether a text's words are parted by one space or line break each."""
        if any(map(text.__contains__, OTHER_WHITE)):
            return False
        return not text or not (text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, UNEVEN)))

    def _whole(self, texts: list[str]) -> Runs:
        found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([*found, np.zeros(0, np.int32)]), np.append(0, np.cumsum([len(x) for x in found])).astype(np.int64)

    def _encoded(self, cuts: list[str]) -> Runs:
        """The ids of some cuts, none of which holds an added token's string, and how many each has."""
        groups, start, chars = [], 0, 0
        for k, cut in enumerate(cuts):
            chars += len(cut)
            if k + 1 - start == JOINED or chars > JOINED_CHARS:
                groups.append(self.separator.join(cuts[start : k + 1]) + self.separator)
                start, chars = k + 1, 0
        if start < len(cuts):
            groups.append(self.separator.join(cuts[start:]) + self.separator)
        ids = np.concatenate([self._whole([g])[0] for g in groups] or [np.zeros(0, np.int32)])
        ends = np.flatnonzero(ids == self.separator_id)
        return ids[ids != self.separator_id], np.diff(ends, prepend=-1) - 1

    def _of_letters(self, cuts: list[str]) -> Runs:
        """The same where a cut of letters alone is one word of the tokenizer, with one token that ends it: such cuts need
        no separators. Every cut has such a token at least, so as many ends as cuts are one for each."""
        letters = np.array([c.isalpha() for c in cuts], bool)
        words = [cuts[k] for k in np.flatnonzero(letters).tolist()]
        found, numbers = [], []
        for start in range(0, len(words), JOINED):
            part = words[start : start + JOINED]
            ids = self._whole([" ".join(part)])[0]
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(part) and ends[-1] == len(ids) - 1:
                sizes = np.diff(ends, prepend=-1)
            else:
                ids, sizes = self._encoded(part)
            found.append(ids), numbers.append(sizes)
        return self._both(letters, found, numbers, self._encoded([cuts[k] for k in np.flatnonzero(~letters).tolist()]))

    @staticmethod
    def _both(first: np.ndarray, found: list[np.ndarray], numbers: list[np.ndarray], others: Runs) -> Runs:
        """The runs of cuts in their order, from those of the ``first`` kind, in parts, and of the others."""
        sizes = np.zeros(len(first), np.int64)
        sizes[first], sizes[~first] = np.concatenate([*numbers, np.zeros(0, np.int64)]), others[1]
        ids = np.zeros(int(sizes.sum()), np.int32)
        own = np.repeat(first, sizes)
        ids[own], ids[~own] = np.concatenate([*found, np.zeros(0, np.int32)]), others[0]
        return ids, sizes

    def _after_white(self, cuts: list[str]) -> Runs:
        """The same for cuts with their white space: those that begin with a line break, words after a space, and tails
        of words, which follow without one. Of the words every one begins with a token for its space, the only one, so
        that a text of many needs no separators."""
        lines = np.array([c[0] in "\n " for c in cuts], bool)
        words = [cuts[k] for k in np.flatnonzero(~lines).tolist()]
        found, numbers = [], []
        for start in range(0, len(words), JOINED):
            part = words[start : start + JOINED]
            ids = self._whole([" " + " ".join(part)])[0]
            begin = np.flatnonzero(self.begins[ids])
            if len(begin) == len(part) and begin[0] == 0:
                sizes = np.diff(begin, append=len(ids))
            else:
                ids, sizes = self._encoded([" " + w for w in part])
            found.append(ids), numbers.append(sizes)
        return self._both(~lines, found, numbers, self._encoded([cuts[k].removeprefix(" ") for k in np.flatnonzero(lines).tolist()]))

    def encode(self, texts: list[str | None]) -> Runs:
        """All ids of the texts end to end, without special tokens, and the offsets of the texts."""
        known = [t or "" for t in texts]
        plain = [not any(map(t.__contains__, self.added)) for t in known]
        if self.spaced:
            odd = [k for k, t in enumerate(known) if not (plain[k] and self._even(t))]
            other = set(odd)
            # words, of which those that begin a line (the first too) have the line break before them
            lined = ["\n" + t.replace("\n", " \n") if t and k not in other else None for k, t in enumerate(known)]
            ids, offsets = self.memo.encode(lined)
        elif self.words:
            cuts = [self._spaced_words(t) if fine else None for fine, t in zip(plain, known, strict=True)]
            odd = [k for k, own in enumerate(cuts) if own is None]
            ids, offsets = self.memo.encode([own or None for own in cuts])
        else:
            return self._whole(known)
        if self.front:  # the line break in front of each text isn't its own
            begin = offsets[:-1][np.diff(offsets) > 0]
            mask = np.ones(len(ids), bool)
            mask[(begin[:, None] + np.arange(self.front)).ravel()] = False
            ids, offsets = ids[mask], np.append(0, np.cumsum(np.maximum(np.diff(offsets) - self.front, 0)))
        if not odd:
            return ids, offsets
        other, other_offsets = self._whole([known[k] for k in odd])
        place = {k: i for i, k in enumerate(odd)}
        parts = [(other[other_offsets[place[k]] : other_offsets[place[k] + 1]] if k in place else ids[offsets[k] : offsets[k + 1]]) for k in range(len(known))]
        return joined([(p, np.array([0, len(p)])) for p in parts])


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int | None) -> Runs:
    """The runs with ``end_id`` after each, if it is given."""
    if end_id is None:
        return ids, offsets
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))

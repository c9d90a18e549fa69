"""SentencePiece encoding and decoding for merge-type (BPE) models.

Encoding works by backtracking. An Aho-Corasick automaton over the model's pieces gives, for every position, the
longest piece that starts there. A piece may follow another only if the two are compatible: merging the characters
of their concatenation anew must give exactly these two pieces. If no piece fits at a position, the last one is taken
back and a shorter one is tried; a bit field remembers the positions from which no encoding was found. The sequence
whose neighbours are all compatible is the one that merging the whole text would give, so the ids equal the library's.

Characters outside the vocabulary become byte pieces (``<0x..>``) or, without these, the unknown id; no merge crosses
them, so they part the text. A piece holds the space mark only at its front, so texts are cut before each run of marks,
and each cut is encoded once per worker and then looked up. New cuts are backtracked side by side: every step moves all
of them by array operations; the few that need many steps are finished one by one.

Null texts count as empty; an empty text has no ids and decodes to the empty text. Extra columns are kept; the new
columns replace columns of the same name.
"""

from __future__ import annotations

import codecs
import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vademecum.llm.cuts import CutMemo, Runs
from vademecum.llm.shared import column_of, slices

MARK = "▁"
UNKNOWN_SURFACE = " ⁇ "
#: Pairs of pieces whose compatibility a worker remembers before it starts anew.
PAIRS = 1_000_000
#: New cuts that are backtracked side by side, and steps and cuts left at which the rest is finished one by one.
TOGETHER, STEPS, FEW = 20_000, 80, 40


def _one_mark_per_byte(error: UnicodeError):
    return "�", error.start + 1


codecs.register_error("one_mark_per_byte", _one_mark_per_byte)


class PieceModel:
    """The pieces of a model file, with encoder and decoder. One instance per worker and file."""

    _open: dict[str, PieceModel] = {}

    @classmethod
    def open(cls, path: str) -> PieceModel:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str) -> None:
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_file=path)
        n = reader.piece_size()
        self.unknown = reader.unk_id()
        self.pieces = [reader.id_to_piece(i) for i in range(n)]
        special = [reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i) for i in range(n)]
        byte = [reader.is_byte(i) for i in range(n)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if byte[i]}
        normal = {p: i for i, p in enumerate(self.pieces) if not special[i] and not byte[i]}
        self.ids = normal
        self.scores = {p: reader.get_score(i) for p, i in normal.items()}
        self._compatible: dict[int, bool] = {}
        # Only pieces that merging itself would build may be part of an encoding.
        reachable = {p: i for p, i in normal.items() if self.merged(p) == [i]}
        self.automaton = ahocorasick.Automaton()
        self.length = np.zeros(n + 1, np.int64)
        self.shorter = np.full(n + 1, -1, np.int64)
        for piece, i in reachable.items():
            self.automaton.add_word(piece, i)
            self.length[i] = len(piece)
            self.shorter[i] = self._prefix(piece, reachable)
        self.automaton.make_automaton()
        self.known = re.compile("[" + "".join(re.escape(p) for p in normal if len(p) == 1) + "]*")
        self.parting = next(chr(c) for c in chain(range(1, 32), range(0xE000, 0xF900)) if chr(c) not in normal)
        breaks = "".join(re.escape(c) for c in "\n\t\r" if c not in normal)
        self.cuts = re.compile(f"{MARK}*[^{MARK}{breaks}]+|{MARK}+" + (f"|[{breaks}]" if breaks else ""))
        crossing = any(MARK in p.lstrip(MARK) for p in normal)  # then a piece may cross the cuts
        if crossing:
            self.cuts = re.compile(r"(?s).+")
        self.splits = not crossing and not any("\n" in p or "\x00" in p for p in normal)
        self.memo = CutMemo(self._encoded)
        surface = [self._surface(i, special[i], byte[i]) for i in range(n)]
        self.surface = surface
        # pieces as they are, and as they are at the front of a text
        self.surfaces = pa.array([*surface, *(s[1:] if p.startswith(MARK) else s for s, p in zip(surface, self.pieces, strict=True))], pa.binary())
        #: Ids that need the decoder for single texts: parts of longer characters, and pieces without a surface.
        self.odd = np.array([not s or len(s) == 1 and s[0] > 127 for s in surface])

    @staticmethod
    def _prefix(piece: str, known: dict[str, int]) -> int:
        return next((known[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in known), -1)

    def _surface(self, i: int, special: bool, byte: bool) -> bytes:
        if byte:
            return bytes([int(self.pieces[i][3:5], 16)])
        if special:
            return UNKNOWN_SURFACE.encode() if i == self.unknown else b""
        return self.pieces[i].replace(MARK, " ").encode()

    def merged(self, text: str) -> list[int]:
        """Ids from merging the characters of a short text: best score first, leftmost of equal ones."""
        none = float("-inf")
        parts, score = list(text), self.scores.get
        found = [score(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while found:
            best = max(found)
            if best == none:
                break
            k = found.index(best)
            parts[k] += parts.pop(k + 1)
            del found[k]
            if k:
                found[k - 1] = score(parts[k - 1] + parts[k], none)
            if k < len(found):
                found[k] = score(parts[k] + parts[k + 1], none)
        return [self.ids.get(p, self.unknown) for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = left * len(self.pieces) + right
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) > PAIRS:
                self._compatible.clear()
            known = self._compatible[key] = self.merged(self.pieces[left] + self.pieces[right]) == [left, right]
        return known

    def _all_compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, place = np.unique(left * len(self.pieces) + right, return_inverse=True)
        wanted = keys.tolist()
        found = list(map(self._compatible.get, wanted))
        for k, known in enumerate(found):
            if known is None:
                found[k] = self.compatible(*divmod(wanted[k], len(self.pieces)))
        return np.array(found, bool)[place]

    def _backtracked(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        length, shorter = self.length, self.shorter
        longest = [-1] * (len(text) + 1)
        for end, i in self.automaton.iter(text):
            longest[end - int(length[i]) + 1] = i  # ends grow, so the last one is the longest
        ids: list[int] = []
        failed, at, take = 0, 0, longest[0]
        while at < len(text):
            while take >= 0:
                end = at + int(length[take])
                if not (failed and failed >> end & 1) and (not ids or self.compatible(ids[-1], take)):
                    break
                take = int(shorter[take])
            if take >= 0:
                ids.append(take)
                at = end
                take = longest[at]
            else:
                failed |= 1 << at
                take = ids.pop()
                at -= int(length[take])
                take = int(shorter[take])
        return ids

    def _side_by_side(self, cuts: list[str]) -> Runs:
        """Ids of some cuts, all of whose characters are pieces, end to end, and how many each has."""
        text = self.parting.join([*cuts, ""])
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        stop = np.cumsum(sizes + 1) - 1
        begin = stop - sizes
        longest = np.full(len(text) + 1, -1, np.int64)
        met = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        longest[met[:, 0] - self.length[met[:, 1]] + 1] = met[:, 1]  # ends grow, so the last one is the longest
        chosen, came = np.full(len(text) + 1, -1, np.int64), np.zeros(len(text) + 1, np.int64)
        on_path, failed = np.zeros(len(text) + 1, bool), np.zeros(len(text) + 1, bool)
        at, take, before = begin.copy(), longest[begin], np.full(len(cuts), -1, np.int64)
        active = np.flatnonzero(sizes)
        for _ in range(STEPS):
            if len(active) <= FEW:
                break
            a, t, p = at[active], take[active], before[active]
            some = t >= 0
            end = a + self.length[t]
            fits = some & ~failed[end]
            check = np.flatnonzero(fits & (p >= 0))
            fits[check] = self._all_compatible(p[check], t[check])
            rows, place, piece, end = active[fits], a[fits], t[fits], end[fits]
            chosen[place], on_path[place], came[end] = piece, True, place
            before[rows], at[rows], take[rows] = piece, end, longest[end]
            rest = some & ~fits
            take[active[rest]] = self.shorter[t[rest]]
            rows, place = active[~some], a[~some]
            failed[place] = True
            back = came[place]
            on_path[back] = False
            at[rows], take[rows] = back, self.shorter[chosen[back]]
            before[rows] = np.where(back > begin[rows], chosen[came[back]], -1)
            active = active[at[active] < stop[active]]
        for k in active.tolist():
            on_path[begin[k] : stop[k]] = False
            place = int(begin[k])
            for i in self._backtracked(cuts[k]):
                chosen[place], on_path[place] = i, True
                place += int(self.length[i])
        counts = np.append(0, np.cumsum(on_path))
        return chosen[on_path], counts[stop] - counts[begin]

    def _parted(self, cut: str) -> list[int]:
        """Ids of a cut with characters that are no pieces."""
        out: list[int] = []
        start = 0
        for k, char in enumerate(cut):
            if char not in self.ids:
                if k > start:
                    out += self._backtracked(cut[start:k])
                raw = char.encode("utf-8", "surrogatepass")
                out += [self.byte_ids[b] for b in raw] if self.byte_ids else [self.unknown]
                start = k + 1
        if start < len(cut):
            out += self._backtracked(cut[start:])
        return out

    def _encoded(self, keys: list[str]) -> Runs:
        """Ids and their numbers of new cuts, by their keys (see ``_keys``)."""
        cuts = [k[1:] if k[:1] in ("\x00", "\n") else MARK + k for k in keys]
        plain = np.array([self.known.fullmatch(cut) is not None for cut in cuts])
        line = np.array(self._parted("\n") if self.splits else [], np.int64)
        after = np.array([key[:1] == "\n" for key in keys])
        rows = np.flatnonzero(plain)
        found = [self._side_by_side([cuts[k] for k in rows[i : i + TOGETHER].tolist()]) for i in range(0, len(rows), TOGETHER)]
        other = {k: self._parted(cuts[k]) for k in np.flatnonzero(~plain).tolist()}
        sizes = np.zeros(len(cuts), np.int64)
        sizes[rows] = np.concatenate([n for _, n in found] or [sizes[:0]])
        for k, own in other.items():
            sizes[k] = len(own)
        sizes += after * len(line)
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int64)
        begin = starts + after * len(line)
        out[(starts[after][:, None] + np.arange(len(line))).ravel()] = np.tile(line, int(after.sum()))
        inner = (sizes - after * len(line))[rows]
        out[np.repeat(begin[rows] - (np.cumsum(inner) - inner), inner) + np.arange(int(inner.sum()))] = np.concatenate([i for i, _ in found] or [out[:0]])
        for k, own in other.items():
            out[begin[k] : begin[k] + len(own)] = own
        return out, sizes

    def _keys(self, text: str) -> list[str]:
        """The cuts of a text: a word stands for itself with a mark in front, a word after a line break for the line
        break and the word without a mark, and a zero byte begins any other cut."""
        if not text:
            return []
        if self.splits and text[0] not in " \n" and MARK not in text and "\x00" not in text:
            lines = text.replace("\n", " \n")
            if "  " not in lines:
                return lines.split(" ")
        return ["\x00" + cut for cut in self.cuts.findall(MARK + text.replace(" ", MARK))]

    def encode_all(self, texts: list[str | None]) -> Runs:
        """All ids of the texts (null: none) end to end, and the offsets of the texts."""
        return self.memo.encode([self._keys(t or "") for t in texts])

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        """The text of ids: byte pieces are joined to characters, an undecodable byte becomes U+FFFD; the space
        that encoding put in front is taken off."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "one_mark_per_byte")
        first = next((i for i in ids if self.surface[i]), None)
        return text[1:] if first is not None and self.pieces[first].startswith(MARK) else text

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of id runs. Only texts with parts of characters are decoded one by one."""
        place = ids.astype(np.int64)
        begin = offsets[:-1][np.diff(offsets) > 0]
        place[begin] += len(self.pieces)
        # a text's own list of surfaces: chunks are not needed, since a batch's texts stay far below 2 GB
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), self.surfaces.take(pa.array(place)))
        odd = np.append(0, np.cumsum(self.odd[ids]))
        texts = pc.binary_join(lists, b"")
        slow = np.flatnonzero(np.diff(odd[offsets]))
        if not len(slow):
            return texts.cast(pa.string())
        values = texts.to_pylist()
        for k in slow.tolist():
            values[k] = self.decode(ids[offsets[k] : offsets[k + 1]].tolist()).encode()
        return pa.array(values, pa.binary()).cast(pa.string())


def _with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if f.name not in new]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + [*new.values()], [n for n, _ in kept] + [*new])


def _schema(df: DataFrame, added: str, drop: set[str]) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in drop]
    return ", ".join([*kept, added])


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the column ``ids`` (array<int>) with the ids of ``text``, without begin or end ids."""

    def run(batches):
        model = PieceModel.open(model_path)
        for batch in slices(batches):
            yield _with_columns(batch, {ids: _lists(*model.encode_all(column_of(batch, text)))})

    return df.mapInArrow(run, _schema(df, f"`{ids}` array<int>", {ids}))


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the column ``text`` with the text of ``ids`` (null: no ids)."""

    def run(batches):
        model = PieceModel.open(model_path)
        for batch in slices(batches):
            known = [x or () for x in column_of(batch, ids)]
            offsets = np.append(0, np.cumsum([len(x) for x in known])).astype(np.int64)
            flat = np.fromiter(chain.from_iterable(known), np.int64, int(offsets[-1]))
            yield _with_columns(batch, {text: model.decode_all(flat, offsets)})

    return df.mapInArrow(run, _schema(df, f"`{text}` string", {text}))


def encode_and_decode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` in one pass over the rows."""

    def run(batches):
        model = PieceModel.open(model_path)
        for batch in slices(batches):
            flat, offsets = model.encode_all(column_of(batch, text))
            yield _with_columns(batch, {ids: _lists(flat, offsets), decoded: model.decode_all(flat, offsets)})

    return df.mapInArrow(run, _schema(df, f"`{ids}` array<int>, `{decoded}` string", {ids, decoded}))

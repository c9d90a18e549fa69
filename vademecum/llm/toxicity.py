"""Toxic spans by a linear-chain conditional random field.

Two states, clean and toxic, over the words of a text. A word's features are hashed into SLOTS cells: the word without
marks at its ends, its beginnings of three to seven letters, its last letters, its form, and the words before and after
it. The field also weighs the state before and the first state; a word never sees its document's label, language or
source.

The labels say only whether a document is toxic, so the words of a bounded sample are labelled first: words of clean
documents are clean, and a word of a toxic document is toxic if it, or one of its beginnings, is found in so many more of
the labelled toxic documents than of the clean ones that chance is ruled out. The field is trained on these labelled
words and then decides alone: forward-backward marginals give each word its probability of being toxic, and a
document's score is a logistic function of their sum and of the number of words, fitted to labelled documents. Runs of
words over one half make the offending spans, as character offsets in the text.

A null or empty text has no words and the score of no toxic word. Rows without a doc_id are scored and never labelled.
Extra columns are kept as asked for in ``keep``; a kept column named as a new one (score, predicted, spans) is replaced
by the new one. Repeated rows score alike. Without labels of both kinds no document is predicted toxic.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vademecum.llm.cuts import CutMemo
from vademecum.llm.shared import column_of, fields, labelled_texts, sampled_labels, slices
from vademecum.llm.words import MEMO_ENTRIES

#: About how many labelled rows are used at most: for the labelling of words, and of each label to train the field and to
#: calibrate its scores. Texts of more than TRAINED_CHARS characters don't train the field.
LABELLED = 60_000
TRAINED, CALIBRATED, TRAINED_CHARS = 300, 2000, 20_000
#: A key needs LEAST toxic texts, and with both labels dealt at random its texts would be as often toxic with a
#: probability of CHANCE at most. Equal texts count once, so copies don't make evidence.
LEAST, CHANCE = 4, 1e-5
#: Clean documents that are added to a key's count, and the least log odds of a toxic key.
PRIOR, STRONG = 1.0, 1.5
THRESHOLD = 0.7
SLOTS = 1 << 16
BEGINNINGS = (3, 4, 5, 6, 7)
#: Feature cells of a word: its own, and for the word after and before it.
OWN, NEXT = 4 + len(BEGINNINGS), 2
#: Words that a worker remembers.
EMISSIONS = 150_000
_edges = ".,;:!?#*$%&|<>()[]{}\"'`~^_-+=/\\"
_word = re.compile(r"\S+")  # the words of str.split()


def keys_of(word: str) -> list[str]:
    """The lower-cased word without marks at its ends, and its beginnings."""
    bare = word.lower().strip(_edges)
    return [bare, *(f"{bare[:k]}*" for k in BEGINNINGS if len(bare) > k)] if bare else []


#: The check values of the marks that kinds of features start with; a value goes on from there over a word's bytes.
_W, _E, _P, _Q, _N, _M = (zlib.crc32(c) for c in (b"w", b"e", b"p", b"q", b"n", b"m"))
_BEGUN = [zlib.crc32(b"%d" % k) for k in BEGINNINGS]
_FORMS = [[zlib.crc32(b"f%d%d%d%d" % (i >> 2, i >> 1 & 1, i & 1, n)) % SLOTS for n in range(5)] for i in range(8)]
_BIAS = zlib.crc32(b"b") % SLOTS


#: CRC-32 of one more byte: the next value is _BYTE[(value ^ byte) & 255] ^ value >> 8.
_BYTE = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)
_LONGEST = 64


def _from_mark(mark: int) -> np.ndarray:
    """By length: what to add to the value of bytes on their own for the value on from a mark. The function is linear."""
    return np.array([zlib.crc32(bytes(n), mark) ^ zlib.crc32(bytes(n)) for n in range(_LONGEST + 1)], np.uint32)


_AFTER = {mark: _from_mark(mark) for mark in (_W, _E, _P, _Q, _N, _M)}


def _run(columns: list[np.ndarray], mark: int) -> np.ndarray:
    """The values of equally many bytes of many words on from a mark, all words side by side."""
    value = np.full(len(columns[0]), mark ^ 0xFFFFFFFF, np.uint32)
    for column in columns:
        value = _BYTE[(value ^ column) & 255] ^ value >> np.uint32(8)
    return value ^ np.uint32(0xFFFFFFFF)


def _forms(words: list[str], sizes: np.ndarray) -> np.ndarray:
    kind = np.array([4 * w.isupper() + 2 * (not w.isalpha() and any(map(str.isdigit, w))) + w[-1:].isalnum() for w in words], np.int64)
    return np.array(_FORMS)[kind, np.minimum(sizes, 4)]


def _ascii_cells(words: list[str], bare: list[str]) -> list[np.ndarray]:
    """The columns of words of up to _LONGEST ASCII letters: the bytes of all words are run through side by side."""
    raw = [b.encode() for b in bare]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    alone = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
    joined = np.frombuffer(b"".join([*raw, bytes(8)]), np.uint8).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    head = [joined[starts + k] for k in range(BEGINNINGS[-1])]
    tail = [joined[np.maximum(starts + sizes - k, 0)] for k in (3, 2, 1)]
    whole = lambda mark: alone ^ _AFTER[mark][sizes]
    begun = lambda mark: np.where(sizes >= 4, _run(head[:4], mark), whole(mark))
    cut = [np.where(sizes >= k, _run(head[:k], mark) & (SLOTS - 1), SLOTS) for k, mark in zip(BEGINNINGS, _BEGUN, strict=True)]
    return [whole(_W), np.where(sizes >= 3, _run(tail, _E), whole(_E)), _forms(words, sizes), np.full(len(raw), _BIAS), *cut, whole(_P), begun(_Q), whole(_N), begun(_M)]


def _other_cells(words: list[str], bare: list[str]) -> list[np.ndarray]:
    sizes = np.fromiter(map(len, bare), np.int64, len(bare))
    raw = lambda cut: [b[cut].encode("utf-8", "surrogatepass") for b in bare]
    crc = lambda bytes_, mark: np.fromiter(map(zlib.crc32, bytes_, repeat(mark)), np.uint32, len(bytes_))
    whole, four = raw(slice(None)), raw(slice(4))
    cut = [np.where(sizes >= k, crc(four if k == 4 else raw(slice(k)), mark) & (SLOTS - 1), SLOTS) for k, mark in zip(BEGINNINGS, _BEGUN, strict=True)]
    return [crc(whole, _W), crc(raw(slice(-3, None)), _E), _forms(words, sizes), np.full(len(bare), _BIAS), *cut, crc(whole, _P), crc(four, _Q), crc(whole, _N), crc(four, _M)]


def cells_of(words: list[str]) -> np.ndarray:
    """Feature cells of words, a row each: OWN of the word's own, NEXT for the word after it, NEXT for the word before it.
    SLOTS: none. Most words of a corpus are met by a worker only once, so they are hashed by columns."""
    bare = [w.lower().strip(_edges) for w in words]
    out = np.empty((len(words), OWN + 2 * NEXT), np.int64)
    plain = np.array([b.isascii() and len(b) <= _LONGEST for b in bare], bool)
    for kind, columns in ((plain, _ascii_cells), (~plain, _other_cells)):
        at = np.flatnonzero(kind)
        if len(at):
            for k, column in enumerate(columns([words[i] for i in at.tolist()], [bare[i] for i in at.tolist()])):
                out[at, k] = column if 4 <= k < OWN else column.astype(np.int64) & (SLOTS - 1)
    return out


@dataclass(frozen=True)
class Field:
    """A trained field: weights of the feature cells, transition and start scores, and the curve of the score."""

    weights: np.ndarray  # SLOTS + 1, the last one 0
    moves: np.ndarray  # 2 x 2 log scores, from row to column
    start: np.ndarray
    curve: tuple[float, float, float] = (-6.0, 4.0, 0.0)  # intercept, and slopes on the logs of toxic words and words


def document_terms(toxic: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of the sums of marginals and the numbers of words: what the score is linear in."""
    return np.stack([np.ones(len(toxic)), np.log(toxic + 0.05), np.log(words + 1.0)], 1)


def chained(emitted: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Toxic-state scores of words end to end from (own, for the next, for the one before) scores."""
    scores = emitted[:, 0].copy()
    inner = np.flatnonzero(~first)
    scores[inner] += emitted[inner - 1, 1]
    scores[inner - 1] += emitted[inner, 2]
    return scores


class Emissions:
    """Scores of the words of a worker's texts by a field."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.memo = CutMemo(self._emitted, EMISSIONS, np.float64)

    def _emitted(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        w = self.field.weights[cells_of(words)]
        sums = [w[:, :OWN].sum(axis=1), w[:, OWN : OWN + NEXT].sum(axis=1), w[:, OWN + NEXT :].sum(axis=1)]
        return np.stack(sums, 1).ravel(), np.full(len(words), 3)

    def weigh(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words of some texts: marginals end to end, offsets of the texts, and the score of each text."""
        sizes = np.array([len(w) for w in words], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        at = self.memo.places(list(chain.from_iterable(words)))
        emitted = self.memo.ids[self.memo.starts[at][:, None] + np.arange(3)]
        first = np.zeros(len(at), bool)
        first[offsets[:-1][sizes > 0]] = True
        p = marginals(chained(emitted, first), first, self.field.moves, self.field.start)
        toxic = np.bincount(np.repeat(np.arange(len(words)), sizes), p, minlength=len(words))
        return p, offsets, toxic

    def scores(self, toxic: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(document_terms(toxic, np.diff(offsets)) @ np.array(self.field.curve))))


def calibrated(field: Field, toxic: np.ndarray, words: np.ndarray, labels: np.ndarray, share: float) -> Field:
    """The field with its score curve fitted by Newton steps to the sums of marginals and numbers of words of labelled
    documents; ``share`` is the part of toxic documents among all labelled ones. Without both labels the default curve
    stays."""
    if len(set(labels.tolist())) < 2:
        return field
    x = document_terms(toxic, words)
    part = np.where(labels == 1, share / max(1, (labels == 1).sum()), (1 - share) / max(1, (labels == 0).sum())) * len(labels)
    loss = lambda w: float((part * np.logaddexp(0, np.where(labels == 1, -1, 1) * (x @ w))).sum() + 0.05 * w @ w)
    w = np.array(field.curve)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        gradient = x.T @ (part * (p - labels)) + 0.1 * w
        step = np.linalg.solve((x * (part * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), gradient)
        while np.abs(step).max() > 1e-6 and loss(w - step) > loss(w):
            step = step / 2
        w = w - step
    return replace(field, curve=(float(w[0]), max(0.0, float(w[1])), float(w[2])))


def _steps(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each word the 2 x 2 matrix that carries the states before it to its own, (n, 2, 2), largest entry 1. A
    text's first word forgets what was before."""
    toxic = np.where(first[:, None], start[1], moves[:, 1][None, :]) + scores[:, None]
    clean = np.where(first[:, None], start[0], moves[:, 0][None, :]) + np.zeros(len(scores))[:, None]
    both = np.stack([clean, toxic], axis=2)
    return np.exp(both - both.max(axis=(1, 2), keepdims=True))


def marginals(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray, pairs: bool = False):
    """The probability of the toxic state of every word; with ``pairs`` also of (state before, state) per word.

    The words of all texts are dealt to equally long lanes. Every lane multiplies its matrices, the products carry the
    vectors from lane to lane, and all lanes then run forward and backward side by side: exact, in about sqrt(n) steps.
    """
    n = len(scores)
    if not n:
        return (np.zeros(0), np.zeros((0, 2, 2))) if pairs else np.zeros(0)
    length = max(1, int(np.sqrt(n)))
    lanes = -(-n // length)
    m = np.tile(np.eye(2), (lanes * length, 1, 1))
    m[:n] = _steps(scores, first, moves, start)
    a, b, c, d = (np.ascontiguousarray(m[:, i, j].reshape(lanes, length).T) for i in (0, 1) for j in (0, 1))
    p = [np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)]
    for k in range(length):
        p = [p[0] * a[k] + p[1] * c[k], p[0] * b[k] + p[1] * d[k], p[2] * a[k] + p[3] * c[k], p[2] * b[k] + p[3] * d[k]]
        top = np.maximum(np.maximum(p[0], p[1]), np.maximum(p[2], p[3]))
        p = [x / top for x in p]
    enter, leave = np.empty((lanes, 2)), np.empty((lanes, 2))
    now = np.array([0.5, 0.5])
    product = np.array(p).reshape(2, 2, lanes)
    for lane in range(lanes):
        enter[lane] = now
        now = now @ product[:, :, lane]
        now = now / now.sum()
    now = np.array([0.5, 0.5])
    for lane in range(lanes - 1, -1, -1):
        leave[lane] = now
        now = product[:, :, lane] @ now
        now = now / now.sum()
    forward = np.empty((length + 1, lanes))  # share of the toxic state; row 0 is before the lane's first word
    forward[0] = enter[:, 1]
    for k in range(length):
        t = forward[k]
        x, y = (1 - t) * a[k] + t * c[k], (1 - t) * b[k] + t * d[k]
        forward[k + 1] = y / (x + y)
    backward = np.empty((length + 1, lanes))
    backward[length] = leave[:, 1]
    for k in range(length - 1, -1, -1):
        t = backward[k + 1]
        x, y = a[k] * (1 - t) + b[k] * t, c[k] * (1 - t) + d[k] * t
        backward[k] = y / (x + y)
    after = backward[1:].T.reshape(-1)[:n]
    own = forward[1:].T.reshape(-1)[:n]
    toxic = own * after / (own * after + (1 - own) * (1 - after))
    if not pairs:
        return toxic
    before = forward[:-1].T.reshape(-1)[:n]
    joint = np.stack([1 - before, before], 1)[:, :, None] * m[:n] * np.stack([1 - after, after], 1)[:, None, :]
    return toxic, joint / joint.sum(axis=(1, 2), keepdims=True)


def train(texts: list[list[str]], tags: list[np.ndarray], rounds: int = 40) -> Field:
    """Fits weights, moves and start by gradient steps (adaptive step sizes, small L2 penalty) on labelled words."""
    index: dict[str, int] = {}
    flat = np.array([index.setdefault(w, len(index)) for words in texts for w in words], np.int64)
    if not len(flat) or not sum(t.sum() for t in tags):
        return Field(np.append(np.zeros(SLOTS), 0.0), np.array([[0.0, -10.0], [0.0, -10.0]]), np.array([0.0, -10.0]))
    cells = cells_of(list(index))
    y = np.concatenate(tags).astype(np.int64)
    first = np.zeros(len(flat), bool)
    first[np.cumsum([0, *map(len, texts)])[:-1][[len(t) > 0 for t in texts]]] = True
    inner = np.flatnonzero(~first)
    parts = (slice(0, OWN), slice(OWN, OWN + NEXT), slice(OWN + NEXT, None))
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (y[inner - 1], y[inner]), 1)
    seen_start = np.bincount(y[first], minlength=2)
    p = np.zeros(SLOTS + 1 + 6)
    mean, square = np.zeros(len(p)), np.zeros(len(p))
    for step in range(1, rounds + 1):
        w, moves, start = p[: SLOTS + 1], p[SLOTS + 1 : SLOTS + 5].reshape(2, 2), p[SLOTS + 5 :]
        by_word = np.stack([w[cells[:, part]].sum(axis=1) for part in parts], 1)
        toxic, joint = marginals(chained(by_word[flat], first), first, moves, start, pairs=True)
        off = y - toxic
        pulls = (off, np.append(off[1:] * ~first[1:], 0.0), np.append(0.0, off[:-1] * ~first[1:]))
        pull = np.zeros(SLOTS + 1)
        for own, part in zip(pulls, parts, strict=True):
            by = np.bincount(flat, own, minlength=len(index))
            pull += np.bincount(cells[:, part].ravel(), np.repeat(by, cells[:, part].shape[1]), minlength=SLOTS + 1)
        gradient = np.concatenate([
            pull,
            (seen_moves - joint[inner].sum(axis=0)).reshape(-1),
            seen_start - np.array([(1 - toxic[first]).sum(), toxic[first].sum()]),
        ]) / y.sum() - 1e-4 * p
        gradient[SLOTS] = 0
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        p = p + 0.25 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    return Field(p[: SLOTS + 1], p[SLOTS + 1 : SLOTS + 5].reshape(2, 2), p[SLOTS + 5 :])


def toxic_keys(known: DataFrame) -> set[str]:
    """The keys that the labelled toxic texts (text, label) show far more often than the clean ones, and more often than
    chance would: Chernoff's bound on the probability that so many of a key's texts are toxic is CHANCE at most.

    Only keys that pass are collected; each is in LEAST toxic texts of the bounded sample or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def flush() -> pa.RecordBatch:
            names, both = list(counts), list(counts.values())
            counts.clear()
            return pa.RecordBatch.from_pydict({"key": pa.array(names, pa.string()), "c": pa.array([b[0] for b in both], pa.int64()), "t": pa.array([b[1] for b in both], pa.int64())})

        for batch in slices(batches, 128):
            for text, label in zip(column_of(batch, "text"), column_of(batch, "label"), strict=True):
                for key in {k for w in set((text or "").split()) for k in keys_of(w)}:
                    counts[key][int(label == 1)] += 1
            if len(counts) > MEMO_ENTRIES:
                yield flush()
        yield flush()

    once = known.dropDuplicates(["text", "label"])
    total = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = total.pop(1, 0)
    clean = sum(total.values())
    counts = once.mapInArrow(run, "key string, c long, t long").groupBy("key").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    share, own = (toxic + 1) / (clean + toxic + 2), F.col("t") / (F.col("c") + F.col("t"))
    distance = own * F.log(own / share) + F.when(F.col("c") > 0, (1 - own) * F.log((1 - own) / (1 - share))).otherwise(0.0)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + PRIOR) / (clean + 1))
    passed = counts.where(F.col("t") >= LEAST).where((own > share) & ((F.col("c") + F.col("t")) * distance >= float(-np.log(CHANCE))) & (odds > STRONG))
    return {r["key"] for r in passed.select("key").collect()}


def tagged(words: list[str], label: int, keys: set[str]) -> np.ndarray:
    """1 for the toxic words of a labelled text."""
    return np.array([int(label == 1 and any(k in keys for k in keys_of(w))) for w in words], np.int64)


def _weighed(known: DataFrame, field: Field) -> DataFrame:
    """label, toxic (the sum of marginals) and words of labelled texts."""
    shared = known.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Emissions(shared.value)
        for batch in slices(batches, 128):
            _, offsets, toxic = memo.weigh([(t or "").split() for t in column_of(batch, "text")])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(toxic), pa.array(np.diff(offsets))], ["label", "toxic", "words"])

    return known.select("text", "label").mapInArrow(run, "label long, toxic double, words long")


def fit(docs: DataFrame, labels: DataFrame, where: str = "true") -> Field:
    """A field trained on a bounded sample of the rows of ``labels`` that meet ``where``.

    About LABELLED labelled texts are written once to the shared folder; of these, 2 * TRAINED bounded texts and the
    numbers of 2 * CALIBRATED texts reach the driver.
    """
    ids, values = sampled_labels(labels, "toxic", LABELLED, where)
    known = labelled_texts(docs, ids, values)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    keys = toxic_keys(known)

    def some(rows: DataFrame, most: int) -> DataFrame:
        """About ``most`` rows of each label, by a hash of the text."""
        share = F.when(F.col("label") == 1, most / max(1, counts.get(1, 0))).otherwise(most / max(1, counts.get(0, 0)))
        return rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))

    short = known.where(F.coalesce(F.length("text"), F.lit(0)) <= TRAINED_CHARS)
    rows = sorted((r["text"] or "", r["label"]) for r in some(short, TRAINED).dropDuplicates(["text", "label"]).collect())
    field = train([t.split() for t, _ in rows], [tagged(t.split(), label, keys) for t, label in rows])
    found = sorted(map(tuple, _weighed(some(known, CALIBRATED), field).collect()))
    label, toxic, words = (np.array(c, float) for c in zip(*found, strict=True)) if found else (np.zeros(0),) * 3
    return calibrated(field, toxic, words, label, counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, field: Field, keep: list[str], prefix: str = "") -> DataFrame:
    """The columns ``keep`` with score (0 to 1), predicted (1 if score >= THRESHOLD, else 0) and spans
    (array<struct<begin int, end int>>, character offsets), whose names start with ``prefix``. Kept columns of these
    names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # SLOTS numbers
    names = [f"{prefix}{n}" for n in ("score", "predicted", "spans")]
    keep = [k for k in keep if k not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Emissions(shared.value)
        for batch in slices(batches, 256):
            texts = [t or "" for t in column_of(batch, "text")]
            p, offsets, toxic = memo.weigh([t.split() for t in texts])
            total = memo.scores(toxic, offsets)
            hot = np.bincount(np.repeat(np.arange(len(texts)), np.diff(offsets))[p > 0.5], minlength=len(texts))
            spans = [_spans(texts[i], p[offsets[i] : offsets[i + 1]]) if hot[i] else [] for i in range(len(texts))]
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            new = [pa.array(total), pa.array((total >= THRESHOLD).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*kept, *new], [*keep, *names])

    types = ("double", "int", "array<struct<begin: int, end: int>>")
    schema = ", ".join([*([fields(docs, keep)] if keep else []), *(f"`{n}` {t}" for n, t in zip(names, types, strict=True))])
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)


def _spans(text: str, p: np.ndarray) -> list[dict[str, int]]:
    found: list[dict[str, int]] = []
    last = False
    for word, toxic in zip(_word.finditer(text), p > 0.5, strict=True):
        if toxic and last:
            found[-1]["end"] = word.end()
        elif toxic:
            found.append({"begin": word.start(), "end": word.end()})
        last = bool(toxic)
    return found

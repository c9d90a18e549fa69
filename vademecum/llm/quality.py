"""Quality rules: fixed counts of a text, and a hashed n-gram log-likelihood ratio.

Words and adjacent word pairs are hashed into ``BUCKETS`` cells. Two smoothed multinomials over the cells are counted:
one over all documents (raw) and one over the documents that the caller trusts (target). A document's verdict value is
the sum of log(target / raw) over its n-grams divided by their number; it is kept if the value reaches a threshold. No
sampling takes part, so a document's verdict depends on its text and the two count tables alone.

The threshold is fitted on all labelled documents, or is ``DEFAULT`` if good or bad ones are missing. Documents that fail the
fixed rules are never kept. A null or empty text has no words and fails; rows without a doc_id are judged and never
trusted; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vademecum.llm.shared import column_of, fields, label_of_ids, slices, written
from vademecum.llm.words import SPACES, WordHashes, hash_words, mix64, window_hashes

BUCKETS = 1 << 16
DEFAULT = -1.0
GOOD_WEIGHT = 5.0
BINS = 256
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
_in_line = re.compile(f"[^{SPACES}]")


def ngram_cells(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all words and of all pairs within a text, and the text each belongs to."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    single = mix64(words) % np.uint64(BUCKETS)
    same = text[1:] == text[:-1]
    pairs = window_hashes(words, 2)[same] % np.uint64(BUCKETS)
    return np.concatenate([single, pairs]).astype(np.int64), np.concatenate([text, text[1:][same]])


def repeated_words(words: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur at least twice in the text, the first occurrence included."""
    hashes = window_hashes(words, width)
    if len(hashes) < 2:
        return 0
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    equal = ordered[1:] == ordered[:-1]
    if not equal.any():
        return 0
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == 1:
        return 0
    lines = [x for x in lines if _in_line.search(x)]
    return len(lines) - len(set(lines))


def count_cells(docs: DataFrame, trusted: DataFrame | Iterable[int]) -> DataFrame:
    """How often each cell occurs over the whole texts of all rows: cell, n, and n_target over the rows whose doc_id
    is in ``trusted`` (different ids, or a table of them in doc_id).

    Ids of any number meet the texts in one shuffle of these. Each task sends one row per cell it met, whatever its
    number of documents.
    """
    if not isinstance(trusted, DataFrame):
        trusted = docs.sparkSession.createDataFrame([(int(i),) for i in trusted], "doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            words, offsets = hash_words(column_of(batch, "text"), memo)
            cells, text = ngram_cells(words, offsets)
            raw += np.bincount(cells, minlength=BUCKETS)
            own = np.array(column_of(batch, "own"), bool)
            target += np.bincount(cells[own[text]], minlength=BUCKETS)
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(raw[met]), pa.array(target[met])], ["cell", "n", "n_target"])

    marked = docs.select("doc_id", "text").join(trusted.select("doc_id", F.lit(True).alias("own")).hint("shuffle_hash"), "doc_id", "left")
    counted = marked.select("text", F.coalesce("own", F.lit(False)).alias("own")).mapInArrow(run, "cell long, n long, n_target long")
    return counted.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log(target / raw) of every cell, add-one smoothed; all zero if nothing is trusted. At most BUCKETS rows."""
    rows = counts.collect()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in rows:
        raw[r["cell"]] += r["n"]
        target[r["cell"]] += r["n_target"]
    if target.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def measures(docs: DataFrame, ratios: np.ndarray, keep: list[str], prefix: str = "") -> DataFrame:
    """The columns ``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and log_ratio (a double;
    0 without words), whose names start with ``prefix``. Kept columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS doubles
    names = [prefix + n for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ratio")]
    keep = [k for k in keep if k not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in slices(batches):
            texts = [t or "" for t in column_of(batch, "text")]
            words, offsets = hash_words(texts, memo)
            cells, text = ngram_cells(words, offsets)
            n = np.bincount(text, minlength=len(texts))
            ratio = np.bincount(text, shared.value[cells], minlength=len(texts)) / np.maximum(n, 1)
            columns = [
                np.diff(offsets),
                [len(t) - sum(map(t.count, SPACES)) for t in texts],
                [sum(map(t.count, SYMBOLS)) for t in texts],
                [duplicate_lines(t) for t in texts],
                [repeated_words(words[offsets[i] : offsets[i + 1]]) for i in range(len(texts))],
            ]
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in columns), pa.array(ratio)], [*keep, *names])

    schema = ", ".join([*([fields(docs, keep)] if keep else []), *(f"`{n}` long" for n in names[:-1]), f"`{names[-1]}` double"])
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)


def with_base(rows: DataFrame, prefix: str = "") -> DataFrame:
    """Adds base_failed by the fixed rules; ``prefix`` as in ``measures``."""
    words, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return rows.withColumn(f"{prefix}base_failed", (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words))


def fit(scored: DataFrame, known: DataFrame) -> float:
    """The threshold that minimises, over the labelled documents that pass the fixed rules, the share of good ones below
    it (counted GOOD_WEIGHT times) plus the share of bad ones above it.

    ``scored`` has doc_id, base_failed and log_ratio, ``known`` the doc_id and label of every labelled document. Only
    counts of each label and bin are collected.
    """
    rows = scored.where("NOT base_failed").join(known, "doc_id")
    at = F.floor(F.col("log_ratio") * BINS)
    bins = rows.groupBy("label", F.greatest(F.least(at, F.lit(8 * BINS)), F.lit(-8 * BINS)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return threshold([(r["label"], r["bin"], r["n"]) for r in bins.collect()])


def threshold(bins: list[tuple[int, int, int]]) -> float:
    """The best cut for (label, bin, count) rows; DEFAULT if a label is missing."""
    good = np.zeros(16 * BINS + 2)
    bad = np.zeros(16 * BINS + 2)
    for label, at, n in bins:
        (good if label == 1 else bad)[int(at) + 8 * BINS] += n
    if not good.sum() or not bad.sum():
        return DEFAULT
    lost = np.cumsum(good) / good.sum()
    passed = 1 - np.cumsum(bad) / bad.sum()
    loss = GOOD_WEIGHT * lost + passed
    best = np.flatnonzero(np.isclose(loss, loss.min()))
    middle = best[: np.flatnonzero(np.diff(best, append=best[-1] + 2) != 1)[0] + 1]
    return float((np.median(middle) + 1 - 8 * BINS) / BINS)


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], prefix: str = "") -> DataFrame:
    """The columns ``keep`` of every row with its counts, log_ratio, base_failed and kept, whose names start with
    ``prefix``. Kept columns of these names are replaced.

    The raw counts cover all documents, the trusted ones all that are labelled good, the threshold all labelled ones.
    The measured rows are written once: the threshold and the verdicts are taken from them.
    """
    known = label_of_ids(labels, "quality")
    ratios = log_ratios(count_cells(docs, known.where("label = 1")))
    own = [] if "doc_id" in keep else ["doc_id"]
    rows = written(with_base(measures(docs, ratios, [*keep, *own], prefix), prefix), "measured")
    scored = rows.select("doc_id", *[F.col(prefix + n).alias(n) for n in ("base_failed", "log_ratio")])
    kept = ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}log_ratio") >= fit(scored, known))
    return rows.withColumn(f"{prefix}kept", kept).drop(*own)

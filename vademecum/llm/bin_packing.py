"""Best-fit packing by minimum bin slack.

Bins are filled one after the other: the longest remaining piece opens the bin, a bit set of reachable sums over the
remaining lengths finds the fullest feasible combination for the rest, and that combination is removed. Pieces of one
length are alike, so only how many there are of each length matters: the plan is made from a table of at most
``capacity`` counts, whatever the size of the corpus, and a combination is taken as many times at once as the counts
allow, which is what choosing it again and again would do. Each such step at least halves the count of some length, so
a plan over n pieces has at most capacity * (log2(n) + 1) steps.

Pieces are then numbered within their length by a distributed ranking, and the number decides bin and offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vademecum.llm.shared import column_of, free_prefix, ranked_by_unit, slices, written
from vademecum.llm.tokenize import TokenIds, with_end

UNITS = 256


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> list[tuple[int, int]]:
    """The combination of available pieces with the largest sum up to ``room``, as (length, how many).

    ``lengths`` are in descending order; bit k of a set says whether sum k can be reached. Stops once ``room`` is met.
    """
    reach, within = 1, (1 << (room + 1)) - 1
    history: list[tuple[int, int]] = []  # (length of one more piece, sums reachable before it)
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            grown = (reach | reach << length) & within
            if grown == reach:
                break
            history.append((length, reach))
            reach = grown
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(history):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + 1
            total -= length
    return list(used.items())


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, [(length, pieces of it in each)]) for all pieces; lengths are 1 to ``capacity``."""
    counts = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(counts, reverse=True)
    steps = []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        chosen = dict(fullest(capacity - first, lengths, counts))
        counts[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        times = min(counts[k] // v for k, v in chosen.items())
        for k, v in chosen.items():
            counts[k] -= times * v
        steps.append((times, sorted(chosen.items(), reverse=True)))
        if any(counts[k] == 0 for k in chosen):
            lengths = [k for k in lengths if counts[k]]
    return steps


def placements(steps: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first piece number, first bin, pieces per bin and offset of every step that uses it."""
    table: dict[int, list[list[int]]] = {}
    taken: dict[int, int] = {}
    bins = 0
    for times, chosen in steps:
        offset = 0
        for length, each in chosen:
            rows = table.setdefault(length, [[], [], [], []])
            for column, value in zip(rows, (taken.get(length, 0), bins, each, offset), strict=True):
                column.append(value)
            taken[length] = taken.get(length, 0) + times * each
            offset += length * each
        bins += times
    return {k: tuple(np.array(c, np.int64) for c in rows) for k, rows in table.items()}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every text's ids (null: empty) with ``end_id`` appended; only
    longer documents are cut, into pieces of ``capacity`` ids. A document without any id has no piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = TokenIds.open(tokenizer)
        for batch in slices(batches):
            ids, offsets = with_end(*model.encode(column_of(batch, "text")), end_id)
            raw, rows = memoryview(ids.astype("<u4").tobytes()), []
            for doc_id, begin, end in zip(column_of(batch, "doc_id"), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for piece, start in enumerate(range(begin, end, capacity)):
                    stop = min(start + capacity, end)
                    rows.append((doc_id, piece, start - begin, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``; columns of these names are replaced,
    all others stay, whatever their names.

    Offsets in a sequence are gapless from 0. Rows of one length that are alike in all columns are told apart by
    their number only. An empty frame stays empty.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    if any(not 1 <= k <= capacity for k in counts):
        raise ValueError("a piece's length is not between 1 and the capacity")
    table = pieces.sparkSession.sparkContext.broadcast(placements(plan(counts, capacity)))
    pieces = pieces.drop("sequence_id", "offset")
    p = free_prefix(pieces.columns)
    unit, rank_name = f"{p}unit", f"{p}rank"
    others = [F.col(f"`{c}`") for c in pieces.columns if c != "length"]
    spread = pieces.withColumn(unit, F.pmod(F.xxhash64(*others) if others else F.lit(0), F.lit(UNITS)).cast("int"))
    ranked = ranked_by_unit(spread, ["length"], unit, [F.col(f"`{c}`") for c in pieces.columns], rank_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index(rank_name)).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                first, bins, each, begin = table.value[int(size)]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                inside = rank[rows] - first[k]
                sequence[rows] = bins[k] + inside // each[k]
                offset[rows] = begin[k] + inside % each[k] * size
            kept = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if f.name != rank_name]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(sequence), pa.array(offset)], [n for n, _ in kept] + ["sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*[f"`{c}`" for c in pieces.columns], rank_name).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0) -> DataFrame:
    """Token pieces of all documents with the sequence and offset of each."""
    return pack(written(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)

"""Token-id files in Simple-8b coding.

One 64-bit word holds a 4-bit selector and as many ids of one width as fit in 60 bits; selector 0 marks an escape,
whose low bits number a raw 64-bit value in the block's escape table, so that any unsigned 64-bit id can be stored. A
block is one document. A file starts with a header and a table of its blocks (document id, number of ids, first word,
first escape), which lets a reader decode one block alone or, as here, all blocks of a file in a few array operations.

Files hold the documents in ascending doc_id order, null ids first, equal ids ordered by their text; the order of the
file names is the order of the documents. Files are cut at a size bound, so each can be held in memory by its reader.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vademecum.llm.shared import column_of, new_folder, slices
from vademecum.llm.tokenize import TokenIds, with_end

#: Bits of an id and ids in a word for the selectors 1 to 15.
WIDTHS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
COUNTS = [120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
MAGIC = b"S8BIDS01"
BLOCK = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("ids", "<u8"), ("word", "<u8"), ("escape", "<u8")])
FILE_BYTES = 16 << 20
PART_IDS = 1 << 15


def pack(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packs blocks ``ids[bounds[k]:bounds[k + 1]]``.

    Returns words, escapes and, for each block and the end, its first word and its first escape.
    """
    sizes = np.diff(bounds)
    gap = max(COUNTS)  # zeros after each block, so that its last word can be filled up
    begins = np.concatenate([[0], np.cumsum(sizes + gap)])
    padded = np.zeros(begins[-1], np.uint64)
    place = np.arange(len(ids)) + np.repeat(begins[:-1] - bounds[:-1], sizes)
    padded[place] = ids
    need = _bits(padded)
    fits = np.zeros(len(padded), np.uint8)  # the selectors that can begin at each id
    widest = {1: need}  # the most bits that any of the next 1, 2, 4, ... ids needs
    while 2 * (k := max(widest)) <= gap:
        widest[2 * k] = np.maximum(widest[k], np.append(widest[k][k:], np.zeros(k, np.uint8))[: len(need)])
    for width, count in zip(WIDTHS, COUNTS, strict=True):
        k = 1 << count.bit_length() - 1
        later = np.append(widest[k][count - k :], np.zeros(count - k, np.uint8))[: len(need)]
        fits += np.maximum(widest[k], later) <= width
    # Where one fits, so do all wider ones, which hold fewer ids: the first that fits holds the most. 0: escape, none fits.
    selector = np.where(fits > 0, len(WIDTHS) + 1 - fits, 0).astype(np.uint8)
    steps, begun = np.array([1, *COUNTS], np.uint8)[selector].tobytes(), bytearray(len(padded))
    for begin, size in zip(begins[:-1].tolist(), sizes.tolist(), strict=True):
        end = begin + size
        while begin < end:
            begun[begin] = 1
            begin += steps[begin]
    starts = np.flatnonzero(np.frombuffer(begun, np.uint8))
    first_word = np.searchsorted(starts, begins)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(1, len(WIDTHS) + 1):
        rows = np.flatnonzero(chosen == s)
        width, count = WIDTHS[s - 1], COUNTS[s - 1]
        if len(rows) and width:
            first, value = starts[rows], words[rows]
            for k in range(count):
                value |= padded[first + k] << np.uint64(k * width)
            words[rows] = value
    escaped = np.flatnonzero(chosen == 0)
    first_escape = np.searchsorted(escaped, first_word)
    if len(escaped):
        block = np.searchsorted(first_word, escaped, side="right") - 1
        words[escaped] = (np.arange(len(escaped)) - first_escape[block]).astype(np.uint64)
    return words, padded[starts[escaped]], first_word, first_escape


def _parts(bounds: np.ndarray, most: int) -> np.ndarray:
    """The bounds of runs of blocks of about ``most`` ids."""
    return np.unique(np.concatenate([[0], np.searchsorted(bounds, np.arange(0, bounds[-1] + 1, most), side="left"), [len(bounds) - 1]]))


def pack_parts(ids: np.ndarray, bounds: np.ndarray, most: int = PART_IDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same as ``pack``, over runs of blocks of about ``most`` ids, so that the arrays stay in the processor's cache."""
    cuts = _parts(bounds, most)
    parts, words, escapes = [], 0, 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        w, e, first_word, first_escape = pack(ids[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        parts.append((w, e, first_word[:-1] + words, first_escape[:-1] + escapes))
        words, escapes = words + len(w), escapes + len(e)
    if not parts:
        return pack(ids, bounds)
    w, e, first_word, first_escape = (np.concatenate(x) for x in zip(*parts, strict=True))
    return w, e, np.append(first_word, words), np.append(first_escape, escapes)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs; 61 stands for more than 60."""
    if int(ids.max(initial=0)) < 1 << 53:
        return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    need = np.zeros(len(ids), np.uint8)
    for width in range(min(61, int(ids.max(initial=0)).bit_length())):
        need += (ids >> np.uint64(width)) != 0
    return need


def unpack(words: np.ndarray, escapes: np.ndarray, first_word: np.ndarray, first_escape: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of all blocks end to end; ``sizes`` are the numbers of ids. A block whose words hold another number
    of ids raises ValueError."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    held = np.array([1, *COUNTS])[chosen]
    offset = np.concatenate([[0], np.cumsum(held)])
    values = np.zeros(offset[-1], np.uint64)
    for s in range(1, len(WIDTHS) + 1):
        rows = np.flatnonzero(chosen == s)
        width, count = WIDTHS[s - 1], COUNTS[s - 1]
        if len(rows) and width:
            mask = np.uint64((1 << width) - 1)
            for k in range(count):
                values[offset[rows] + k] = (words[rows] >> np.uint64(k * width)) & mask
    escaped = np.flatnonzero(chosen == 0)
    if len(escaped):
        block = np.searchsorted(first_word, escaped, side="right") - 1
        values[offset[escaped]] = escapes[first_escape[block] + words[escaped].astype(np.int64)]
    begin, room = offset[first_word], np.diff(np.append(offset[first_word], offset[-1]))
    last = np.where(room > 0, held[np.maximum(np.append(first_word[1:], len(words)) - 1, 0)] if len(words) else 0, 0)
    if np.any(room < sizes) or np.any((room > 0) & (room - last >= sizes)):
        raise ValueError("a block's words do not hold its number of ids")
    inside = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return values[inside]


def unpack_parts(words: np.ndarray, escapes: np.ndarray, first_word: np.ndarray, first_escape: np.ndarray, sizes: np.ndarray, most: int = PART_IDS) -> np.ndarray:
    """The same as ``unpack``, over runs of blocks of about ``most`` ids."""
    bounds = np.append(0, np.cumsum(sizes))
    ends, escape_ends = np.append(first_word, len(words)), np.append(first_escape, len(escapes))
    parts, cuts = [np.zeros(0, np.uint64)], _parts(bounds, most)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own, escaped = slice(ends[a], ends[b]), slice(escape_ends[a], escape_ends[b])
        parts.append(unpack(words[own], escapes[escaped], first_word[a:b] - ends[a], first_escape[a:b] - escape_ends[a], sizes[a:b]))
    return np.concatenate(parts)


def file_bytes(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words, escapes, first_word, first_escape = pack_parts(ids, bounds)
    table = np.zeros(len(doc_ids), BLOCK)
    table["known"] = [d is not None for d in doc_ids]
    table["doc_id"] = [d or 0 for d in doc_ids]
    table["ids"], table["word"], table["escape"] = sizes, first_word[:-1], first_escape[:-1]
    head = np.array([len(doc_ids), len(words), len(escapes)], "<u8").tobytes()
    body = table.tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()
    return MAGIC + head + np.uint32(zlib.crc32(body)).tobytes() + body


def parse_file(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The block table and all ids of a file. A damaged file raises ValueError."""
    if raw[:8] != MAGIC or len(raw) < 36:
        raise ValueError("not a Simple-8b id file")
    docs, n_words, n_escapes = (int(x) for x in np.frombuffer(raw, "<u8", 3, 8))
    body = memoryview(raw)[36:]
    if len(body) != docs * BLOCK.itemsize + 8 * (n_words + n_escapes) or zlib.crc32(body) != int(np.frombuffer(raw, "<u4", 1, 32)[0]):
        raise ValueError("the file's length or checksum is wrong")
    table = np.frombuffer(body, BLOCK, docs)
    words = np.frombuffer(body, "<u8", n_words, docs * BLOCK.itemsize)
    escapes = np.frombuffer(body, "<u8", n_escapes, docs * BLOCK.itemsize + 8 * n_words)
    sizes = table["ids"].astype(np.int64)
    return table, unpack_parts(words, escapes, table["word"].astype(np.int64), table["escape"].astype(np.int64), sizes)


def write_id_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, partitions: int | None = None) -> DataFrame:
    """Tokenises ``text`` (null: empty), appends ``end_id`` and writes the ids; returns a row per file (file, docs, ids).

    The texts are shuffled once, by ranges of doc_id; each task writes its range in order. Running the returned frame
    writes the files. Names are new in every attempt of a task, so only the files in the returned rows of a finished job
    count.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        name = f"{TaskContext.get().partitionId():06d}"
        attempt = uuid.uuid4().hex[:10]
        model, number = TokenIds.open(tokenizer), 0
        doc_ids, parts, sizes = [], [], []

        def flush() -> pa.RecordBatch:
            file = f"ids-{name}-{number:06d}-{attempt}.s8b"
            with store.open_output_stream(f"{path}/{file}", compression=None) as out:
                out.write(file_bytes(doc_ids, sizes, np.concatenate(parts).astype(np.uint64)))
            return pa.RecordBatch.from_pydict({"file": [file], "docs": [len(doc_ids)], "ids": [sum(sizes)]})

        for batch in slices(batches):
            ids, offsets = with_end(*model.encode(column_of(batch, "text")), end_id)
            doc_ids += column_of(batch, "doc_id")
            parts.append(ids)
            sizes += np.diff(offsets).tolist()
            if 4 * sum(map(len, parts)) >= FILE_BYTES:
                yield flush()
                number, doc_ids, parts, sizes = number + 1, [], [], []
        if doc_ids:
            yield flush()

    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first(), tie)
    return ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie).mapInArrow(run, "file string, docs long, ids long")


def read_id_files(spark: SparkSession, folder: str, files: DataFrame | None = None, with_ids: bool = True) -> DataFrame:
    """Reads all files of a folder, or those in ``files``: file, doc_id, in_file (ids before it in its file), n_tokens,
    ids (array<int>; not without ``with_ids``), ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            table, ids = parse_file(batch.column(1)[0].as_py())
            sizes = table["ids"].astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            raw = ids.astype("<u4")
            for k in range(0, len(table), 512):
                rows = slice(k, k + 512)
                size, begin = sizes[rows], bounds[:-1][rows]
                own = [raw[b : b + s] for b, s in zip(begin, size, strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate(own).view(np.int32)))] if with_ids else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[0].as_py()] * len(own), pa.string()),
                        pa.array(table["doc_id"][rows].astype(np.int64), mask=table["known"][rows] == 0),
                        pa.array(begin.astype(np.int64)),
                        pa.array(size),
                        *lists,
                        pa.array([zlib.crc32(x) for x in own], pa.int64()),
                    ],
                    ["file", "doc_id", "in_file", "n_tokens", *(["ids"] if with_ids else []), "ids_crc32"],
                )

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    if files is not None:
        raw = raw.join(files.select("file"), "file", "left_semi").select("file", "content")
    return raw.mapInArrow(run, f"file string, doc_id long, in_file long, n_tokens long, {'ids array<int>, ' if with_ids else ''}ids_crc32 long")


def with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``start`` from the numbers of ids in the files before; ``files`` has one row per file."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("_base"))
    return rows.join(starts, "file", "left").withColumn("start", F.col("_base") + F.col("in_file")).drop("_base", "in_file", "file")


def id_files(docs: DataFrame, tokenizer: str, end_id: int | None = None, folder: str | None = None, with_ids: bool = True) -> DataFrame:
    """Writes the ids of all documents and reads the files back: doc_id, start, n_tokens, ids (not without
    ``with_ids``), ids_crc32."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-ids")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    manifest = f"{folder}/_files"
    write_id_files(docs, folder, tokenizer, end_id).write.parquet(manifest)
    files = spark.read.schema("file string, docs long, ids long").parquet(manifest)
    return with_starts(read_id_files(spark, folder, files, with_ids), files)

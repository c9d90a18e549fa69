"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: every row becomes one record. Among rows with equal payloads the one with the smallest page_id is a response,
the others are revisits of it that hold the HTTP headers only; below ``min_dedup_bytes`` all are responses. Each task
trains a dictionary on its first records and rolls its archive at a size bound.

Reading: the dictionary is taken from the skippable frame (itself compressed or not), every frame is found by walking
its block headers and decoded alone, and each record's version line, headers, lengths, end mark and digests are
validated; anything wrong raises ValueError with the archive and the place.

Null payloads count as empty, null URLs as an empty target. Rows with a null page_id are written with an empty record
number; if all page_ids of a payload are null they are all responses. Rows that repeat the smallest page_id of a
payload are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vademecum.llm.shared import column_of, new_folder, slices

#: Fixed values of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
DICTIONARY_MAGIC = bytes.fromhex("37a430ec")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
RECORD = "urn:page:"
#: Payload bytes after which a task starts a new archive; rows its dictionary is trained on; bytes of a dictionary.
ARCHIVE_BYTES, TRAINED, DICTIONARY_BYTES = 32 << 20, 200, 32 << 10


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, first: int | None) -> bytes:
    """One WARC record; a revisit if ``first`` (the page it refers to) is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest_text(sha1)}",
        f"WARC-Block-Digest: sha1:{digest_text(hashlib.sha1(block).digest())}",
    ]
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD}{first}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of a record after validation."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name.strip() != name:
            raise ValueError(f"malformed header {line[:60]!r}")
        fields[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"headers are missing: {sorted(missing)}")
    if not fields["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the block does not have the length that its header states")
    block = rest[:size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + digest_text(hashlib.sha1(block).digest()):
        raise ValueError("the block digest is wrong")
    http, mark, payload = block.partition(b"\r\n\r\n")
    stated = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if not mark or stated is None:
        raise ValueError("no HTTP headers with a length")
    kind = fields["warc-type"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if len(payload) != stated or digest != digest_text(hashlib.sha1(payload).digest()):
            raise ValueError("the payload's length or digest is wrong")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise ValueError("a revisit needs a record that it refers to and no payload")
    number = lambda name: int(fields[name].strip("<>").removeprefix(RECORD)) if fields.get(name, "").strip("<>") not in ("", RECORD) else None
    return {
        "page_id": number("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": stated,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number("warc-refers-to"),
        "payload": payload if kind == "response" else None,
    }


def frame_end(raw: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends."""
    if int.from_bytes(raw[at : at + 4], "little") != FRAME or len(raw) < at + 6:
        raise ValueError("no Zstandard frame")
    flags = raw[at + 4]
    single = flags >> 5 & 1
    size_bytes = (1 if single else 0, 2, 4, 8)[flags >> 6]
    place = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + size_bytes
    while place + 3 <= len(raw):
        header = int.from_bytes(raw[place : place + 3], "little")
        place += 3 + (1 if header >> 1 & 3 == 1 else header >> 3)
        if header & 1:
            place += 4 * (flags >> 2 & 1)
            if place > len(raw):
                break
            return place
    raise ValueError("the frame is cut off")


def dictionary_of(raw: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, and where the records start."""
    if len(raw) < 8 or int.from_bytes(raw[:4], "little") != SKIPPABLE:
        return None, 0
    size = int.from_bytes(raw[4:8], "little")
    if 8 + size > len(raw):
        raise ValueError("the skippable frame is cut off")
    content = bytes(raw[8 : 8 + size])
    if int.from_bytes(content[:4], "little") == FRAME:
        content = zstandard.ZstdDecompressor().decompress(content, max_output_size=16 << 20)
    return zstandard.ZstdCompressionDict(content), 8 + size


def parse_archive(raw: bytes) -> Iterator[dict]:
    view = memoryview(raw)
    dictionary, at = dictionary_of(view)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(view):
        end = frame_end(view, at)
        yield parse_record(reader.decompressobj().decompress(view[at:end]))
        at = end


def _trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few or too small samples
        return None


class _Archive:
    """Records of one archive, gathered in memory up to the size bound."""

    def __init__(self, dictionary: zstandard.ZstdCompressionDict | None) -> None:
        self.out, self.held, self.records = io.BytesIO(), 0, 0
        self.writer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True) if dictionary else zstandard.ZstdCompressor(level=3, write_checksum=True)
        if dictionary:
            content = zstandard.ZstdCompressor(level=3).compress(dictionary.as_bytes())
            self.out.write(SKIPPABLE.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content)

    def add(self, record: bytes) -> None:
        self.out.write(self.writer.compress(record))
        self.held += len(record)
        self.records += 1


def with_first(pages: DataFrame, min_dedup_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 and first: the page that a revisit refers to, else null.

    Payload digests are counted with map-side sums; only digests met more than once are joined back, and a payload
    that a large share of the rows has is split by the adaptive skew join.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    often = rows.where(F.length("payload") >= min_dedup_bytes).groupBy("sha1").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    joined = rows.join(often.where("_n > 1").select("sha1", "_first"), "sha1", "left")
    first = F.when((F.length("payload") >= min_dedup_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.select("page_id", "url", "payload", "sha1", first.alias("first"))


def write_archives(pages: DataFrame, folder: str, min_dedup_bytes: int = 0) -> DataFrame:
    """Writes the archives; returns file and records of each. Names are new in every attempt of a task, so only the
    files in the returned rows of a finished job count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{uuid.uuid4().hex[:10]}"
        waiting: list[bytes] = []
        archive, number, dictionary, ready = None, 0, None, False

        def close() -> pa.RecordBatch:
            file = f"pages-{name}-{number:05d}.warc.zst"
            with store.open_output_stream(f"{path}/{file}", compression=None) as out:
                out.write(archive.out.getvalue())
            return pa.RecordBatch.from_pydict({"file": [file], "records": pa.array([archive.records], pa.int64())})

        def records():
            nonlocal ready, dictionary
            held = 0
            for batch in slices(batches, 128):
                columns = [column_of(batch, n) for n in ("page_id", "url", "payload", "sha1", "first")]
                for row in zip(*columns, strict=True):
                    record = record_bytes(*row)
                    if ready:
                        yield record
                        continue
                    waiting.append(record)
                    held += len(record)
                    if len(waiting) >= TRAINED or held > ARCHIVE_BYTES:
                        dictionary, ready = _trained(waiting), True
                        yield from waiting
                        waiting.clear()
            if waiting:
                dictionary, ready = _trained(waiting), True
                yield from waiting

        for record in records():
            archive = archive or _Archive(dictionary)
            archive.add(record)
            if archive.held >= ARCHIVE_BYTES:
                yield close()
                archive, number = None, number + 1
        if archive:
            yield close()

    return with_first(pages, min_dedup_bytes).mapInArrow(run, "file string, records long")


def read_archives(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """All records of the ``*.warc.zst`` archives in a folder, or of those in ``files``: file, page_id, url,
    payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    types = pa.schema([
        ("file", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            file, rows, at = batch.column(0)[0].as_py(), [], 0
            try:
                for at, record in enumerate(parse_archive(batch.column(1)[0].as_py())):
                    rows.append(record | {"file": file})
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, types)
                        rows = []
            except (ValueError, zstandard.ZstdError) as e:
                raise ValueError(f"{file}, after record {at}: {e}") from e
            yield pa.RecordBatch.from_pylist(rows, types)

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    if files is not None:
        raw = raw.join(files.select("file"), "file", "left_semi")
    schema = "file string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return raw.mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str | None = None, min_dedup_bytes: int = 0) -> DataFrame:
    """Writes all pages and reads the archives back."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    write_archives(pages, folder, min_dedup_bytes).write.parquet(f"{folder}/_files")
    files = spark.read.schema("file string, records long").parquet(f"{folder}/_files")
    return read_archives(spark, folder, files)

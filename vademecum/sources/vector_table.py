"""A Parquet table of points that loads change by small deltas, with a log of commits.

Every load writes one segment: its new and changed points, and a tombstone for each pruned one, so its cost follows what
changes and not the table. A commit is a file in the log, named by its version and made only if no one else has made it;
it lists the live segments, oldest first, and the last batch of each stream. A load that finds its version taken computes
its differences anew against the state that won, so concurrent loads lose nothing. Readers take the newest entry and see
one whole state: of every point the row of its newest segment, found by anti-joins with the ids of newer segments only.

Compaction merges a run of the newest segments once they are many, in tiers that at least double, so that a row is
rewritten a logarithmic number of times; its files are cut by ranges of ids and by a number of rows. ``vacuum`` removes
what only old versions name.

The log needs a file system that creates a file only once: hard links on local and mounted disks, renames without
overwriting elsewhere (HDFS has them; a plain object store does not).
"""

from __future__ import annotations

import json
import random
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vademecum import schemas
from vademecum.operators import loading
from vademecum.sources.tables import rewritten

#: Tries of a commit before a load gives up; ids that are broadcast at most, by the counts in the log.
ATTEMPTS, BROADCAST_IDS = 20, 200_000
_SEGMENT = f"{schemas.VECTORS}, deleted boolean"


@dataclass(frozen=True)
class Segment:
    folder: str
    rows: int


@dataclass(frozen=True)
class State:
    """What a version of the table is made of."""

    version: int = 0
    segments: tuple[Segment, ...] = ()
    streams: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "segments": [[s.folder, s.rows] for s in self.segments], "streams": self.streams})

    @staticmethod
    def from_json(text: str) -> State:
        raw = json.loads(text)
        return State(raw["version"], tuple(Segment(*s) for s in raw["segments"]), raw["streams"])


class _Files:
    """The few file operations of the log, on any Hadoop file system."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def at(self, path: str):
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.conf), target

    def listed(self, path: str) -> dict[str, int]:
        """Names in a folder with their time of change in milliseconds; none if there is no such folder."""
        system, target = self.at(path)
        if not system.exists(target):
            return {}
        return {x.getPath().getName(): x.getModificationTime() for x in system.listStatus(target)}

    def text(self, path: str) -> str:
        system, target = self.at(path)
        stream = system.open(target)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, path: str) -> None:
        system, target = self.at(path)
        system.delete(target, True)

    def created(self, path: str, text: str) -> bool:
        """Makes a file with all its text at once, unless there is one."""
        system, target = self.at(path)
        draft = self.jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
        stream = system.create(draft)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        try:
            if system.getUri().getScheme() == "file":
                local = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(target), local(draft))
            else:
                options = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(draft, target, options)
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            return False
        finally:
            system.delete(draft, False)
        return True


class VectorTable:
    """``most_segments``: live segments before a load compacts; ``file_rows``: rows of a file at most, about."""

    def __init__(self, spark: SparkSession, path: str, most_segments: int = 8, file_rows: int = 1_000_000) -> None:
        self.spark, self.path, self.most_segments, self.file_rows = spark, path.rstrip("/"), most_segments, file_rows
        self.files = _Files(spark)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.listed(f"{self.path}/log") if re.fullmatch(r"\d{20}\.json", n))

    def state(self, version: int | None = None) -> State:
        """The newest state, or that of a version that the log still has."""
        known = self.versions()
        if version is None and not known:
            return State()
        return State.from_json(self.files.text(self._entry(known[-1] if version is None else version)))

    def _entry(self, version: int) -> str:
        return f"{self.path}/log/{version:020d}.json"

    def _commit(self, state: State) -> bool:
        return self.files.created(self._entry(state.version), state.to_json())

    def _segment(self, segment: Segment) -> DataFrame:
        return self.spark.read.schema(_SEGMENT).parquet(f"{self.path}/data/{segment.folder}")

    def _newest(self, segments: tuple[Segment, ...], columns: list[str], deleted: bool = False) -> DataFrame:
        """Of every point the row of its newest segment; tombstones only if asked for. Older segments are held against
        the ids of newer ones, never moved for one another where these are few."""
        out, newer, n = self.spark.createDataFrame([], _SEGMENT).select(*columns, *(["deleted"] if deleted else [])), None, 0
        for segment in reversed(segments):
            rows = self._segment(segment)
            live = rows if deleted else rows.where("NOT deleted")
            if newer is not None:
                live = live.join(F.broadcast(newer) if n <= BROADCAST_IDS else newer, "point_id", "left_anti")
            out = out.unionByName(live.select(*out.columns))
            ids = rows.select("point_id")
            newer, n = ids if newer is None else newer.unionByName(ids), n + segment.rows
        return out

    def read(self, version: int | None = None) -> DataFrame:
        columns = [f.name for f in self.spark.createDataFrame([], schemas.VECTORS).schema]
        return self._newest(self.state(version).segments, columns)

    def hashes(self) -> DataFrame:
        """point_id and content_hash of the stored points; nothing else is read."""
        return loading.existing_hashes(self._newest(self.state().segments, ["point_id", "content_hash"]))

    def _write(self, rows: DataFrame, n: int, label: str) -> Segment:
        """Writes n rows as a new segment; files are ranges of ids of at most file_rows rows, about."""
        folder = f"{label}-{uuid.uuid4().hex[:16]}"
        files = -(-n // self.file_rows)
        dealt = rows.repartition(1) if files <= 1 else rows.repartitionByRange(files, "point_id")
        dealt.sortWithinPartitions("point_id").write.parquet(f"{self.path}/data/{folder}")
        return Segment(folder, n)

    def load(self, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], prune: bool = True, batch: tuple[str, int] | None = None) -> DataFrame:
        """Brings the table in step with the chunks; returns the report. ``embed`` adds ``vector`` and only sees new and
        changed rows. ``batch`` names a stream and the number of its batch: one that the log knows is answered from the
        log alone, with a report of zeros."""
        for attempt in range(ATTEMPTS):
            state = self.state()
            if batch and state.streams.get(batch[0], -1) >= batch[1]:
                return self.spark.createDataFrame([(0, 0, 0)], "upserted bigint, skipped bigint, pruned bigint")
            desired, existing = loading.keyed(chunks), self._newest(state.segments, ["point_id", "content_hash"])
            loading.check(desired, existing, prune)
            todo = rewritten(loading.actions(desired, existing, prune), "actions")
            report = loading.load_report(todo)
            upserted, _, pruned = report.first()
            streams = state.streams | ({batch[0]: batch[1]} if batch else {})
            segment = self._delta(desired, embed, todo, upserted + pruned) if upserted + pruned else None
            if segment is None and streams == state.streams:
                return report
            if self._commit(State(state.version + 1, (*state.segments, *([segment] if segment else [])), streams)):
                if len(state.segments) >= self.most_segments:
                    self.compact()
                return report
            if segment:
                self.files.remove(f"{self.path}/data/{segment.folder}")
            time.sleep(random.random() * 0.1 * (attempt + 1))
        raise RuntimeError(f"{self.path}: other loads were faster {ATTEMPTS} times")

    def _delta(self, desired: DataFrame, embed: Callable[[DataFrame], DataFrame], todo: DataFrame, n: int) -> Segment:
        changed = embed(desired.join(todo.where("action = 'upsert'").select("point_id"), "point_id", "left_semi"))
        gone = todo.where("action = 'prune'").select("point_id", F.lit(True).alias("deleted"))
        rows = self.spark.createDataFrame([], _SEGMENT).unionByName(changed.withColumn("deleted", F.lit(False)).select(*self._names()))
        return self._write(rows.unionByName(gone, allowMissingColumns=True), n, "delta")

    def _names(self) -> list[str]:
        return [f.name for f in self.spark.createDataFrame([], _SEGMENT).schema]

    def compact(self, everything: bool = False) -> bool:
        """Merges the newest segments, as far back as the next older one isn't more than twice what is merged; with
        ``everything`` all of them. Tombstones go once nothing older is left. Loads may commit meanwhile."""
        state = self.state()
        if len(state.segments) < 2 and not everything or not state.segments:
            return False
        start = len(state.segments) - 1
        total = state.segments[start].rows
        while start and (everything or start > len(state.segments) - 2 or state.segments[start - 1].rows <= 2 * total):
            start -= 1
            total += state.segments[start].rows
        run = state.segments[start:]
        rows = self._newest(run, self._names()[:-1], deleted=True)
        rows = rows if start else rows.where("NOT deleted")
        n = rows.select("point_id").count()
        merged = (self._write(rows, n, "merged"),) if n else ()
        for attempt in range(ATTEMPTS):
            now = self.state()
            if now.segments[start : start + len(run)] != run:
                break
            kept = (*now.segments[:start], *merged, *now.segments[start + len(run) :])
            if self._commit(replace(now, version=now.version + 1, segments=kept)):
                return True
            time.sleep(random.random() * 0.1 * (attempt + 1))
        for segment in merged:
            self.files.remove(f"{self.path}/data/{segment.folder}")
        return False

    def vacuum(self, keep: int = 2, older_than_s: float = 86_400) -> list[str]:
        """Removes all log entries but the newest ``keep``, and the segments that none of these names and that no one has
        changed for ``older_than_s`` seconds: loads that are under way keep theirs. Returns the removed segments."""
        versions = self.versions()
        named = {s.folder for v in versions[-keep:] for s in self.state(v).segments}
        for version in versions[:-keep]:
            self.files.remove(self._entry(version))
        limit = (time.time() - older_than_s) * 1000
        gone = sorted(n for n, changed in self.files.listed(f"{self.path}/data").items() if n not in named and changed <= limit)
        for name in gone:
            self.files.remove(f"{self.path}/data/{name}")
        return gone

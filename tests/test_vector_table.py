"""The vector table's log: deltas, concurrent loads, compaction, removal, batches of a stream."""

import os
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from vademecum.sources import tables
from vademecum.sources.vector_table import State, VectorTable

CHUNK = "drug_name string, section_type string, species array<string>, book_page int, text string, ordinal int"


def chunks(spark, texts):
    """A chunk per (ordinal, text)."""
    return spark.createDataFrame([("Drug", "doses", ["dog"], 1, t, i) for i, t in texts.items()], CHUNK)


def embed(rows):
    return rows.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))


@pytest.fixture
def store(spark):
    return VectorTable(spark, tables.scratch(spark, "t"), most_segments=3)


def texts(store, version=None):
    return {int(r.logical_key.rsplit("|", 1)[1]): r.text for r in store.read(version).collect()}


def local(path):
    return path.removeprefix("file://")


def test_a_small_load_writes_one_small_file(spark, store):
    many = {i: f"text {i}" for i in range(300)}
    assert tuple(store.load(chunks(spark, many), embed).first()) == (300, 0, 0)
    assert tuple(store.load(chunks(spark, many | {7: "new"}), embed).first()) == (1, 299, 0)
    state = store.state()
    assert [s.rows for s in state.segments] == [300, 1]
    files = [f for f in os.listdir(f"{local(store.path)}/data/{state.segments[1].folder}") if f.endswith(".parquet")]
    assert len(files) == 1
    assert texts(store) == many | {7: "new"} and texts(store, 1) == many
    assert tuple(store.load(chunks(spark, many | {7: "new"}), embed).first()) == (0, 300, 0)
    assert store.state() == state


def test_tombstones_and_rows_that_come_back(spark, store):
    for wanted in ({0: "a", 1: "b"}, {0: "a"}, {0: "a", 1: "again", 2: "c"}, {2: "c"}, {}):
        if wanted:
            store.load(chunks(spark, wanted), embed)
            assert texts(store) == wanted
        else:
            with pytest.raises(ValueError, match="prune"):
                store.load(chunks(spark, {}), embed)
    assert {r.point_id for r in store.hashes().collect()} == {r.point_id for r in store.read().collect()}
    store.compact(everything=True)
    assert texts(store) == {2: "c"} and [s.rows for s in store.state().segments] == [1]


def test_concurrent_loads_lose_nothing(spark, store):
    store.load(chunks(spark, {0: "base"}), embed)
    together = threading.Barrier(3)
    committing = VectorTable._commit

    def commit(self, state):
        """All three try the same version at once."""
        if state.version == 2:
            together.wait(60)
        return committing(self, state)

    def load(i):
        own = VectorTable(spark, store.path, most_segments=3)
        own._commit = lambda state: commit(own, state)
        return tuple(own.load(chunks(spark, {i: f"text {i}", 9: f"by {i}"}), embed, prune=False).first())

    with ThreadPoolExecutor(3) as pool:
        reports = list(pool.map(load, (1, 2, 3)))
    assert reports == [(2, 0, 0)] * 3
    found = texts(store)
    assert found.pop(9) in {"by 1", "by 2", "by 3"}
    assert found == {0: "base", 1: "text 1", 2: "text 2", 3: "text 3"}
    assert store.versions()[:4] == [1, 2, 3, 4]
    named = {s.folder for v in store.versions() for s in store.state(v).segments}
    assert set(os.listdir(f"{local(store.path)}/data")) == named


def test_an_entry_is_made_once(spark, store):
    assert store._commit(State(1)) and not store._commit(State(1, (), {"other": 1}))
    assert store.state() == State(1)
    assert [n for n in os.listdir(f"{local(store.path)}/log") if not n.endswith(".crc")] == [f"{1:020d}.json"]


def test_compaction_in_tiers(spark, store):
    base = {i: f"text {i}" for i in range(200)}
    store.load(chunks(spark, base), embed)
    for i in range(6):
        store.load(chunks(spark, {1000 + i: "x", i: f"changed {i}"}), embed, prune=False)
    segments = store.state().segments
    assert len(segments) <= 4 and segments[0].rows == 200  # the base isn't written again for a few rows
    want = base | {1000 + i: "x" for i in range(6)} | {i: f"changed {i}" for i in range(6)}
    assert texts(store) == want
    cut = VectorTable(spark, store.path, file_rows=50)
    assert cut.compact(everything=True)
    (one,) = cut.state().segments
    assert one.rows == 206
    assert 4 <= len([f for f in os.listdir(f"{local(store.path)}/data/{one.folder}") if f.endswith(".parquet")]) <= 5
    assert texts(store) == want


def test_compaction_beside_a_load(spark, store):
    store.load(chunks(spark, {0: "a"}), embed)
    store.load(chunks(spark, {1: "b"}), embed, prune=False)
    writing = store._write

    def write(rows, n, label):
        VectorTable(spark, store.path).load(chunks(spark, {0: "newer"}), embed, prune=False)
        return writing(rows, n, label)

    store._write = write
    assert store.compact()
    assert [s.rows for s in store.state().segments] == [2, 1] and texts(store) == {0: "newer", 1: "b"}


def test_vacuum(spark, store):
    for i in range(4):
        store.load(chunks(spark, {0: f"text {i}"}), embed)
    store.compact(everything=True)
    assert store.vacuum() == []  # too young
    gone = store.vacuum(keep=1, older_than_s=0)
    assert gone and store.versions() == [store.state().version] and texts(store) == {0: "text 3"}
    assert set(os.listdir(f"{local(store.path)}/data")) == {s.folder for s in store.state().segments}
    store.load(chunks(spark, {0: "on"}), embed)
    assert texts(store) == {0: "on"}


def test_a_repeated_batch_reads_no_rows(spark, store):
    first = store.load(chunks(spark, {0: "a", 1: "b"}), embed, prune=False, batch=("s", 0))
    assert tuple(first.first()) == (2, 0, 0)
    data = f"{local(store.path)}/data"
    os.rename(data, data + "-away")
    try:
        assert tuple(store.load(chunks(spark, {0: "a", 1: "b"}), embed, prune=False, batch=("s", 0)).first()) == (0, 0, 0)
    finally:
        os.rename(data + "-away", data)
    assert store.state().version == 1
    store.load(chunks(spark, {0: "a"}), embed, prune=False, batch=("s", 1))
    assert store.state().streams == {"s": 1} and len(store.state().segments) == 1
    assert tuple(store.load(chunks(spark, {0: "z"}), embed, prune=False, batch=("other", 0)).first()) == (1, 0, 0)
    assert texts(store) == {0: "z", 1: "b"}


def test_tidy_job(spark, store, capsys):
    from vademecum.jobs import run

    for i in range(3):
        store.load(chunks(spark, {0: f"text {i}", i: "x"}), embed, prune=False)
    os.rename(local(store.path), local(store.path) + "__hash")
    run.main(["tidy", "--table", store.path, "--everything", "--keep", "1"])
    tidy = VectorTable(spark, store.path + "__hash")
    assert len(tidy.state().segments) == 1 and tidy.versions() == [4] and texts(tidy)[0] == "text 2"
    assert "removed 0" in capsys.readouterr().out  # a day old at least

"""Near-duplicates by MinHash with odd sketches.

A document's set holds its distinct five-word shingles after lower-casing A-Z (the whole word sequence if it has fewer
words; nothing without words). Two documents are linked if the Jaccard similarity of their sets is at least 0.75; a
component is what links join, and one document of each stays.

1. Each text gives 128 MinHash values, from them 32 band keys of four values and an odd sketch: a 512-bit map in which
   every MinHash value flips one bit. The bits in which two maps differ tell how many MinHash values differ, most
   precisely where similarities are high. Documents with equal sets are one representative from here on.
2. Two representatives meet if they share a band key (a pair at 0.75 misses all 32 with probability 5e-6). Only pairs
   whose sketches estimate at least ``NEAR`` count (five standard errors below 0.75). Every member of a bucket is first
   compared with its hub, the smallest member; only members unlike their hub are compared with the rest of the bucket.
   Representatives with a partner are looked at further, and only their sets are gathered.
3. Star round: members are compared with their hub on the full sets. That joins most copies without ever listing the
   pairs of a group.
4. Block round: in buckets that still hold several components, the members outside the largest one are compared with all
   others on the full sets, skipping pairs already joined; a block returns the links of a spanning forest.

A group of copies is thus never expanded into pairs, and no bucket is collected whole: members are dealt to chunks of
bounded numbers and sizes, and each task holds two chunks. Where more than ``CROWD`` members of a bucket are unlike its
hub (they share a passage, not their texts), its members meet by their rarest shingles instead: two sets at 0.75 or more
always share one of the rarest quarter of either, so no link of the bucket is lost.

Nulls, empty texts, repeated rows and rows without an id: see ``groups``. Columns other than doc_id and text don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vademecum.llm.components import components
from vademecum.llm.shared import column_of, key_groups, slices, written
from vademecum.llm.words import WordHashes, hash_words, mix64, window_hashes

SHINGLE = 5
SAMPLES, ROWS = 128, 4
BANDS = SAMPLES // ROWS
SKETCH_BITS = 512
NEAR = 0.5
#: Members of a chunk, shingles of its sets, and members unlike their hub from which a bucket is parted.
CHUNK, CHUNK_SHINGLES, CROWD = 512, 2_000_000, 4096
#: Cells in which the shingles of crowded buckets are counted to tell rare ones. Any counts lose no link.
CELLS = 1 << 17
#: Ids up to which they are sent to all tasks, 8 bytes each, so that texts stay where they are.
FEW_IDS = 500_000
_random = np.random.default_rng(20)
_FACTORS = _random.integers(0, 1 << 62, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_SLOTS = np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], memo: WordHashes) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    words, offsets = hash_words(texts, memo, lower=True)
    windows = window_hashes(words, SHINGLE)
    out = []
    for begin, end in zip(offsets[:-1], offsets[1:], strict=True):
        if end - begin >= SHINGLE:
            out.append(np.unique(windows[begin : end - SHINGLE + 1]))
        elif end > begin:
            out.append(window_hashes(words[begin:end], int(end - begin)) ^ np.uint64(end - begin))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima over the set; the set isn't empty."""
    least = None
    for k in range(0, len(shingles), 1024):
        part = ((shingles[k : k + 1024, None] ^ _SHIFTS) * _FACTORS).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key per band; equal only if all of the band's samples are equal (up to 64-bit hashing)."""
    rows = samples.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(ROWS):
        key = mix64(key ^ rows[:, k])
    return key.astype(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The bits that an odd number of samples fall on, as eight 64-bit words."""
    bits = np.bincount((mix64(samples ^ _SLOTS) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities that odd sketches (last axis: eight words) estimate."""
    differ = np.bitwise_count(a ^ b).sum(axis=-1)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * differ / SKETCH_BITS, 1e-9))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sets (sorted, distinct) reach the threshold: 100 * intersection >= 75 * union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < 75 * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= 75 * (len(a) + len(b) - common)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (two 64-bit sums over the set), bands and sketch of every row; null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in slices(batches):
            keys, bands, sketches, sizes = [], [], [], []
            for own in shingle_sets(column_of(batch, "text"), memo):
                sizes.append(len(own))
                if not len(own):
                    keys.append(None), bands.append(None), sketches.append(None)
                    continue
                samples = minhash(own)
                mixed = mix64(own)
                keys.append(np.array([own.sum(), (mixed * (mixed | np.uint64(1))).sum(), len(own)], np.uint64).tobytes())
                bands.append(band_keys(samples))
                sketches.append(odd_sketch(samples).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "bands", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary")


def _bucket_members(reps: DataFrame) -> DataFrame:
    """key, hub, n, id for every representative in a bucket of at least two; hub is the bucket's smallest id."""
    rows = reps.select("id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(buckets, "key").select("key", "hub", "n", "id")


def _blocks(members: DataFrame) -> DataFrame:
    """Sends the members of each bucket (key, id, size, rest) to the blocks (x, y) in which each of its members meets
    each of those with ``rest``, but for buckets without any; role 1 is that of the latter.

    Both are dealt to chunks of about CHUNK members and CHUNK_SHINGLES shingles, so of n members and f with rest,
    n * f / CHUNK rows of either role are made.
    """
    chunks = lambda n, size: F.greatest(F.ceil(n / CHUNK), F.ceil(size / CHUNK_SHINGLES)).cast("int")
    rest = F.col("rest").cast("int")
    sizes = members.groupBy("key").agg(
        chunks(F.count(F.lit(1)), F.sum("size")).alias("chunks"), F.sum(rest).alias("f"), F.sum(rest * F.col("size")).alias("rest_size"), F.count(F.lit(1)).alias("n"),
    )
    sizes = sizes.where("f > 0 AND n > 1").select("key", "chunks", chunks(F.col("f"), F.col("rest_size")).alias("rest_chunks"))
    dealt = members.join(sizes, "key")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    at = lambda x, y, role: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(role).alias("role"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    every = F.transform(upto("rest_chunks"), lambda y: at(place("chunks"), y, 0))
    asking = F.transform(upto("chunks"), lambda x: at(x, place("rest_chunks"), 1))
    kept = [c for c in members.columns if c != "rest"]
    dealt = dealt.select(*kept, F.explode(F.when(F.col("rest"), F.concat(every, asking)).otherwise(every)).alias("at"))
    return dealt.select(*kept, "at.x", "at.y", "at.role")


def _by_block(rows: DataFrame) -> DataFrame:
    keys = ["key", "x", "y"]
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _sketches(rows: list[tuple], at: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[at] for r in rows), np.uint64).reshape(len(rows), -1)


def _near_hubs(members: DataFrame, reps: DataFrame, hub: str = "hub") -> DataFrame:
    """The members (but for hubs) with near: whether their sketch and the hub's estimate at least NEAR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(estimated(a, b) >= NEAR)], [*batch.schema.names[2:], "near"])

    rows = members.where(F.col("id") != F.col(hub))
    own = rows.join(reps.select("id", F.col("sketch").alias("_own")), "id")
    both = own.join(reps.select(F.col("id").alias(hub), F.col("sketch").alias("_hub")), hub).select("_own", "_hub", *members.columns)
    return both.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema) + ", near boolean")


def _partners(unlike: DataFrame) -> DataFrame:
    """The ids that have a partner in some bucket of ``unlike`` (key, id, size, rest, sketch): a member and one with
    ``rest`` whose sketches estimate at least NEAR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[int] = set()
        for _, rows in key_groups(batches, ["key", "x", "y"]):
            every, asking = ([r for r in rows if r[3] == role] for role in (0, 1))
            if not every or not asking:
                continue
            words, ids = _sketches(every, 5), np.array([r[4] for r in every])
            for r in asking:
                near = (estimated(words, np.frombuffer(r[5], np.uint64)) >= NEAR) & (ids != r[4])
                if near.any():
                    found.add(r[4])
                    found.update(ids[near].tolist())
            if len(found) > 100_000:
                yield pa.RecordBatch.from_pydict({"id": pa.array(sorted(found), pa.int64())})
                found.clear()
        yield pa.RecordBatch.from_pydict({"id": pa.array(sorted(found), pa.int64())})

    rows = _by_block(_blocks(unlike)).select("key", "x", "y", "role", "id", "sketch")
    return rows.mapInArrow(run, "id long").distinct()


def rarest(own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set by which it meets all sets linked with it, the rarest by ``counts`` of cells, and which of
    these are ``early``.

    Linked sets share 75 of 100 shingles of the larger and 6 of 7 of the smaller one, at least. So the first shingle that
    both have, in an order that is the same for all, is among the first 25 of 100 of either and the first 7th, early, of
    the smaller one (and one more each).
    """
    n = len(own)
    order = np.argsort(counts[(own % np.uint64(CELLS)).astype(np.int64)], kind="stable")  # ties by the shingle: sets are sorted
    first = own[order[: n - -(-75 * n // 100) + 1]]
    return first, np.arange(len(first)) < n - -(-6 * n // 7) + 1


def _rarest_keys(sets: DataFrame) -> DataFrame:
    """key, id and early of the rarest shingles of each set (id, shingles)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for batch in slices(batches):
            for own in column_of(batch, "shingles"):
                n += np.bincount((np.frombuffer(own, np.uint64) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met])], ["cell", "n"])

    found = sets.select("shingles").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS rows
    counts = np.zeros(CELLS, np.int64)
    counts[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, early = zip(*[rarest(np.frombuffer(own, np.uint64), shared.value) for own in column_of(batch, "shingles")], strict=True)
            ids = np.repeat(np.array(column_of(batch, "id"), np.int64), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(ids), pa.array(np.concatenate(early))], ["key", "id", "early"])

    return sets.select("id", "shingles").mapInArrow(run, "key long, id long, early boolean")


def _parted(marked: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The buckets (key, id, rest) with at most CROWD members that are unlike their hub, and in place of the others their
    members by their rarest shingles. ``sets_of`` gives the sets of some ids.

    Members that are alike in all crowded buckets they share have met already, so one with ``rest`` in any of them keeps
    it. A shingle that isn't early in any set makes no link.
    """
    crowded = marked.groupBy("key").agg(F.count_if("rest").alias("f")).where(F.col("f") > CROWD).select("key")
    if crowded.isEmpty():
        return marked
    small = marked.join(crowded, "key", "left_anti")
    members = written(marked.join(crowded, "key", "left_semi").groupBy("id").agg(F.max("rest").alias("rest")), "crowd")
    rows = written(_rarest_keys(written(sets_of(members.select("id")), "crowd-sets")).join(members, "id"), "rarest")
    met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("rest").alias("any_rest"), F.max("early").alias("any_early"))
    return small.unionByName(rows.join(met.where("n > 1 AND any_rest AND any_early").select("key"), "key", "left_semi").select("key", "id", "rest"))


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The full sets (sorted hashes as bytes) of the documents with these ids; one row per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in slices(batches):
            own = [s.tobytes() for s in shingle_sets(column_of(batch, "text"), memo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["id", "shingles"])

    few = ids.count() <= FEW_IDS
    wanted = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return wanted.mapInArrow(run, "id long, shingles binary")


def _star_links(near: DataFrame, sets: DataFrame, hub: str = "hub") -> DataFrame:
    """Links (a, b) between members and their hub, confirmed on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            left, right = column_of(batch, "left"), column_of(batch, "right")
            good = [linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    pairs = near.select(F.col(hub).alias("a"), F.col("id").alias("b")).distinct()
    right = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
    both = right.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that join the components in each block, confirmed on the full sets; a spanning forest of each block.

    ``members`` has key, id, size, rest, sketch and component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in key_groups(batches, ["key", "x", "y"]):
            every, asking = ([r for r in rows if r[3] == role] for role in (0, 1))
            if not every or not asking:
                continue
            # components as they are in this block: of all rows, since joining two changes both roles
            component = np.array([r[6] for r in every + asking])
            words, full = _sketches(every, 5), [np.frombuffer(r[7], np.uint64) for r in every]
            a, b = [], []
            for k, r in enumerate(asking, len(every)):
                own = np.frombuffer(r[7], np.uint64)
                near = estimated(words, np.frombuffer(r[5], np.uint64)) >= NEAR
                for j in np.flatnonzero(near & (component[: len(every)] != component[k])):
                    if component[j] != component[k] and linked(own, full[j]):
                        a.append(r[4]), b.append(every[j][4])
                        component[component == component[j]] = component[k]
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = _by_block(_blocks(members).join(sets, "id"))
    return rows.select("key", "x", "y", "role", "id", "sketch", "component", "shingles").mapInArrow(run, "a long, b long")


def _still_open(members: DataFrame, label: DataFrame) -> DataFrame:
    """The members (key, id) with their component, of buckets that hold several components, and rest: whether a member
    is outside the bucket's most frequent component."""
    tagged = members.select("key", "id").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    counts = tagged.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    main = counts.groupBy("key").agg(F.max(F.struct("m", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return tagged.join(main.select("key", F.col("main.component").alias("_main")), "key").select("key", "id", "component", (F.col("component") != F.col("_main")).alias("rest"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Null and wordless texts have an empty set, are linked with nothing and stay. component_id is the smallest doc_id
    reachable, the own one included. Rows without a doc_id stay by themselves with a null component_id. Of several rows
    with one doc_id and equal sets all are kept or dropped together; different texts under one doc_id are undefined.
    """
    rows = written(features(docs), "features")
    known = rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    reps = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "bands", "sketch", "n_shingles")).alias("r"))
    reps = written(reps.select("set_key", F.col("r.doc_id").alias("id"), "r.bands", "r.sketch", F.col("r.n_shingles").alias("size")), "representatives")
    sized = reps.select("id", "sketch", "size")
    starred = written(_near_hubs(_bucket_members(reps), reps), "starred")
    near = starred.where("near")
    # members unlike their hub meet the rest of their bucket; the only pair of a bucket of two is done
    unlike = starred.where("NOT near AND n > 2").select("key", "hub").distinct()
    marked = starred.join(unlike.select("key"), "key", "left_semi").select("key", "id", (~F.col("near")).alias("rest"))
    marked = marked.unionByName(unlike.select("key", F.col("hub").alias("id"), F.lit(False).alias("rest")))
    marked = _parted(marked, lambda ids: _sets(docs, ids).dropDuplicates(["id"]))
    involved = _partners(marked.join(sized, "id")).union(near.select("id")).union(near.select("hub")).distinct()
    involved = written(involved, "involved")
    sets = written(_sets(docs, involved).dropDuplicates(["id"]), "sets")
    hubs = starred.select("key", F.col("hub").alias("id")).distinct()
    members = written(starred.select("key", "id").unionByName(hubs).join(sets.select("id"), "id", "left_semi"), "members")
    links = written(_star_links(near, sets), "links")
    label = components(links)
    marked = _still_open(members, label)
    marked = _parted(marked.select("key", "id", "rest"), lambda ids: sets.join(ids, "id", "left_semi"))
    parted = marked.join(sized, "id").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    stars = label.where("component <> id").select(F.col("component").alias("a"), F.col("id").alias("b"))
    final = components(stars.union(_block_links(written(parted, "open"), sets)))
    by_set = reps.select("set_key", "id").join(final, "id", "left").select("set_key", F.coalesce("component", "id").alias("_component"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")
    out = rows.select("doc_id", "n_shingles", own).join(by_set, "set_key", "left")
    component = F.coalesce("_component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

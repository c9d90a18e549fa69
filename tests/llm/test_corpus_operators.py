"""Near-duplicates, archives, shards, search and the pipeline on small awkward tables."""

import base64
import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same, connect
from vademecum.llm import bin_packing, components, hilbert, impact_topk, near_duplicates, queries, warc
from vademecum.llm.shared import new_folder


def brute_groups(rows):
    sets, inverted = {}, collections.defaultdict(list)
    for key, text in rows:
        words = (text or "").encode().lower().split()
        sets[key] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
        for s in sets[key]:
            inverted[s].append(key)
    common = collections.Counter()
    for keys in inverted.values():
        for i, a in enumerate(keys):
            for b in keys[:i]:
                common[min(a, b), max(a, b)] += 1
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in sets}


def family(rng, size, words, edits, first):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    for i in range(size):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield first + i, " ".join(own)


@pytest.mark.parametrize("crowd", [5, 4096])
def test_groups_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_duplicates, "CHUNK", 16)  # so that large buckets are cut into blocks here too
    monkeypatch.setattr(near_duplicates, "CROWD", crowd)  # and parted
    monkeypatch.setattr(near_duplicates, "FEW_IDS", crowd * 100)
    rng = random.Random(4)
    rows = [(1000 + i, " ".join(f"w{rng.randrange(500)}" for _ in range(40))) for i in range(60)]
    rows += [*family(rng, 70, 120, 8, 0), *family(rng, 40, 60, 3, 200), *family(rng, 30, 300, 25, 300)]
    passage = " ".join(f"p{k}" for k in range(90))  # many texts share it and little else
    rows += [(2000 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))) for i in range(60)]
    rows += [(400 + i, "exact copy of one short text here") for i in range(20)] + [(500, "two words"), (501, "Two WORDS"), (502, "two words more")]
    rows += [(600, ""), (601, None), (602, " \n ")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_groups(rows)


@pytest.mark.parametrize("crowd", [5, 4096])
def test_crowded_bucket_loses_no_link(spark, monkeypatch, crowd):
    """Linked texts that share one crowded bucket and no other band are linked all the same."""

    def keys(samples):
        own = int(samples.sum() >> np.uint64(8))
        return np.array([7, *(own + k for k in range(1, near_duplicates.BANDS))], np.int64)

    monkeypatch.setattr(near_duplicates, "band_keys", keys)
    monkeypatch.setattr(near_duplicates, "CHUNK", 16)
    monkeypatch.setattr(near_duplicates, "CROWD", crowd)
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))) for i in range(30)]
    for k in range(12):  # pairs at and around the threshold
        words = [f"r{k}x{j}" for j in range(104)]
        rows += [(100 + 2 * k, " ".join(words)), (101 + 2 * k, " ".join(words[: 76 + k]) + f" y{k} z{k}")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = brute_groups(rows)
    assert got == want and 6 < sum(c != i for i, (_, c) in want.items()) < 12


def test_rarest_shingles_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 9, near_duplicates.CELLS)
    for _ in range(3000):
        pool = rng.integers(0, 1 << 63, 2 * rng.integers(2, 60), dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool[: max(2, int(len(pool) * rng.uniform(0.5, 1)))], len(pool))) for _ in range(2))
        if near_duplicates.linked(a, b):
            (x, early_x), (y, early_y) = near_duplicates.rarest(a, counts), near_duplicates.rarest(b, counts)
            both = np.intersect1d(x, y)
            assert len(both) and (np.isin(both, x[early_x]) | np.isin(both, y[early_y])).any()


def test_groups_edges(spark):
    schema = "text string, doc_id long, lang string, component_id int"
    assert near_duplicates.groups(spark.createDataFrame([], schema)).count() == 0
    rows = [("a b c d e f", 1, "en", 0), ("a b c d e f", 1, "en", 0), ("a b c d e f", None, "en", 0), (None, None, None, None)]
    got = near_duplicates.groups(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and all(r.kept for r in got)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(1, 1), (1, 1)]
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for share in (0.75, 0.85, 0.95):
        for _ in range(20):
            shared = rng.integers(0, 1 << 62, int(1000 * share), dtype=np.uint64)
            rest = lambda: rng.integers(0, 1 << 62, int(500 * (1 - share)), dtype=np.uint64)
            a, b = (near_duplicates.odd_sketch(near_duplicates.minhash(np.concatenate([shared, rest()]))) for _ in range(2))
            errors.append(near_duplicates.estimated(a, b) - share)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7), (200, 199), (None, 3)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 103: 100, 105: 100, 199: 199, 200: 199}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGES = [(5, "http://a/ü x", "same"), (3, None, "same"), (9, "http://b\r\nEvil: 1", "same"), (1, "u", None), (2, "u", ""), (4, "u", "ünï" * 5000), (None, "u", "lonely"), (8, "u", "lone\r\n\r\nly")]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, "x", b"y") for p in PAGES], "page_id long, url string, html string, payload string, sha1 binary").drop("payload", "sha1").repartition(2)
    rows = warc.round_trip(df).collect()
    assert len(rows) == len(PAGES)
    by = {r.page_id: r for r in rows}
    for page_id, _, html in PAGES:
        raw = (html or "").encode()
        assert by[page_id].payload_bytes == len(raw)
        assert by[page_id].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert [(by[i].record_type, by[i].refers_to) for i in (3, 5, 9, 1, 2, 4)] == [("response", None), ("revisit", 3), ("revisit", 3), ("response", None), ("revisit", 1), ("response", None)]
    assert by[4].payload.decode() == "ünï" * 5000 and by[5].payload is None
    assert warc.round_trip(df.limit(0)).count() == 0
    assert warc.round_trip(df, min_dedup_bytes=100).where("record_type = 'revisit'").count() == 0


def test_warc_dictionary_and_damage():
    payloads = [f"<html><p>page {i} of the same site</p></html>".encode() * 3 for i in range(300)]
    records = [warc.record_bytes(i, "http://x", p, hashlib.sha1(p).digest(), None) for i, p in enumerate(payloads)]
    archive = warc._Archive(warc._trained(records))
    for r in records:
        archive.add(r)
    raw = archive.out.getvalue()
    assert int.from_bytes(raw[:4], "little") == warc.SKIPPABLE
    assert [r["payload"] for r in warc.parse_archive(raw)] == payloads
    start = warc.dictionary_of(memoryview(raw))[1]
    for bad in (raw[:-3], raw[: start + 10], raw[:start] + b"junk" + raw[start:]):
        with pytest.raises(Exception):  # noqa: B017
            list(warc.parse_archive(bad))
    good = records[0]
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"Content-Length: ", b"Content-Length: 1", 1), good.replace(b"page 0", b"page X"), good.replace(b"WARC-Date", b"Other")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_warc_query_equals_sql(spark, sf_dir):
    assert_same(queries.queries()["op2_warc_zstd"](spark, sf_dir), connect(sf_dir), queries.oracle_sql()["op2_warc_zstd"])


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_is_continuous(spark, dims, bits):
    cells = spark.range(1 << dims * bits)
    axes = [F.shiftright("id", bits * k).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias(f"c{k}") for k in range(dims)]
    rows = cells.select(*axes).select("*", hilbert.hilbert_index([F.col(f"c{k}") for k in range(dims)], bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << dims * bits))
    assert all(sum(abs(a[k] - b[k]) for k in range(dims)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_shards(spark):
    rows = [(i if i % 50 else None, ["x", None, "é", "src0"][min(i % 7, 3)], "en" if i % 3 else None, i * 37 % 101) for i in range(1003)] + [(7, "x", "en", 1)] * 5
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long")
    out = hilbert.shards(df, ["source", "lang", "n_chars"], 8).collect()
    assert sorted(((r.doc_id, r.source, r.lang, r.n_chars) for r in out), key=str) == sorted(rows, key=str)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append((r.slot, r.hilbert))
    sizes = [len(v) for v in slots.values()]
    assert set(slots) == set(range(8)) and max(sizes) - min(sizes) <= 1
    last = -1
    for shard in range(8):
        ordered = sorted(slots[shard])
        assert [s for s, _ in ordered] == list(range(len(ordered)))
        for _, h in ordered:
            assert h >= last
            last = h
    assert hilbert.shards(df.limit(0), ["source", "lang", "n_chars"], 8).count() == 0
    assert hilbert.shards(df.limit(3), ["source"], 8).count() == 3


def test_shard_query_prunes(spark, sf_dir):
    rows = queries.op3_hilbert_shards(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shown = hilbert.manifest(rows.select("doc_id", "shard").join(docs, "doc_id"), ["n_chars", "source"]).collect()
    whole = docs.agg(F.max("n_chars") - F.min("n_chars")).first()[0]
    assert np.mean([r.max_n_chars - r.min_n_chars for r in shown]) < whole
    assert sum(r.rows for r in shown) == docs.count()


def plain_cells(values):
    """Cells of string values by the middle of each value's run in the order of all."""
    known = sorted(v.encode() for v in values if v is not None)
    firsts, at = {}, 0
    for value, n in sorted(collections.Counter(known).items()):
        firsts.setdefault((2 * at + n) * 16 // (2 * len(known)), value)
        at += n
    cuts = [v for cell, v in firsts.items() if cell > 0]
    return {v: sum(v.encode() >= c for c in cuts) if v is not None else 0 for v in set(values)}


def test_shard_query_equals_brute_force(spark, sf_dir):
    import zlib

    import xxhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    source, lang = (plain_cells([r[c] for r in docs]) for c in ("source", "lang"))
    chars = sorted(r.n_chars for r in docs)
    cuts = sorted({chars[-(-k * len(chars) // 16) - 1] for k in range(1, 16)})
    places, following = hilbert.curve_tables(3)
    keyed = []
    for r in docs:
        cells, state, h = (source[r.source], lang[r.lang], sum(r.n_chars >= c for c in cuts)), 0, 0
        for bit in (3, 2, 1, 0):
            corner = sum((c >> bit & 1) << k for k, c in enumerate(cells))
            h, state = h * 8 + places[state * 8 + corner], following[state * 8 + corner]
        spread = xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little", signed=True), 42)
        spread -= (spread >> 63) << 64
        keyed.append((h, (spread >> 40) % 256, spread, r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())))
    want, slots = set(), collections.Counter()
    for rank, (h, _, _, doc_id, size, crc) in enumerate(sorted(keyed)):
        shard = rank * 8 // len(keyed)
        want.add((doc_id, size, crc, "rows", shard, slots[shard], None, h))
        slots[shard] += 1
    got = queries.op3_hilbert_shards(spark, sf_dir).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_strings_with_a_long_common_beginning_are_told_apart(spark):
    rows = [(i, f"https://example.org/common_crawl_{i % 20:02d}", i * 7919 % 1000) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, _part int").repartition(3)
    out = hilbert.shards(df.withColumn("slot", F.lit("x")), ["source", "_part"], 8)
    assert out.columns == ["doc_id", "source", "_part", "hilbert", "shard", "slot"]
    assert {(r.doc_id, r.source, r["_part"]) for r in out.collect()} == set(rows)
    assert max(r.n for r in out.groupBy("shard").agg(F.countDistinct("source").alias("n")).collect()) <= 12
    nulls = spark.createDataFrame([(None, None, 5)] * 40 + [(None, "a", None)] * 40, df.schema)
    assert sorted((r.shard, r.slot) for r in hilbert.shards(nulls, ["source", "_part"], 8).collect()) == [(s, k) for s in range(8) for k in range(10)]


def brute_top(rows, k):
    usable = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in usable:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in usable if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return out


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 16))
    rows = [(i, [float(np.float32(x)) for x in (lambda v: v / np.linalg.norm(v))(centres[i % 6] + rng.normal(size=16) * 0.4)]) for i in range(1500)]
    rows += [(2000 + i, rows[3][1]) for i in range(400)]  # many equal vectors
    rows += [(5000, None), (5050, []), (5100, [1.0, None]), (5150, [float("nan")] * 16), (None, rows[0][1]), (5200, [0.0] * 16), (5250, [1.0, -1.0]), (5251, [0.5, 0.5]), (5300, [1e8] + [0.5] * 15), (5301, [-1e8] + [0.25] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    usable = impact_topk.quantised(df)
    got = [tuple(r)[:4] for r in impact_topk.top_k(usable, usable.where("id % 50 = 0"), 5).collect()]
    assert sorted(got) == sorted(brute_top(rows, 5))
    assert impact_topk.top_k(usable.limit(0), usable.limit(0), 5).count() == 0


def test_small_blocks_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(impact_topk, "INDEX_ROWS", 60)
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(700)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, id string, block int")
    usable = impact_topk.quantised(df)
    out = impact_topk.top_k(usable, usable.where("id % 50 = 0"), 5)
    assert sorted(tuple(r)[:4] for r in out.collect()) == sorted(brute_top([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 5))


def test_clustered_queries_stop_on_proof():
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(20, 32))
    vectors = centres[np.arange(4000) % 20] + rng.normal(size=(4000, 32)) * 0.25
    vectors = np.floor(256 * vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.int64)
    index = impact_topk.ImpactIndex(np.arange(4000), vectors)
    work = []
    for i in range(0, 4000, 97):
        ids, scores, postings, rescored = index.top(vectors[i], i, 5)
        order = sorted((-int(s), j) for j, s in enumerate(vectors @ vectors[i]) if j != i)[:5]
        assert [(-s, j) for s, j in zip(scores.tolist(), ids.tolist(), strict=True)] == order
        work.append((postings, rescored))
    stopped = [p for p, r in work if p < 4000 * 32 and r <= 160]
    assert len(stopped) > 0.8 * len(work)
    assert np.median([r for _, r in work]) <= 160


def test_index_stops_early_only_on_proof():
    rng = np.random.default_rng(9)
    for scale in (1, 40, 256):
        vectors = rng.integers(-scale, scale + 1, (500, 12))
        index = impact_topk.ImpactIndex(rng.permutation(500), vectors)
        for q in rng.integers(-scale, scale + 1, (20, 12)):
            ids, scores, _, _ = index.top(q, 3, 5)
            order = sorted((-int(index.vectors[i] @ q), int(index.ids[i])) for i in range(500) if index.ids[i] != 3)[:5]
            assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)] == order


class Fetched:
    """Vectors that count the rows fetched whole."""

    def __init__(self, vectors):
        self.vectors, self.shape, self.rows = vectors, vectors.shape, 0

    def __getitem__(self, rows):
        self.rows += len(rows)
        return self.vectors[rows]


def test_index_fetches_only_rows_still_possible():
    rng = np.random.default_rng(10)
    vectors = np.floor(256 * (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(2000, 64)))).astype(np.int64)
    index = impact_topk.ImpactIndex(np.arange(2000), vectors)
    index.vectors = Fetched(vectors)
    for i in range(20):
        index.vectors.rows = 0
        ids, scores, _, _ = index.top(vectors[i], i, 5)
        order = sorted((-int(vectors[j] @ vectors[i]), j) for j in range(2000) if j != i)[:5]
        assert [(-s, j) for s, j in zip(scores.tolist(), ids.tolist(), strict=True)] == order
        assert index.vectors.rows <= 160 + 16 * len(impact_topk.LEVELS)


def test_top_k_query_equals_sql(spark, sf_dir):
    assert_same(queries.queries()["op9_impact_topk"](spark, sf_dir), connect(sf_dir), queries.oracle_sql()["op9_impact_topk"])


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    now = docs
    for name, stage in pipeline.STAGES:
        before = now
        stage(spark, now, sf_dir).write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        if name != pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
            assert now.join(before, "doc_id", "left_anti").count() == 0
    kept = spark.read.parquet(f"{folder}/near_duplicates")
    assert 0 < kept.count() < docs.count()
    groups = brute_groups([(r.doc_id, r.text) for r in kept.collect()])
    assert all(component == key for key, (_, component) in groups.items())
    passed = spark.read.parquet(f"{folder}/toxicity")
    left = {c for _, c in brute_groups([(r.doc_id, r.text) for r in passed.collect()]).values()}
    assert left == {r.doc_id for r in kept.collect()}
    assert {r.doc_id for r in now.select("doc_id").distinct().collect()} == left
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_top_k_beyond_64_bits_raises(spark):
    """Entries and scores that don't fit are errors; large ones that fit are exact."""
    frame = lambda rows: impact_topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    fits = frame([(0, [2.0**30, 1.0]), (1, [2.0**15, 3.0]), (2, [2.0**15, 2.0]), (3, [-(2.0**16), 0.0])])
    got = [(r["vec_id"], r["score"]) for r in impact_topk.top_k(fits, fits.where("id = 0"), 5).orderBy("rank").collect()]
    big = 2**38
    assert got == [(1, big * 2**23 + 256 * 768), (2, big * 2**23 + 256 * 512), (3, -big * 2**24)]
    for rows in ([(0, [1e300]), (1, [1.0])], [(0, [7.7e17 / 256]), (1, [1.0e18 / 256])]):
        with pytest.raises(Exception, match="64 bits"):
            table = frame(rows)
            impact_topk.top_k(table, table.where("id = 0"), 5).collect()


def test_pack_keeps_columns_of_any_name(spark):
    rows = [(i % 7 + 1, i, "a", "b", "c", "d", 5, 6) for i in range(60)]
    pieces = spark.createDataFrame(rows, "length long, id long, _unit string, _rank string, _n string, _k0 string, offset int, sequence_id int")
    got = bin_packing.pack(pieces, 8).collect()
    assert {r["_unit"] + r["_rank"] + r["_n"] + r["_k0"] for r in got} == {"abcd"} and len(got[0]) == 8
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 8
    assert sorted(r["id"] for r in got) == list(range(60))


def test_large_records_dont_wait_for_the_dictionary(spark, monkeypatch):
    """What waits for the dictionary is bounded by bytes, and the round trip stays whole."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"{i} " * 700) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    rows = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.round_trip(pages).collect()}
    assert rows == {i: f"{i} " * 700 for i in range(30)}

"""The text operators against brute force and the libraries, on small awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from vademecum.llm import bin_packing, licences, quality, queries, sentencepiece_bpe, simple8b, toxicity
from vademecum.llm.tokenize import TokenIds

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, shard string"
LONG = " ".join(f"word{i % 777} x{i}" for i in range(6000))
ROWS = [
    (1, "The cat sat. On the mat!\nThe cat sat.\nThe cat sat.", "en", "a", 1, "x", "y"),
    (2, "", None, None, None, None, None),
    (3, None, "en", "a", 3, "x", "y"),
    (4, LONG, "de", "b", 4, "x", "y"),
    (5, "été  œuvre\t日本語 😀 ▁x\u0000 \u001c end ", "fr", None, 5, "x", "y"),
    (6, "The cat sat. On the mat!\nThe cat sat.\nThe cat sat.", "en", "a", 1, "x", "y"),
    (6, "The cat sat. On the mat!\nThe cat sat.\nThe cat sat.", "en", "a", 1, "x", "y"),
    (None, "no id here", "en", "a", 1, "x", "y"),
    (-7, "one two three four five six seven eight " * 9, "en", "a", 1, "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(sample=0):
    random.seed(sample)
    pool = ["the ", "ing", "  ", "\n", "\n\n", "été", "日", "😀", "a.b", "'s", " '", "==", "▁", "J̌", "İ", "\t", "<s>", "<|endoftext|>", "<|StartOfText|>", "<|startoftext|>", "\x0b", "\u2028", "\x00", " \n", "12", "é.", "\u001c", "\xa0", "Ab,"]
    return ["".join(random.choice(pool) for _ in range(random.randint(0, 12))) for _ in range(3000)]


def test_sentencepiece_equals_the_library():
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.PieceModel(path)
    for text in [*texts_of(), "a" * 5000, LONG]:
        ids = library.encode(text)
        assert model.encode(text) == ids
        assert model.decode(ids) == library.decode(ids)
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260)]) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)


def test_sentencepiece_columns(docs, empty):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    out = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs, path), path)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "ids", "decoded"]  # a column named ids is replaced
    assert len(rows) == len(ROWS)
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in rows)
    assert sorted(map(str, sentencepiece_bpe.encode_and_decode(docs, path).collect())) == sorted(map(str, rows))
    assert sentencepiece_bpe.decode(sentencepiece_bpe.encode(empty, path), path).count() == 0


def test_full_memo_forgets_without_changing_ids():
    from vademecum.llm.cuts import CutMemo

    memo = CutMemo(lambda cuts: (np.array([ord(x) for c in cuts for x in c]), np.array([len(c) for c in cuts])), most=20)
    rng = random.Random(3)
    for _ in range(200):
        texts = [["".join(rng.choice("abcde") for _ in range(rng.randrange(3))) for _ in range(rng.randrange(6))] for _ in range(5)]
        ids, offsets = memo.encode(texts)
        assert ["".join(map(chr, ids[offsets[k] : offsets[k + 1]])) for k in range(5)] == ["".join(t) for t in texts]
        assert len(memo.index) <= 20 + 31


def test_id_files_ignore_files_of_failed_attempts(docs, spark):
    folder = simple8b.new_folder(spark, "ids")
    path = queries.tokenizer_path("byte_bpe_50k.json")
    first = simple8b.id_files(docs, path, 2, folder).count()
    files = spark.read.schema("file string, docs long, ids long").parquet(f"{folder}/_files")
    simple8b.write_id_files(docs, folder, path, 2).count()  # another attempt leaves files that no manifest names
    rows = simple8b.with_starts(simple8b.read_id_files(spark, folder, files), files)
    assert rows.count() == first == len(ROWS)
    assert rows.where("start IS NULL").count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_bytes_equal_the_library(name):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(name)
    library, model = Tokenizer.from_file(path), TokenIds(path)
    texts = [*texts_of(3), *texts_of(4), LONG, "Plain words, and more words.\nA line; another!"]
    for start in range(0, len(texts), 500):
        part = texts[start : start + 500]
        ids, offsets = model.encode(part)
        for k, text in enumerate(part):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_words_with_tails_of_symbols_equal_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    library, model = Tokenizer.from_file(path), TokenIds(path)
    model.memo.most = 60
    rng = random.Random(8)
    words = ["dog", "Ünder", "a'", "it's", "x1", "12", "日本", "\u01c5", "ɐ", "e\u0301", "a_b", "\u0345", "word", "\u200b"]
    tails = ["", ".", ",", ".&&&", "!!!!!", "'", "'t.", "…", "\x00", "\x7f", "<|", "<|endoftext|>"]
    gaps = [" "] * 8 + ["\n"] * 3 + ["  ", " \n", "\n\n", "\t", "\x1c", ""]
    for _ in range(60):
        texts = ["".join(rng.choice(words) + rng.choice(tails) + rng.choice(gaps) for _ in range(rng.randrange(9))) for _ in range(20)]
        texts = [None, "", *(t.strip() if k % 4 else t for k, t in enumerate(texts))]
        ids, offsets = model.encode(texts)
        for k, text in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_forms_of_a_word_are_encoded_once():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library, model = Tokenizer.from_file(path), TokenIds(path)
    asked, make = [], model.memo.make
    model.memo.make = lambda cuts: asked.extend(cuts) or make(cuts)
    forms = "Quoneth quoneth, QUONETH. quoneth quoneth.\nQuoneth,"
    assert model.encode([forms])[0].tolist() == library.encode(forms, add_special_tokens=False).ids
    assert sorted(asked) == [",", ".", "quoneth"]
    model.memo.most = 60
    rng = random.Random(8)
    words = ["dog", "Dog", "DOG", "Ünder", "İ", "a'", "I'M", "x1", "日本", "\u01c5", "J\u030c", "ŉ", "a_b", "\u0345", "\u200b", "<|STARTOFTEXT|>"]
    tails = ["", ".", ",", ".&&&", "!!!!!", "'", "'T.", "…", "\u030c", "\x00", "<|", "<|endoftext|>"]
    gaps = [" "] * 8 + ["\n"] * 3 + ["  ", " \n", "\t", "\x1c", "\x85", ""]
    for _ in range(60):
        texts = [None, "", *("".join(rng.choice(words) + rng.choice(tails) + rng.choice(gaps) for _ in range(rng.randrange(9))) for _ in range(20))]
        ids, offsets = model.encode(texts)
        for k, text in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_a_worker_encodes_each_of_many_words_once():
    from string import ascii_lowercase as az

    model, asked = TokenIds(queries.tokenizer_path("byte_bpe_50k.json")), 0

    def make(cuts):
        nonlocal asked
        asked += len(cuts)
        return np.zeros(len(cuts), np.int32), np.ones(len(cuts), np.int64)

    model.memo.make = make
    model.front = 0
    texts = [" ".join(f"{a}{b}{c}{d}{e}" for c in az for d in az for e in az) for a in "ab" for b in az[:11]]
    for _ in range(2):
        for text in texts:
            assert len(model.encode([text, "aaaaa."])[0]) == 26**3 + 2
    assert asked == 22 * 26**3 + 1  # the words, and a full stop at the end of one


def test_a_worker_encodes_each_of_many_words_once_whatever_their_case():
    from string import ascii_lowercase as az

    model, asked = TokenIds(queries.tokenizer_path("word_bpe_49k.json")), []

    def make(cuts):
        asked.extend(cuts)
        return np.zeros(len(cuts), np.int32), np.ones(len(cuts), np.int64)

    model.memo.make = make
    words = [f"{a}{b}{c}{d}{e}" for a in "ab" for b in az[:11] for c in az for d in az for e in az]
    for own in (words, [w.capitalize() + "," for w in words]):
        assert len(model.encode([" ".join(own[k : k + 20_000]) for k in range(0, len(own), 20_000)])[0]) == len(words) * (1 + own[0].endswith(","))
    for k in range(0, len(words), 20_000):
        model.encode([" ".join(words[k : k + 20_000]).upper()])
    assert sorted(asked) == [",", *words]


def test_spaced_memo_compares_whole_cuts(monkeypatch):
    from vademecum.llm import spaced

    def make(cuts):
        return np.array([ord(x) for c in cuts for x in c], np.int32), np.array([len(c) for c in cuts], np.int64)

    rng = random.Random(5)
    pieces = ["a", "b", "\x00", "é", "×", "÷", "İ", "ɏ", "ɐ", "日", "😀", "x" * 7, "y" * 8, "z" * 15, "ab" * 16, "\n"]
    for factors in (spaced.FACTORS, spaced.FACTORS * np.uint64(0)):  # without factors all cuts have one hash
        monkeypatch.setattr(spaced, "FACTORS", factors)
        for most in (20, 1000):
            memo = spaced.SpacedMemo(make, most=most)
            for _ in range(60):
                words = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))) + rng.choice(["", ".", "?!", "#####", "(a)."]) for _ in range(60)]
                texts = [None, "", " ".join(words[:20]), words[20], " ".join(words[21:])]
                ids, offsets = memo.encode(texts)
                assert ["".join(map(chr, ids[offsets[k] : offsets[k + 1]])) for k in range(5)] == [(t or "").replace(" ", "") for t in texts]
            assert memo.entries <= most + 200
    assert memo.encode([None, ""])[1].tolist() == [0, 0, 0]


def test_simple8b_words_hold_the_most_ids_in_any_parts():
    rng = np.random.default_rng(6)
    for trial in range(60):
        sizes = rng.integers(0, 150, 9)
        bounds = np.append(0, np.cumsum(sizes))
        ids = rng.integers(0, 1 << 63, bounds[-1], dtype=np.uint64) * np.uint64(2) >> rng.integers(trial % 50, 64, bounds[-1]).astype(np.uint64)
        packed = simple8b.pack(ids, bounds)
        for most in (1, 100, 10_000):
            parts = simple8b.pack_parts(ids, bounds, most)
            assert all((a == b).all() for a, b in zip(packed, parts, strict=True))
            assert (simple8b.unpack_parts(*packed[:2], packed[2][:-1], packed[3][:-1], sizes, most) == ids).all()
        selectors = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            while a < b:
                fitting = [s for s in range(15) if all(int(x).bit_length() <= simple8b.WIDTHS[s] for x in ids[a : min(b, a + simple8b.COUNTS[s])])]
                selectors.append(fitting[0] + 1 if fitting else 0)
                a += simple8b.COUNTS[fitting[0]] if fitting else 1
        assert (packed[0] >> np.uint64(60)).tolist() == selectors


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for trial in range(200):
        sizes = [int(x) for x in rng.integers(0, 200, rng.integers(0, 8))]
        n = sum(sizes)
        ids = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) >> rng.integers(0, 64, n).astype(np.uint64) if trial % 2 else rng.integers(0, 1 + trial * 300, n).astype(np.uint64)
        raw = simple8b.file_bytes([None if i == 1 else i for i in range(len(sizes))], sizes, ids)
        table, back = simple8b.parse_file(raw)
        assert (back == ids).all() and table["ids"].tolist() == sizes
    with pytest.raises(ValueError):
        simple8b.parse_file(raw[:-1])
    with pytest.raises(ValueError):
        simple8b.parse_file(raw[:-1] + bytes([raw[-1] ^ 1]))


def test_id_files(docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    start, want = 0, []
    for doc_id, text in sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in simple8b.id_files(docs, path, 2).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simple8b.id_files(empty, path, 2).count() == 0


def test_op4_and_op6_queries_equal_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    library, start, want = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json")), 0, set()
    for doc_id in sorted(texts):
        ids = [*library.encode(texts[doc_id], add_special_tokens=False).ids, 2]
        want.add((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    rows = queries.op4_simple8b(spark, sf_dir).collect()
    assert len(rows) == len(want) and set(map(tuple, rows)) == want
    library, want = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json")), set()
    for doc_id, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want.add((doc_id, piece, at, len(own), crc(own)))
    rows = queries.op6_minimum_bin_slack(spark, sf_dir).collect()
    assert len(rows) == len(want) and {tuple(r)[:5] for r in rows} == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        assert all(sum(n for at, n in own if at < offset) == offset for offset, _ in own) and sum(n for _, n in own) <= 2048


def brute_fullest(room, counts):
    best = {0}
    for length, n in counts.items():
        best = {s + k * length for s in best for k in range(n + 1) if s + k * length <= room}
    return max(best)


def test_plan_takes_the_fullest_bins():
    rng = random.Random(5)
    for _ in range(60):
        counts = collections.Counter(rng.randint(1, 20) for _ in range(rng.randint(0, 25)))
        left = dict(counts)
        for times, chosen in bin_packing.plan(dict(counts), 20):
            for _ in range(times):
                first = max(k for k, v in left.items() if v)
                rest = {k: v - (k == first) for k, v in left.items()}
                assert sum(k * v for k, v in chosen) == first + brute_fullest(20 - first, rest)
                for k, v in chosen:
                    left[k] -= v
                    assert left[k] >= 0
        assert not any(left.values())


def test_packing(docs, empty):
    path = queries.tokenizer_path("word_bpe_49k.json")
    rows = bin_packing.pack_documents(docs, path, 2048).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) >= -(-sum(r.length for r in rows) // 2048)
    per = collections.Counter(r.doc_id for r in rows)
    assert per[2] == per[3] == 1 and per[6] == 2 and per[4] > 1
    assert bin_packing.pack_documents(empty, path, 2048).count() == 0


def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), duplicates, len(covered)


def test_quality_counts(spark, docs, empty):
    labels = spark.createDataFrame([(4, 1), (1, 0), (None, 1), (5, None)], "doc_id long, quality int")
    keep = ["doc_id", "text", "lang"]
    rows = quality.judge(docs, labels, keep).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        n, chars, symbols, lines, repeats = brute_counts(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (r.base_failed and r.kept)
    assert quality.judge(empty, labels, keep).count() == 0
    assert quality.judge(docs, labels.limit(0), keep).count() == len(ROWS)


def test_quality_ratio_equals_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["good", "fine", "bad", "worse"][: 2 + 2 * (i % 2)]) for _ in range(30)) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    trusted = np.array([i for i in range(40) if i % 2 == 0])
    ratios = quality.log_ratios(quality.count_cells(df, trusted))
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    cells = {}
    for i, text in enumerate(texts):
        own, _ = quality.ngram_cells(*quality.hash_words([text], quality.WordHashes()))
        cells[i] = own
        for c in own:
            raw[c] += 1
            target[c] += i % 2 == 0
    want = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.allclose(ratios, want)
    got = {r.doc_id: r.log_ratio for r in quality.measures(df, ratios, ["doc_id"]).collect()}
    assert all(got[i] == pytest.approx(want[c].mean()) for i, c in cells.items())


def brute_marginals(scores, first, moves, start):
    import itertools

    out, begin = [], 0
    ends = [*np.flatnonzero(first)[1:].tolist(), len(scores)]
    for end in ends:
        total, toxic = 0.0, np.zeros(end - begin)
        for path in itertools.product((0, 1), repeat=end - begin):
            value = start[path[0]] + sum(scores[begin + i] for i, s in enumerate(path) if s) + sum(moves[a][b] for a, b in itertools.pairwise(path))
            total += np.exp(value)
            toxic += np.exp(value) * np.array(path)
        out += (toxic / total).tolist()
        begin = end
    return out


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(1, 30))
        first = rng.random(n) < 0.3
        first[0] = True
        first[::8] = True
        scores, moves, start = rng.normal(size=n) * 3, rng.normal(size=(2, 2)), rng.normal(size=2)
        assert np.allclose(toxicity.marginals(scores, first, moves, start), brute_marginals(scores, first, moves, start))


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(4, 1), (1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    field = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, field, ["doc_id", "lang", "shard"]).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, field, ["doc_id"]).count() == 0
    bare = toxicity.fit(empty, labels.limit(0))
    assert toxicity.score(docs, bare, ["doc_id"]).where("predicted = 1").count() == 0


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(7)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(vocabulary) for _ in range(60)]
        toxic = i % 6 == 0
        for _ in range(4 if toxic else 0):
            words[rng.randrange(60)] = rng.choice(["vilezz", "nastyzz", "grimqqa", "grimqqb"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id % 3 <> 1")
    for r in toxicity.score(docs, field, ["doc_id", "text"]).where("doc_id % 3 = 1").collect():
        assert r.predicted == (r.doc_id % 6 == 0)
        for s in r.spans:
            assert all(w[:4] in ("vile", "nast", "grim") for w in r.text[s.begin : s.end].split())


def test_toxic_keys_depend_on_rates_not_on_size(spark):
    def found(toxic, clean, t, c):
        rows = [(f"{k} t{k} {'grebnax' if k < t else ''}", 1) for k in range(toxic)] + [(f"{k} c{k} {'grebnax' if k < c else ''}", 0) for k in range(clean)]
        rows += [("copied zweeble", 1)] * 60
        return toxicity.toxic_keys(spark.createDataFrame(rows, "text string, label long"))

    for toxic, clean, t, c in ((1500, 6000, 25, 0), (150, 600, 12, 0), (100, 5000, 60, 130)):
        keys = found(toxic, clean, t, c)
        assert "grebnax" in keys and "zweeble" not in keys
    assert "grebnax" not in found(300, 600, 3, 0)


def plain_score(field, text):
    """The score of a text by forward and backward sums over its words, one after the other."""
    words = text.split()
    cells = toxicity.cells_of(words)
    w, own, more = field.weights, toxicity.OWN, toxicity.OWN + toxicity.NEXT
    emitted = np.zeros((len(words), 2))
    for i, c in enumerate(cells):
        emitted[i, 1] = sum(w[c[:own]]) + (sum(w[cells[i - 1][own:more]]) if i else 0) + (sum(w[cells[i + 1][more:]]) if i + 1 < len(words) else 0)
    forward, backward = np.zeros((len(words), 2)), np.zeros((len(words), 2))
    for i in range(len(words)):
        forward[i] = emitted[i] + (field.start if i == 0 else np.logaddexp.reduce(forward[i - 1][:, None] + field.moves, axis=0))
    for i in range(len(words) - 2, -1, -1):
        backward[i] = np.logaddexp.reduce(field.moves + emitted[i + 1] + backward[i + 1], axis=1)
    total = forward + backward
    toxic = float(np.exp(total[:, 1] - np.logaddexp(total[:, 0], total[:, 1])).sum()) if words else 0.0
    a, b, c = field.curve
    return 1 / (1 + np.exp(-(a + b * np.log(toxic + 0.05) + c * np.log(len(words) + 1))))


def test_op5_query_equals_plain_sums(spark, sf_dir):
    labels, docs = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("labels", "documents"))
    field = toxicity.fit(docs, labels, "crc32(cast(doc_id AS string)) % 3 <> 1")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = queries.op5_toxicity_crf(spark, sf_dir).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.score == pytest.approx(plain_score(field, text[r.doc_id]), abs=1e-9)
        assert r.predicted == int(r.score >= 0.7)


def test_toxicity_held_out(spark):
    from pathlib import Path

    if not Path("/root/testdata/sf0.1").exists():
        pytest.skip("needs the larger tables")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic IS NOT NULL")
    rows = queries.op5_toxicity_crf(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n[1, 0]) and n.get((0, 1), 0) <= 0.01 * n[0, 0]


def test_transitions_count():
    texts = [["a", "bad", "bad", "bad", "b", "c"] * 5, ["a", "b", "c", "bad"] * 8] * 4
    tags = [np.array([int(w == "bad") for w in t]) * int(len(t) == 30) for t in texts]
    field = toxicity.train(texts, tags)
    bare = toxicity.Field(field.weights, field.moves * 0, field.start * 0)
    (p, _, a), (q, _, b) = (toxicity.Emissions(f).weigh(texts) for f in (field, bare))
    assert np.abs(p - q).max() > 0.2 and np.abs(a - b).max() > 1


@pytest.mark.parametrize("stage", ["quality_rules", "toxicity", "near_duplicates", "bin_packing"])
def test_pipeline_stages_keep_clashing_columns(spark, stage):
    pipeline = pytest.importorskip("corpus_pipeline")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ratio", "base_failed", "kept", "score", "predicted", "spans", "label", "set_key", "n_shingles", "component_id", "id", "piece", "length", "_kept", "_predicted"]
    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wide = plain.selectExpr("*", *[f"concat('x', doc_id) AS `{n}`" for n in names])
    function = dict(pipeline.STAGES)[stage]
    out, want = function(spark, wide, "/root/testdata/sf0.001"), function(spark, plain, "/root/testdata/sf0.001")
    assert out.count() == want.count()
    if stage != "bin_packing":
        assert out.columns == wide.columns
        assert out.where(" OR ".join(f"`{n}` IS DISTINCT FROM concat('x', doc_id)" for n in names)).count() == 0
        assert out.select("doc_id").exceptAll(want.select("doc_id")).count() == 0


def test_licence_notices_with_any_gap(spark):
    notices = {
        "This work is in the public{}domain.": "Public-Domain",
        "Released into the public{}domain.": "Public-Domain",
        "All rights{}reserved.": "All-Rights-Reserved",
    }
    gaps = [" ", "\n", "\r\n", "  ", "\t", " \n  ", "-"]
    rows = [(i, n.format(g), name) for i, (g, (n, name)) in enumerate((g, x) for g in gaps for x in notices.items())]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string, name string")).collect()
    assert [(r.text, r.licences) for r in got if r.licences != [r["name"]]] == []


def test_licence_query_equals_sql(spark, sf_dir):
    from tests.compare import assert_same, connect

    assert_same(queries.queries()["op8_license_rules"](spark, sf_dir), connect(sf_dir), queries.oracle_sql()["op8_license_rules"])


def test_op1_query(spark, sf_dir):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op1_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = library.encode(text[r.doc_id])
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))


def plain_quality(docs, labels):
    """Per row of (doc_id, text): the counts, base_failed, log ratio and kept of the quality rules, one step after the other
    over whole numbers and plain loops. Labels: (doc_id, quality), none of them left out."""
    import xxhash

    mask, cells = (1 << 64) - 1, 1 << 16

    def mix(x):
        x ^= x >> 31
        x = x * 0x9E3779B97F4A7C15 & mask
        x ^= x >> 29
        x = x * 0xD6E8FEB86659FD93 & mask
        return x ^ x >> 32

    def grams(words):
        hashes = [xxhash.xxh3_64_intdigest(w.encode()) for w in words]
        pairs = [mix((a * 0x9FB21C651E98DF25 + b + 2) & mask) for a, b in zip(hashes, hashes[1:], strict=False)]
        return [mix(h) % cells for h in hashes] + [p % cells for p in pairs]

    rows, good = [], {i for i, q in labels if q == 1}
    raw, target = collections.Counter(), collections.Counter()
    for doc_id, text in docs:
        text = text or ""
        words = [w for w in re.split("[ \\t\\n\\x0b\\x0c\\r]+", text) if w]
        own = grams(words)
        raw.update(own)
        if doc_id in good:
            target.update(own)
        windows = collections.defaultdict(list)
        for k in range(len(words) - 7):
            windows[tuple(words[k : k + 8])].append(k)
        repeated = {i for at in windows.values() if len(at) > 1 for k in at for i in range(k, k + 8)}
        seen, again = set(), 0
        for line in text.split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                again += line in seen
                seen.add(line)
        n = len(words)
        rows.append([doc_id, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(repeated), n < 20 or 100 * len(repeated) > 30 * n, own])
    all_raw, all_target = sum(raw.values()) + cells, sum(target.values()) + cells
    weight = {c: math.log((target[c] + 1) / all_target) - math.log((raw[c] + 1) / all_raw) for c in raw}
    for row in rows:
        own = row.pop()
        row.append(sum(map(weight.get, own)) / max(1, len(own)))
    quality, bins = dict(labels), collections.defaultdict(collections.Counter)
    for row in rows:
        if row[0] in quality and not row[6]:
            bins[quality[row[0]]][max(-8 * 256, min(8 * 256, math.floor(row[7] * 256)))] += 1
    losses = {}
    for cut in range(-8 * 256, 8 * 256 + 2):
        below = sum(n for b, n in bins[1].items() if b <= cut) / sum(bins[1].values())
        above = sum(n for b, n in bins[0].items() if b > cut) / sum(bins[0].values())
        losses[cut] = 5 * below + above
    least = min(losses.values())
    run = [min(c for c, x in losses.items() if math.isclose(x, least, rel_tol=1e-9, abs_tol=1e-12))]
    while run[-1] + 1 in losses and math.isclose(losses[run[-1] + 1], least, rel_tol=1e-9, abs_tol=1e-12):
        run.append(run[-1] + 1)
    cut = (float(np.median(run)) + 1) / 256
    return {row[0]: (*row[1:7], not row[6] and row[7] >= cut, row[7]) for row in rows}


def test_quality_query_equals_plain_rules(spark, sf_dir):
    """op7 and the pipeline's first stage, whole: counts, ratio, threshold and verdicts."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").collect()]
    want = plain_quality(docs, labels)
    got = queries.queries()["op7_quality_rules"](spark, sf_dir).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in got} == {i: w[:7] for i, w in want.items()} and len(got) == len(docs)
    assert all(r["log_ratio"] == pytest.approx(want[r["doc_id"]][7]) for r in got)
    assert 0 < sum(w[6] for w in want.values()) < len(want)
    pipeline = pytest.importorskip("corpus_pipeline")
    kept = pipeline.quality_rules(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if w[6]}


def test_quality_rules_use_every_label(spark):
    """More labels than a driver should hold: none of them is left out of the ratios and of the threshold."""
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefgh" if i % 3 else "efghijkl") + str(rng.randrange(9)) for _ in range(60))) for i in range(60)]
    labels = spark.range(300_000).selectExpr("id AS doc_id", "CAST(id % 3 > 0 AS INT) AS quality")
    rows = quality.judge(spark.createDataFrame(docs, "doc_id long, text string"), labels, ["doc_id"]).collect()
    want = plain_quality(docs, [(i, int(i % 3 > 0)) for i, _ in docs])
    assert {r["doc_id"]: r["kept"] for r in rows} == {i: w[6] for i, w in want.items()} and 0 < sum(r["kept"] for r in rows) < 60
    assert all(r["log_ratio"] == pytest.approx(want[r["doc_id"]][7]) for r in rows)


def test_toxicity_stage_equals_plain_scores(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    docs = docs.where("length(text) < 3000")
    field = toxicity.fit(docs, labels)
    left = {r["doc_id"] for r in pipeline.drop_toxic(spark, docs, sf_dir).collect()}
    assert left == {r["doc_id"] for r in docs.collect() if plain_score(field, r["text"] or "") < toxicity.THRESHOLD}

import difflib
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vademecum import vocabulary as V
from vademecum.jobs import run
from vademecum.operators import block_search, class_ranks, dosing, evaluation, loading, names, reports, retrieval
from vademecum.operators.ranges import numbered
from vademecum.plans import registry, score_queries
from vademecum.sources import tables
from vademecum.sources.vector_table import VectorTable
from vademecum.streaming.upserts import stream_into

CHUNK = "drug_name string, section_type string, species array<string>, book_page int, text string, ordinal int"


def embed(rows):
    return rows.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))


def chunks(spark, *texts):
    return spark.createDataFrame([("Metronidazole", "doses", ["dog"], 873, t, i) for i, t in enumerate(texts)], CHUNK)


def test_load_is_idempotent_and_prunes(spark):
    store = VectorTable(spark, tables.scratch(spark, "t"))
    report = lambda *t, **k: tuple(store.load(chunks(spark, *t), embed, **k).first())
    assert report("a", "b") == (2, 0, 0)
    assert report("a", "b") == (0, 2, 0)
    assert report("a", "c") == (1, 1, 0)
    assert report("a", prune=False) == (0, 1, 0)
    assert report("a") == (0, 1, 1)
    assert [r.text for r in store.read().collect()] == ["a"]


def test_load_guards(spark):
    store = VectorTable(spark, tables.scratch(spark, "t"))
    store.load(chunks(spark, "a"), embed)
    with pytest.raises(ValueError, match="one logical key"):
        store.load(chunks(spark, "a").union(chunks(spark, "b")), embed)
    empty = spark.createDataFrame([], CHUNK)
    with pytest.raises(ValueError, match="prune"):
        store.load(empty, embed)
    assert tuple(store.load(empty, embed, prune=False).first()) == (0, 0, 0)


def test_stream_into(spark):
    source, path, marks = (tables.scratch(spark, n) for n in ("in", "out", "marks"))
    chunks(spark, "a", "b").write.parquet(source)
    for _ in range(2):
        stream_into(spark.readStream.schema(CHUNK).parquet(source), path, embed, marks).awaitTermination()
    chunks(spark, "a", "z").write.mode("append").parquet(source)
    stream_into(spark.readStream.schema(CHUNK).parquet(source), path, embed, marks).awaitTermination()
    assert sorted(r.text for r in VectorTable(spark, path).read().collect()) == ["a", "z"]


def test_fuzzy_names(spark):
    known = names.canonical(spark.createDataFrame([(n,) for n in ("Metronidazole", "Metoclopramide", "Meloxicam", "Carprofen")], "drug_name string"))
    asked = spark.createDataFrame([(q,) for q in (" METRONIDAZOLE ", "metronidazol", "xyzzyplugh", "meloxi", None)], "query string")
    rows = {r["query"]: r for r in names.resolve(asked, known).collect()}
    assert (rows[" METRONIDAZOLE "].canonical, rows[" METRONIDAZOLE "].exact) == ("Metronidazole", True)
    assert (rows["metronidazol"].canonical, rows["metronidazol"].exact) == ("Metronidazole", False)
    assert rows["xyzzyplugh"].canonical is None and rows["xyzzyplugh"].suggestions == []
    assert rows["meloxi"].canonical is None and rows["meloxi"].suggestions == ["Meloxicam"]
    assert rows[None].canonical is None


def test_candidates_hold_every_close_name_and_few_others(spark):
    """Names made of shared syllables, with misspelled, cut, swapped and odd queries, against difflib on all pairs."""
    rng = np.random.default_rng(8)
    syllables = ["met", "ro", "ni", "da", "zole", "clo", "pra", "mide", "pen", "cil", "lin", "a", "mox", "car", "pro", "fen", "keto", "xyl", "qu", "in"]
    known = sorted({"".join(rng.choice(syllables, rng.integers(2, 6))) for _ in range(400)} | {"a", "ab", "abc", "zz", "été", "aaaaaaaaaaaa", "a" * 250, "ab" * 120})
    asked = set()
    for name in known[::4]:
        i = int(rng.integers(0, len(name)))
        asked |= {name[:i] + name[i + 1 :], name[:i] + "x" + name[i:], name[::-1], name[: len(name) // 2 + 1], " ".join([name[:3], name[3:]])}
    asked |= {"", "b", "ba", "aaaa", "zzzz qqqq", "ab" * 110 + "x"}
    names_, queries_ = spark.createDataFrame([(n, n.upper()) for n in known], "norm string, canonical string"), spark.createDataFrame([(q,) for q in asked], "norm string")
    for cutoff, distance, share in ((V.MATCH_CUTOFF, names.MATCH_DISTANCE, 0.02), (V.SUGGEST_CUTOFF, names.SUGGEST_DISTANCE, 0.15)):
        pairs = {(r.norm, r.other) for r in names.candidates(queries_, names_, cutoff, distance).collect()}
        close = {(q, n) for q in asked for n in known if difflib.SequenceMatcher(None, n, q).ratio() >= cutoff}
        assert close and close <= pairs
        assert len(pairs) <= share * len(asked) * len(known)
        print(cutoff, len(close), len(pairs), len(asked) * len(known))
    found = {r.norm: [x["canonical"] for x in r.found] for r in names._closest(queries_.where("norm <> ''"), names_).collect()}
    for q in asked - {""}:
        want = difflib.get_close_matches(q, known, n=1, cutoff=V.MATCH_CUTOFF) or difflib.get_close_matches(q, known, n=3, cutoff=V.SUGGEST_CUTOFF)
        assert found.get(q, []) == [n.upper() for n in want]


def test_names_of_other_lengths_have_no_tokens(spark, monkeypatch):
    known = [("ab" * 5 + str(i), f"N{i}") for i in range(50)] + [("pq" * 30, "Long")]
    names_ = spark.createDataFrame(known, "norm string, canonical string")
    met, plain = [], names._prefixes
    monkeypatch.setattr(names, "_prefixes", lambda rows, *rest: met.append(rows.count()) or plain(rows, *rest))
    found = names._closest(spark.createDataFrame([("pq" * 29,), ("zy" * 30,)], "norm string"), names_).collect()
    assert [(r.norm, [x["canonical"] for x in r.found]) for r in found] == [("pq" * 29, ["Long"])]
    assert met and max(met) <= 2


def test_fuzzy_queries_equal_difflib(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name").collect()
    norm = lambda n: " ".join(n.lower().split())
    known = {}
    for r in parts:
        known[norm(r.p_name)] = max(known.get(norm(r.p_name), ""), r.p_name)
    want, suggested = {}, {}
    for r in parts:
        query = {0: r.p_name, 1: r.p_name[:-1], 2: r.p_name[:5]}[r.p_partkey % 3]
        exact = known.get(norm(query))
        near = difflib.get_close_matches(norm(query), known, n=1, cutoff=V.MATCH_CUTOFF)
        want[r.p_partkey] = (exact or (known[near[0]] if near else None), True if exact else False if near else None)
        if not exact and not near:
            suggested[r.p_partkey] = ",".join(known[n] for n in difflib.get_close_matches(norm(query), known, n=3, cutoff=V.SUGGEST_CUTOFF))
    found = registry.load_all()[0]
    assert {r.request_id: (r.canonical, r.exact) for r in found["j10_fuzzy_names"](spark, sf_dir).collect()} == want
    assert {r.request_id: r.suggestions for r in found["t6_fuzzy_suggestions"](spark, sf_dir).collect()} == suggested


def test_whole_ingestion_equals_its_steps(spark, sf_dir):
    """g1_ingest on the supplied tables: its chunks are the plain pieces of the groups that other queries hold against SQL."""
    from vademecum.operators.splitting import split_text
    from vademecum.plans import handbook

    want, ordinal = set(), {}
    for r in sorted(handbook.ingestion(spark, sf_dir).groups.collect(), key=lambda r: (r.book_id, r.mono_ord, r.section_ord, r.group_ord)):
        for piece in split_text(r.text, 1200) if len(r.text) > 1200 else [r.text.strip()]:
            species = "+".join(r.species)
            key = (r.book_id, r.mono_ord, r.section_type, species)
            ordinal[key] = ordinal.get(key, -1) + 1
            logical = f"{r.drug_name.lower()}|{r.section_type}|{species}|{ordinal[key]}"
            want.add((*key, ordinal[key], hashlib.sha256(f"{logical}::{piece}".encode()).hexdigest()))
    rows = registry.load_all()[0]["g1_ingest"](spark, sf_dir).collect()
    assert {(r.book_id, r.mono_ord, r.section_type, r.species, r.ordinal, r.content_hash) for r in rows} == want and len(rows) == len(want)


def test_block_top_k_equals_window(spark):
    rng = np.random.default_rng(3)
    rows = [(f"k{i}", [float(x) for x in rng.normal(size=4)]) for i in range(200)]
    rows += [("tie1", rows[0][1]), ("tie0", rows[0][1])]
    corpus = spark.createDataFrame(rows, "logical_key string, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, rows[i][1]) for i in range(7)], "query_id bigint, query_vector array<double>")
    plain = retrieval.ranked(retrieval.scored(queries, corpus).withColumn("score", F.round("score", 6)), ["query_id"], 5)
    pick = ["query_id", "logical_key", "rank"]
    assert sorted(plain.select(*pick).collect()) == sorted(retrieval.block_top_k(queries, corpus, 5).select(*pick).collect())


def test_block_top_k_takes_any_number_of_queries(spark):
    rng = np.random.default_rng(4)
    n = 20_500
    corpus = spark.createDataFrame([(f"k{i}", [float(x) for x in rng.normal(size=3)]) for i in range(30)], "logical_key string, vector array<double>")
    queries = spark.range(n).select(F.col("id").alias("query_id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("query_vector"))
    got = retrieval.block_top_k(queries, corpus, 2)
    plain = retrieval.ranked(retrieval.scored(queries, corpus).withColumn("score", F.round("score", 6)), ["query_id"], 2)
    pick = ["query_id", "logical_key", "rank"]
    assert got.count() == 2 * n
    assert got.select(*pick).exceptAll(plain.select(*pick)).count() == 0


def test_metrics_by_hand(spark):
    ranks = spark.createDataFrame([(1, "k1", 1), (1, "x", 2), (1, "k2", 3), (1, "y", 4)], "query_id bigint, logical_key string, rank int")
    relevant = spark.createDataFrame([(1, k) for k in ("k1", "k2", "k3")], "query_id bigint, logical_key string")
    cases = spark.createDataFrame([(1, 3), (2, 0)], "query_id bigint, n_relevant int")
    by = ["query_id"]
    rows = {r.query_id: r for r in evaluation.query_metrics(cases, evaluation.relevant_ranks(ranks, relevant, by), by, (1, 4)).collect()}
    assert rows[1]["recall@4"] == pytest.approx(2 / 3) and rows[1]["hit_rate@1"] == 1.0 and rows[1]["mrr"] == 1.0
    assert rows[2]["recall@4"] == 0.0 and rows[2]["mrr"] == 0.0


def test_quota(spark):
    pool = [("dose", f"d{i}", "dog", "companion") for i in range(30)] + [("dose", f"e{i}", f"exotic{i % 3}", "other") for i in range(30)]
    rows = spark.createDataFrame(pool, "flow string, drug string, signature string, bucket string")
    count = lambda df: {r["bucket"]: r["count"] for r in df.groupBy("bucket").count().collect()}
    key = F.md5(F.col("drug").cast("binary"))
    assert count(evaluation.sample_targets(rows, 10, 0.2, key, ["drug"])) == {"companion": 8, "other": 2}
    assert count(evaluation.sample_targets(rows, 10, 0.0, key, ["drug"])) == {"companion": 10}
    assert count(evaluation.sample_targets(rows.where("bucket = 'other'"), 10, 0.2, key, ["drug"])) == {"other": 10}


def test_verdicts(spark):
    asked = spark.createDataFrame([(1, None, False), (2, "pain", False), (3, None, True), (4, "fever", False), (5, None, False), (6, None, False)], "request_id int, indication string, all_regimens boolean")
    found = [(1, "pain", True), (2, "pain", True), (2, "itch", True), (3, "pain", True), (3, "itch", True), (4, "pain", True), (5, "pain", False)]
    rows = {r.request_id: r for r in dosing.verdicts(asked, spark.createDataFrame(found, "request_id int, regimen_indication string, is_grounded boolean")).collect()}
    assert [rows[i].kind for i in range(1, 7)] == ["dose_rule", "dose_rule", "dose_rule_set", "needs_clarification", "needs_clarification", "needs_clarification"]
    assert rows[2].candidates == ["pain"] and rows[4].candidates == ["pain"] and rows[5].candidates == []
    assert rows[6].reason == "no dose regimens could be extracted"


def test_regimens_drop_malformed(spark):
    json = '[{"indication":"a","mg_per_kg_low":"25"},{"indication":"b","mg_per_kg_low":"twenty-five"},{"indication":"c","mg_per_kg_low":"1","mg_per_kg_high":"0"}]'
    rows = dosing.parsed_regimens(spark.createDataFrame([(1, json), (2, None), (3, "nonsense")], "request_id int, regimens_json string")).collect()
    assert [(r.request_id, r.indication) for r in rows] == [(1, "a")]


def test_contraindication_report(spark):
    corpus = spark.createDataFrame(
        [("A", "contraindications", f"a|contraindications|all|{i}", 1, f"text {i}") for i in (10, 2, 0)] + [("A", "drug_interactions", "a|drug_interactions|all|0", 1, "with BETA no")],
        "drug_name string, section_type string, logical_key string, book_page int, text string",
    )
    asked = spark.createDataFrame([(1, "A"), (2, "None")], "request_id int, canonical string")
    others = spark.createDataFrame([(1, "beta", "Beta"), (1, "x", None), (1, "gamma", "Gamma")], "request_id int, other string, canonical string")
    rows = {r.request_id: r for r in reports.contraindications(asked, corpus, others).collect()}
    assert [k.logical_key.rsplit("|", 1)[1] for k in rows[1].contraindications] == ["0", "2", "10"]
    assert [(f.other_drug, [(p.logical_key, p.text, p.book_page) for p in f.passages]) for f in rows[1].flagged] == [("Beta", [("a|drug_interactions|all|0", "with BETA no", 1)])]
    assert rows[1].unresolved_other_drugs == ["x"]
    assert rows[2].interactions == [] and rows[2].flagged == []


def test_request_rejects_and_empties(spark):
    corpus = spark.createDataFrame([("k", "A", "doses", ["dog"], [1.0])], "logical_key string, drug_name string, section_type string, species array<string>, vector array<double>")
    asked = spark.createDataFrame(
        [(1, "q", [1.0], "a", None, None, 5), (2, " ", [1.0], None, None, None, 5), (3, "q", [1.0], None, None, "cats", 5), (4, "q", [1.0], "zzzz", None, None, 5), (5, "q", [1.0], None, None, None, 21)],
        "request_id int, query string, query_vector array<double>, drug string, section string, species string, top_k int",
    )
    hits, empty, rejects = retrieval.retrieve(asked, corpus, names.canonical(corpus))
    assert [r.request_id for r in hits.collect()] == [1]
    assert [(r.request_id, r.filters) for r in empty.collect()] == [(3, {"species": "cat"})]
    assert sorted(r.request_id for r in rejects.collect()) == [2, 4, 5]


def test_unknown_section_fails_the_read(spark):
    path = tables.scratch(spark, "chunks")
    chunks(spark, "a").withColumn("book_id", F.lit("b")).withColumn("section_type", F.lit("nonsense")).write.json(path)
    with pytest.raises(Exception, match="unknown section type"):
        tables.read_chunks(spark, path).collect()


def test_fingerprint_ignores_order(spark):
    rows = loading.keyed(chunks(spark, "a", "b", "c"))
    mark = lambda df: loading.fingerprint(df).first().fingerprint
    assert mark(rows) == mark(rows.orderBy(F.desc("text"))) != mark(loading.keyed(chunks(spark, "a", "b", "d")))


def test_whole_queries_leave_no_row_out(spark, sf_dir):
    found = registry.load_all()[0]
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id")
    scored = found["x5_cosine"](spark, sf_dir)
    assert scored.count() == vectors.count() * vectors.where("vec_id % 50 = 0").count()
    assert vectors.join(scored, "vec_id", "left_anti").count() == 0
    assert found["p13_exact_section_fetch"](spark, sf_dir).where("request_id % 10 <> 0").count() > 0


def test_reports_answer_every_request(spark):
    corpus = spark.createDataFrame([("Aspirin", "indications", "aspirin|indications|dog|0", 1, "pain", ["dog"]), ("Zinc", "doses", "zinc|doses|all|0", 2, "x", ["all"])], "drug_name string, section_type string, logical_key string, book_page int, text string, species array<string>")
    asked = spark.createDataFrame([(1, "ASPIRIN", "dogs"), (2, "aspirn", None), (3, "zinc", "cat"), (4, "qqqqqq", None)], "request_id bigint, drug string, species string")
    rows = {r.request_id: r for r in run.indication_reports(asked, corpus).collect()}
    assert {i: (r.canonical, r.resolved_from, [p.text for p in r.passages]) for i, r in rows.items()} == {1: ("Aspirin", None, ["pain"]), 2: ("Aspirin", "aspirn", ["pain"]), 3: ("Zinc", None, []), 4: (None, None, [])}
    resolved = reports.resolved_requests(asked, names.canonical(corpus))
    others = spark.createDataFrame([], "request_id bigint, other string, canonical string")
    rows = {r.request_id: r for r in reports.contraindications(resolved, corpus, others).collect()}
    assert set(rows) == {1, 2, 3, 4} and rows[4].canonical is None and rows[2].resolved_from == "aspirn" and rows[1].flagged == []


def test_retrieval_reranks_before_the_cut(spark):
    corpus = spark.createDataFrame([(f"k{i}", "A", "doses", ["dog"], [1.0, i / 10.0], "wanted words" if i == 7 else f"text {i}") for i in range(12)], "logical_key string, drug_name string, section_type string, species array<string>, vector array<double>, text string")
    asked = spark.createDataFrame([(1, "wanted", [1.0, 0.0], None, None, None, 1), (2, "wanted", [1.0, 0.0], "a", None, None, 1), (3, "other", [1.0, 1.0], None, "doses", "dogs", 2)], "request_id int, query string, query_vector array<double>, drug string, section string, species string, top_k int")
    hits = {(r.request_id, r["rank"]): r.logical_key for r in retrieval.retrieve(asked, corpus, names.canonical(corpus), retrieval.shared_words)[0].collect()}
    assert hits == {(1, 1): "k7", (2, 1): "k7", (3, 1): "k11", (3, 2): "k10"}
    plain = {(r.request_id, r["rank"]): r.logical_key for r in retrieval.retrieve(asked, corpus, names.canonical(corpus))[0].collect()}
    assert plain[1, 1] == "k0" and plain[2, 1] == "k0" and len(plain) == 4


def test_block_ranks_equal_window(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{i}", [float(x) for x in rng.normal(size=4)]) for i in range(200)]
    corpus = spark.createDataFrame([*rows, ("tie", rows[0][1])], "logical_key string, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, rows[i][1], f"k{i}") for i in range(7)], "query_id bigint, query_vector array<double>, own string")
    relevant = spark.createDataFrame([(i, f"k{j}") for i in range(7) for j in (0, 50 + i, 100)], "query_id bigint, logical_key string").union(spark.createDataFrame([(0, "tie")], "query_id bigint, logical_key string"))
    plain = retrieval.ranked(retrieval.scored(queries, corpus).withColumn("score", F.round("score", 6)).where("own <> logical_key"), ["query_id"])
    want = {(r.query_id, r.logical_key): r["rank"] for r in plain.join(relevant, ["query_id", "logical_key"]).collect()}
    got = {(r.query_id, r.logical_key): r["rank"] for r in retrieval.block_ranks(queries, corpus, relevant, own="own").collect() if r.logical_key != f"k{r.query_id}"}
    assert got == want


def test_dose_job_and_benchmark_job(spark, tmp_path):
    regimens = '[{"indication":"pain","mg_per_kg_low":"2"},{"indication":"itch","mg_per_kg_low":"7"}]'
    rows = [(1, "A", "pain", False, 10, "kg", "Give 2 mg/kg for pain.", regimens), (2, "A", None, False, 10, "stone", "Give 2 mg/kg.", regimens), (3, "A", None, True, 4, "kg", "2 mg/kg or 7 mg/kg", regimens)]
    asked = spark.createDataFrame(rows, "request_id bigint, drug string, indication string, all_regimens boolean, weight int, unit string, passage string, regimens_json string")
    asked.write.json(str(tmp_path / "requests"))
    run.main(["dose", "--requests", str(tmp_path / "requests"), "--out", str(tmp_path / "out")])
    kinds = {r.request_id: (r.kind, r.problem) for r in spark.read.parquet(str(tmp_path / "out/verdicts")).collect()}
    assert kinds == {1: ("dose_rule", None), 2: ("dose_rule", "unknown unit"), 3: ("dose_rule_set", None)}
    doses = sorted((r.request_id, float(r.dose_mg_low)) for r in spark.read.parquet(str(tmp_path / "out/doses")).collect())
    assert doses == [(1, 20.0), (3, 8.0), (3, 28.0)]
    corpus = chunks(spark, "a", "b", "c")
    VectorTable(spark, tables.table_path(str(tmp_path / "table"), "hash")).load(corpus, run.embed)
    keys = [r.logical_key for r in loading.keyed(corpus).orderBy("ordinal").collect()]
    case = spark.createDataFrame([(1, "a", "dose", "Metronidazole", "doses", ["dog"], [keys[0]])], "query_id bigint, query string, flow string, drug string, section string, species array<string>, relevant_logical_keys array<string>")
    case.write.json(str(tmp_path / "cases"))
    run.main(["benchmark", "--requests", str(tmp_path / "cases"), "--table", str(tmp_path / "table"), "--out", str(tmp_path / "card")])
    card = spark.read.json(str(tmp_path / "card/scorecard")).first()
    assert card["recall@1"] == 1.0 and card["mrr"] == 1.0


def ranking_case(spark, n, queries=3):
    """A corpus with ties and repeated vectors, queries, and plain rankings by numpy and Python's sort."""
    rng = np.random.default_rng(6)
    vectors = np.round(rng.normal(size=(n, 3)), 2)
    vectors[n // 2 : n // 2 + n // 4] = vectors[0]
    keys = [f"k{i * 7919 % n:06d}" for i in range(n)]
    schema = "logical_key string, vector array<double>"
    corpus = spark.createDataFrame(list(zip(keys, vectors.tolist(), strict=True)), schema).repartition(5)
    asked = vectors[[1, 2, 0][:queries]]
    frame = spark.createDataFrame([(i, v.tolist(), keys[i]) for i, v in enumerate(asked)], "query_id bigint, query_vector array<double>, own string")
    plain = {}
    for q, v in enumerate(asked):
        score = np.round(vectors @ v, 6)
        plain[q] = sorted(range(n), key=lambda i: (-score[i], keys[i]))
    return corpus, frame, keys, plain


def test_ranks_of_very_many_relevant_keys(spark):
    """One query with 100,000 relevant keys, beyond a block, beside one with a few: no list of them is made anywhere."""
    n = 120_000
    corpus, asked, keys, plain = ranking_case(spark, n, 2)
    relevant = corpus.select(F.lit(0).cast("bigint").alias("query_id"), "logical_key").where("logical_key >= 'k020000'").unionByName(spark.createDataFrame([(1, keys[i]) for i in (5, 60_001, 60_002, 119_999, 5)], "query_id bigint, logical_key string"))
    got = retrieval.block_ranks(asked, corpus, relevant, own="own")
    assert "collect_list" not in got._jdf.queryExecution().toString()
    rank = {q: {keys[i]: r for r, i in enumerate((i for i in order if i != q), 1)} for q, order in plain.items()}
    rows = got.where("logical_key <> 'k007919' OR query_id <> 1").toPandas()
    assert len(rows) == got.select("query_id", "logical_key").distinct().count() == 100_000 + 4
    assert all(rank[q].get(k, r) == r for q, k, r in rows[["query_id", "logical_key", "rank"]].itertuples(index=False))


def test_places_in_blocks_equal_sorting(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CORPUS_ROWS", 1500)
    corpus, asked, keys, plain = ranking_case(spark, 6000)
    relevant = spark.createDataFrame([(q, keys[i]) for q in range(3) for i in range(q + 3, 6000, 29)], "query_id bigint, logical_key string")
    rank = {q: {keys[i]: r for r, i in enumerate((i for i in order if i != q), 1)} for q, order in plain.items()}
    got = {(r.query_id, r.logical_key): r["rank"] for r in retrieval.block_ranks(asked, corpus, relevant, own="own").collect()}
    assert got == {(q, keys[i]): rank[q][keys[i]] for q in range(3) for i in range(q + 3, 6000, 29)}
    first = {r.query_id: r["rank"] for r in retrieval.first_ranks(asked, corpus, relevant, own="own").collect()}
    assert first == {q: min(rank[q][keys[i]] for i in range(q + 3, 6000, 29)) for q in range(3)}


def test_full_ranking_over_many_ranges(spark):
    """One query whose ranking is cut into many ranges; a quarter of the rows have the same score."""
    corpus, asked, keys, plain = ranking_case(spark, 30_000, 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = retrieval.full_ranking(asked, corpus).orderBy("rank").toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows["logical_key"].tolist() == [keys[i] for i in plain[0]] and rows["rank"].tolist() == list(range(1, 30_001))


def test_citations_round_the_exact_score(spark):
    scores = [i / 1e6 for i in range(-1_000_500, 1_000_501, 1000)] + [0.0625, 0.0005, -0.0005, -0.0, 2.0005, None]
    rows = spark.createDataFrame([(i, s, "d", "s", 1, "t") for i, s in enumerate(scores)], "i int, score double, drug_name string, section_type string, book_page int, text string")
    got = {r.i: r.citation for r in retrieval.citation(rows).collect()}
    assert got == {i: f"[{'null' if s is None else '%.3f' % s}] d / s / p.1" for i, s in enumerate(scores)}


def test_ranks_by_class_equal_sorting(spark, monkeypatch):
    """Many blocks, ties over them, a class of one row far down its query's order, a query without a class and one whose
    class has no row; short lists that are cut before the first relevant row."""
    n, most = 6000, 3
    corpus, asked, keys, plain = ranking_case(spark, n)
    far = plain[1][-1]
    classes = {keys[i]: "rare" if i == far else None if i % 11 == 0 else f"c{i % 5}" for i in range(n)}
    frame = spark.createDataFrame(list(classes.items()), "logical_key string, class string")
    corpus = corpus.join(frame, "logical_key")
    extra = [(3, "none"), (4, None)]
    vectors = {r.query_id: (r.query_vector, r.own) for r in asked.collect()}
    wanted = {0: "c1", 1: "rare", 2: "c3"} | dict(extra)
    rows = [(q, *vectors.get(q, vectors[0]), w) for q, w in wanted.items()]
    asked = spark.createDataFrame(rows, "query_id bigint, query_vector array<double>, own string, wanted string")
    for wide, listed, counted in ((40_000, 64, False), (900, 4, True), (900, 4, False)):
        monkeypatch.setattr(class_ranks, "WIDE_ROWS", wide)
        monkeypatch.setattr(class_ranks, "LISTED", listed)
        whole, hits, sizes = {}, {}, {}
        for q, _, own, w in rows:
            order = [i for i in plain.get(q, plain[0]) if counted or keys[i] != own]
            rank = {keys[i]: r for r, i in enumerate(order, 1) if keys[i] != own and w is not None and classes[keys[i]] == w}
            whole |= {(q, k): r for k, r in rank.items()}
            hits |= {(q, r): True for r in rank.values() if r <= most or r == min(rank.values())}
            sizes[q] = len(rank)
        assert {(r.query_id, r.logical_key): r["rank"] for r in class_ranks.class_ranks(asked, corpus, own="own", counted=counted).collect()} == whole
        assert sorted((r.query_id, r["rank"]) for r in class_ranks.leading_ranks(asked, corpus, most, own="own", counted=counted).collect()) == sorted(hits)
        assert {r.query_id: r.n_relevant for r in class_ranks.class_sizes(asked, corpus, "own").collect()} == sizes
    every = class_ranks.class_ranks(asked, corpus, every=True).where("query_id = 2").orderBy("rank").collect()
    assert [r.logical_key for r in every] == [keys[i] for i in plain[2]] and [r["rank"] for r in every] == list(range(1, n + 1))


def test_metrics_make_no_pairs(spark, sf_dir, monkeypatch):
    """Neither the metrics nor the first ranks nor the rankings make the pairs of queries and relevant keys as rows."""
    def none(*_, **__):
        raise AssertionError("pairs")

    for module, name in ((score_queries, "relevant"), (retrieval, "block_ranks"), (retrieval, "block_scores")):
        monkeypatch.setattr(module, name, none)
    for name in ("a10_query_metrics", "g3_benchmark", "a11_first_rank_by_counting", "j13_relevant_ranks", "w6_rank_keys"):
        assert registry.QUERIES[name](spark, sf_dir).columns


def test_numbered_groups_with_nulls_and_clashing_names(spark):
    rows = spark.createDataFrame([(g, i * 37 % 100, "x") for g in ("a", None, "b") for i in range(100)] + [("c", 1, "x"), ("c", 1, "x")], "g string, v int, _row string")
    got = numbered(rows, ["g"], ["v"], "place", 0).collect()
    assert all(r.place == r.v for r in got if r.g != "c") and sorted(r.place for r in got if r.g == "c") == [0, 1] and len(got) == 302
    assert numbered(rows.limit(0), ["g"], ["v"], "place").count() == 0


def test_filtered_pairs_equal_the_filter(spark):
    chunks_ = [(i, f"d{i % 3}", ["doses", "uses"][i % 2], [["dog"], ["cat", "dog"], ["all"], []][i % 4]) for i in range(24)]
    corpus = spark.createDataFrame(chunks_, "id int, drug_name string, section_type string, species array<string>")
    wants = [(d, s, p) for d in (None, "d1") for s in (None, "uses") for p in (None, "dog")]
    asked = spark.createDataFrame([(i, *w) for i, w in enumerate(wants)], "request_id int, want_drug string, want_section string, want_species string")
    got = sorted((r.request_id, r.id) for r in retrieval.filtered_pairs(asked, corpus).collect())
    assert got == sorted((q, i) for q, (d, s, p) in enumerate(wants) for i, drug, section, species in chunks_ if d in (None, drug) and s in (None, section) and (p is None or p in species))


def test_only_new_texts_are_embedded(spark):
    folder, seen = tables.scratch(spark, "cache"), []

    def counting(rows):
        seen.append(sorted(r.text for r in rows.collect()))
        return embed(rows)

    texts = lambda df: sorted((r.text, list(r.vector)) for r in df.collect())
    corpus = lambda *t: loading.keyed(chunks(spark, *t))
    assert texts(tables.cached_embeddings(corpus("a", "b", "c"), "m/1", folder, counting)) == [(t, [1.0, 0.0]) for t in "abc"]
    tables.cached_embeddings(corpus("a", "b", "c"), "m/1", folder, counting)
    assert texts(tables.cached_embeddings(corpus("a", "new", "c"), "m/1", folder, counting)) == [("a", [1.0, 0.0]), ("c", [1.0, 0.0]), ("new", [1.0, 0.0])]
    tables.cached_embeddings(corpus("a", "b", "c"), "m/1", folder, counting)
    tables.cached_embeddings(corpus("a"), "other", folder, counting)
    assert seen == [["a", "b", "c"], ["new"], ["a"]]
    assert tables.cached_embeddings(corpus("a").limit(0), "m/1", folder, counting).count() == 0


def test_round_robin_sends_few_rows_on(spark):
    """No window sorts all targets of a flow: both are cut by a constant before the exchange."""
    rows = spark.range(5000).selectExpr("'f' AS flow", "concat('d', id) AS drug", "concat('s', id % 7) AS signature", "IF(id % 7 < 3, 'other', 'companion') AS bucket")
    key = F.md5(F.col("drug").cast("binary"))
    got = evaluation.round_robin(rows, ["flow"], "signature", key, ["drug"], 20)
    assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
    by = {}
    for i in range(5000):
        by.setdefault(f"s{i % 7}", []).append((hashlib.md5(f"d{i}".encode()).hexdigest(), f"d{i}"))
    plain = sorted((turn, s, drug) for s, own in by.items() for turn, (_, drug) in enumerate(sorted(own)))[:20]
    assert [(r.signature, r.drug) for r in got.orderBy("pick").collect()] == [(s, d) for _, s, d in plain]


def clustered(spark, n=6000):
    """Rows in thirty clusters with sections and species, some of them equal, and queries with all kinds of filters."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 12)) * 3
    vectors = centres[rng.integers(0, 30, n)] + rng.normal(size=(n, 12)) * 0.1
    vectors[100:140] = vectors[100]
    species = [["dog"], ["cat", "dog"], ["all"], None, []]
    rows = [(f"k{i * 7919 % n:05d}", v.tolist(), ["doses", "uses", None][i % 3], species[i % 5]) for i, v in enumerate(vectors)]
    wants = [(None, None), ("doses", None), (None, "dog"), ("uses", "cat"), ("none", None), (None, "unicorn")]
    asked = [(q, (vectors[q * 97] + rng.normal(size=12) * 0.1).tolist(), *wants[q % 6]) for q in range(24)] + [(24, vectors[100].tolist(), None, None), (25, [0.0] * 12, None, None)]
    corpus = spark.createDataFrame(rows, "logical_key string, vector array<double>, section_type string, species array<string>").repartition(4)
    queries = spark.createDataFrame(asked, "query_id bigint, query_vector array<double>, want_section string, want_species string")
    plain = {}
    for q, v, section, kind in asked:
        score = np.round(vectors @ np.array(v), 6)
        fits = [i for i, r in enumerate(rows) if section in (None, r[2]) and (kind is None or kind in (r[3] or []))]
        plain[q] = [rows[i][0] for i in sorted(fits, key=lambda i: (-score[i], rows[i][0]))[:5]]
    return corpus, queries, plain


def test_clusters_that_are_proven_out_are_left_out(spark, monkeypatch):
    corpus, queries, plain = clustered(spark)
    monkeypatch.setattr(block_search, "BLOCK_ROWS", 150)
    index = block_search.ClusterIndex(corpus)
    hits, visited = index.search(queries, 5)
    found = {}
    for r in hits.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.logical_key)
    assert {q: found.get(q, []) for q in plain} == plain
    counts = {r.query_id: r["count"] for r in visited.groupBy("query_id").count().collect()}
    cells = int((index.sizes > 0).sum())
    free = [counts[q] for q in range(0, 24, 6)]
    print("clusters", cells, "visited without filters", free, "all", sum(counts.values()), "of", cells * len(plain))
    assert cells >= 30 and max(free) <= cells // 3
    assert counts[4] == counts[5] == counts[25] == cells  # too few rows, or no direction: nothing can be left out


def test_filtered_search_in_few_and_in_many_blocks(spark, monkeypatch):
    corpus, queries, plain = clustered(spark, 3000)
    for block, indexed in ((8192, 8), (400, 100), (400, 2)):
        monkeypatch.setattr(block_search, "BLOCK_ROWS", block)
        monkeypatch.setattr(block_search, "INDEXED_BLOCKS", indexed)
        found = {}
        for r in block_search.filtered_top_k(queries, corpus, 5).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append(r.logical_key)
        assert {q: found.get(q, []) for q in plain} == plain
    empty = corpus.limit(0)
    assert block_search.filtered_top_k(queries, empty, 5).count() == 0
    assert block_search.ClusterIndex(empty).search(queries, 5)[0].count() == 0


def test_mentions_equal_plain_search(spark, monkeypatch):
    monkeypatch.setattr(reports, "GROUP_NAMES", 3)
    names_ = ["Aspirin", "ASPIRIN", "Beta", "beta blocker", "Zinc", "eta", "Ünlü", ""]
    texts = ["aspirin and BETA BLOCKERS", "nothing", "zinc, ünlü", None, "", "theta"]
    passages = [(r, f"k{i}", i, t) for r in (1, 2, 3) for i, t in enumerate(texts)]
    others = [(1, n) for n in names_] + [(2, "Zinc"), (2, None), (2, "Zinc")]
    got = reports.mentions(spark.createDataFrame([(1,), (2,), (3,)], "request_id int"), spark.createDataFrame(passages, "request_id int, logical_key string, place int, text string"), spark.createDataFrame(others, "request_id int, canonical string"))
    want = sorted((r, n, f"k{i}", i) for r, i, t in [(p[0], p[2], p[3]) for p in passages] if t is not None for n in {n for q, n in others if q == r and n is not None} if n.lower() in t.lower())
    assert sorted(map(tuple, got.collect())) == want


def last_letters(query, passage):
    """A pair scorer for the job's option: passages that end in a later letter first."""
    return F.ascii(F.substring(passage, -1, 1)).cast("double")


def letter_vectors(rows):
    """An embedder for the job's option: how many letters a and b a text has."""
    count = lambda c: (F.length("text") - F.length(F.replace("text", F.lit(c)))).cast("float")
    return rows.withColumn("vector", F.array(count("a"), count("b")))


def test_jobs_take_named_embedders_and_scorers(spark, tmp_path):
    chunks(spark, "aaa x", "bb y", "ab z").withColumn("book_id", F.lit("b")).write.parquet(str(tmp_path / "chunks"))
    spark.createDataFrame([(1, "bbbb", 2)], "request_id bigint, query string, top_k int").write.json(str(tmp_path / "requests"))
    own = ["--embedder", "tests.test_tools:letter_vectors"]
    run.main(["load", "--chunks", str(tmp_path / "chunks"), "--out", str(tmp_path / "table"), *own])
    common = ["retrieve", "--requests", str(tmp_path / "requests"), "--table", str(tmp_path / "table"), *own]
    run.main([*common, "--out", str(tmp_path / "plain")])
    run.main([*common, "--out", str(tmp_path / "scored"), "--scorer", "tests.test_tools:last_letters"])
    shown = lambda n: [r.text for r in spark.read.parquet(str(tmp_path / n / "hits")).orderBy("rank").collect()]
    assert shown("plain") == ["bb y", "ab z"] and shown("scored") == ["ab z", "bb y"]

"""Queries of name resolution, reports, dosing, retrieval requests and labelled query sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from vademecum import vocabulary as V
from vademecum.functions import identity, text
from vademecum.operators import dosing as D
from vademecum.operators import evaluation as E
from vademecum.operators import names as N
from vademecum.operators import reports as P
from vademecum.operators import retrieval as R
from vademecum.operators.ranges import numbered
from vademecum.plans.handbook import whole_chunks as chunks
from vademecum.plans import sql as S
from vademecum.plans.registry import query, table
from vademecum.plans.score_queries import _Q, _V, corpus as vector_corpus, queries as vector_queries
from vademecum.plans.sql import handbook_sql
from vademecum.plans.text_queries import ordinals

_NAME = "p_name || ' ' || translate(CAST(p_partkey AS STRING), '0123456789', 'abcdefghij')"
_REQ = f"req AS (SELECT p_partkey AS request_id, p_size, {_NAME} AS canonical, lag({_NAME}) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS prev, lead({_NAME}) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS next FROM part)"


def requests(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS request_id", "p_size", f"{_NAME} AS canonical", f"lag({_NAME}) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS prev",
        f"lead({_NAME}) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS next",
    )


def others(spark, sf_dir):
    """Of every request the drug before, the one after and one that doesn't exist, resolved exactly."""
    named = requests(spark, sf_dir)
    asked = named.select("request_id", F.explode(F.array(F.upper("prev"), F.col("next"), F.lit("no such drug"))).alias("other")).where("other IS NOT NULL")
    return N.resolve_exact(asked, N.canonical(named, "canonical"), "other")


@query(f"WITH {_REQ} SELECT request_id, canonical FROM req")
def j9_exact_names(spark, sf_dir):
    named = requests(spark, sf_dir)
    messy = named.select("request_id", F.concat(F.lit("  "), F.upper(F.replace("canonical", F.lit(" "), F.lit("   ")))).alias("drug"))
    return N.resolve_exact(messy, N.canonical(named, "canonical"), "drug").select("request_id", "canonical")


def _misspelled(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), F.expr("CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN left(p_name, length(p_name) - 1) ELSE left(p_name, 5) END").alias("query"))
    return N.resolve(rows, N.canonical(names, "p_name"))


@query()
def j10_fuzzy_names(spark, sf_dir):
    return _misspelled(spark, sf_dir).select("request_id", "query", "canonical", "exact")


@query()
def t6_fuzzy_suggestions(spark, sf_dir):
    return _misspelled(spark, sf_dir).where("canonical IS NULL").select("request_id", "query", F.array_join("suggestions", ",").alias("suggestions"))


_FETCH = "c.section_type IN ('indications', 'drug_interactions')"


@query(handbook_sql(f"SELECT r.request_id, c.logical_key FROM req r JOIN ck c ON c.drug_name = r.canonical WHERE {_FETCH}", _REQ))
def j8_section_fetch(spark, sf_dir):
    return P.fetch_sections(requests(spark, sf_dir), chunks(spark, sf_dir), ["indications", "drug_interactions"]).select("request_id", "logical_key")


@query(handbook_sql("SELECT r.request_id, c.logical_key, md5(c.text) AS text_md5 FROM req r JOIN ck c ON c.drug_name = r.canonical WHERE c.section_type = 'doses'", _REQ))
def p13_exact_section_fetch(spark, sf_dir):
    return P.fetch_sections(requests(spark, sf_dir), chunks(spark, sf_dir), ["doses"]).select("request_id", "logical_key", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(handbook_sql("SELECT r.request_id, c.logical_key, CAST(row_number() OVER (PARTITION BY r.request_id ORDER BY c.section_type DESC, c.logical_key) AS INT) AS place FROM req r JOIN ck c ON c.drug_name = r.canonical WHERE " + _FETCH, _REQ))
def o1_section_union(spark, sf_dir):
    """Two sections of a drug one after the other, by the section's rank and then the key's order."""
    return P.fetch_sections(requests(spark, sf_dir), chunks(spark, sf_dir), ["indications", "drug_interactions"]).select("request_id", "logical_key", "place")


_OTHER = "oth AS (SELECT request_id, prev AS other_drug FROM req WHERE prev IS NOT NULL UNION SELECT request_id, next FROM req WHERE next IS NOT NULL)"
_MENTION = "men AS (SELECT r.request_id, o.other_drug, c.logical_key FROM req r JOIN ck c ON c.drug_name = r.canonical JOIN oth o ON o.request_id = r.request_id WHERE c.section_type IN ('contraindications', 'drug_interactions') AND contains(lower(c.text), lower(o.other_drug)))"


@query(handbook_sql("SELECT request_id, other_drug, logical_key FROM men", _REQ, _OTHER, _MENTION))
def j11_interaction_mentions(spark, sf_dir):
    passages = P.fetch_sections(requests(spark, sf_dir), chunks(spark, sf_dir), ["contraindications", "drug_interactions"])
    return P.mentions(requests(spark, sf_dir), passages, others(spark, sf_dir)).select("request_id", "other_drug", "logical_key")


@query(f"WITH {_REQ} SELECT request_id, 'no such drug' AS other FROM req")
def j12_unresolved_drugs(spark, sf_dir):
    return others(spark, sf_dir).where("canonical IS NULL").select("request_id", "other")


_REPORT = """SELECT r.request_id, r.canonical, coalesce((SELECT string_agg(c.logical_key, ',' ORDER BY c.logical_key) FROM ck c WHERE c.drug_name = r.canonical AND c.section_type = 'drug_interactions'), '') AS interactions,
  coalesce((SELECT string_agg(m.other_drug || '=' || m.logical_key, ';' ORDER BY m.other_drug) FROM men m WHERE m.request_id = r.request_id), '') AS flagged, 'no such drug' AS unresolved FROM req r"""


def _shown(rows):
    keys = lambda c: F.array_join(F.transform(c, lambda x: x["logical_key"]), ",")
    flagged = F.array_join(F.transform("flagged", lambda f: F.concat(f["other_drug"], F.lit("="), keys(f["passages"]))), ";")
    return rows.select("request_id", "canonical", keys("interactions").alias("interactions"), flagged.alias("flagged"), F.array_join("unresolved_other_drugs", ",").alias("unresolved"))


@query(handbook_sql(_REPORT, _REQ, _OTHER, _MENTION))
def a18_contraindication_report(spark, sf_dir):
    return _shown(P.contraindications(requests(spark, sf_dir).select("request_id", "canonical"), chunks(spark, sf_dir), others(spark, sf_dir)))


@query(handbook_sql(_REPORT + " UNION ALL SELECT -1, NULL, '', '', ''", _REQ, _OTHER, _MENTION))
def g7_contraindication_job(spark, sf_dir):
    """The batch job from free-form names: requests are resolved before the report, and one for an unknown drug is
    answered too."""
    named = requests(spark, sf_dir)
    asked = named.select("request_id", F.upper("canonical").alias("drug")).unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("request_id"), F.lit("zzzz zzzz zzzz zzzz zzzz zzzz zzzz zzzz zzzz zzzz zzzz zzzz zzzz zzzz").alias("drug")))
    resolved = P.resolved_requests(asked, N.canonical(named, "canonical"))
    return _shown(P.contraindications(resolved, chunks(spark, sf_dir), others(spark, sf_dir)))


_SPECIES = "CASE request_id % 3 WHEN 0 THEN 'Dogs' WHEN 1 THEN 'horse' END"


def _indications(spark, sf_dir):
    asked = requests(spark, sf_dir).select("request_id", "canonical", F.expr(_SPECIES).alias("species"))
    return P.indications(asked, chunks(spark, sf_dir).drop("book_id"))


_IND = """SELECT r.request_id, c.logical_key, CASE r.request_id % 3 WHEN 0 THEN 'dog' WHEN 1 THEN 'horse' END AS want_species,
  CAST(row_number() OVER (PARTITION BY r.request_id ORDER BY CASE WHEN r.request_id % 3 = 2 OR list_contains(c.species, 'all') OR list_contains(c.species, CASE r.request_id % 3 WHEN 0 THEN 'dog' WHEN 1 THEN 'horse' END) THEN 0 ELSE 1 END, c.logical_key) AS INT) AS place
  FROM req r JOIN ck c ON c.drug_name = r.canonical WHERE c.section_type = 'indications'"""


@query(handbook_sql(_IND, _REQ))
def t5_soft_species_order(spark, sf_dir):
    return _indications(spark, sf_dir).select("request_id", "logical_key", "want_species", "place")


_IND_REPORT = f"SELECT r.request_id, CASE r.request_id % 3 WHEN 0 THEN 'dog' WHEN 1 THEN 'horse' END AS want_species, coalesce(i.passages, '') AS passages FROM req r LEFT JOIN (SELECT request_id, string_agg(logical_key, ',' ORDER BY place) AS passages FROM ({_IND}) GROUP BY 1) i USING (request_id)"


def _shown_indications(rows):
    return rows.select("request_id", "want_species", F.array_join(F.transform("passages", lambda x: x["logical_key"]), ",").alias("passages"))


@query(handbook_sql(_IND_REPORT, _REQ))
def a19_indication_report(spark, sf_dir):
    asked = requests(spark, sf_dir).select("request_id", "canonical", F.expr(_SPECIES).alias("species"))
    return _shown_indications(P.indication_report(asked, _indications(spark, sf_dir)))


@query(handbook_sql(_IND_REPORT, _REQ))
def g8_indication_job(spark, sf_dir):
    """The batch job from free-form names."""
    from vademecum.jobs.run import indication_reports

    asked = requests(spark, sf_dir).select("request_id", F.upper("canonical").alias("drug"), F.expr(_SPECIES).alias("species"))
    rows = chunks(spark, sf_dir).drop("book_id")
    known = rows.unionByName(requests(spark, sf_dir).select(F.col("canonical").alias("drug_name")), allowMissingColumns=True)
    return _shown_indications(indication_reports(asked, known))


@query("SELECT source || '|' || lang || '|all|' || n AS logical_key, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY n) AS INT) AS place FROM (SELECT source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS n FROM documents)")
def t4_section_order(spark, sf_dir):
    rows = ordinals(spark, sf_dir).selectExpr("source", "lang", "concat(source, '|', lang, '|all|', CAST(ordinal AS STRING)) AS logical_key")
    placed = numbered(rows, ["source", "lang"], R.section_order(F.col("logical_key")), "place")
    return placed.select("logical_key", F.col("place").cast("int").alias("place"))


# Labelled query sets

_TARGETS = "tg AS (SELECT DISTINCT section_type AS section, drug_name AS drug, species FROM ck)"
_CASES = "cs AS (SELECT drug || '|' || section || '|' || array_to_string(species, '+') AS case_id, upper(drug) AS drug, section, CASE length(drug) % 3 WHEN 0 THEN [] WHEN 1 THEN ['dog'] ELSE species END AS want_species FROM tg)"


def _cases(rows):
    key = F.concat_ws("|", "drug", "section", F.array_join("species", "+"))
    want = F.when(F.length("drug") % 3 == 0, F.array().cast("array<string>")).when(F.length("drug") % 3 == 1, F.array(F.lit("dog"))).otherwise(F.col("species"))
    return E.targets(rows).select(key.alias("case_id"), F.upper("drug").alias("drug"), "section", want.alias("want_species"))


@query(handbook_sql("SELECT case_id, logical_key FROM cs JOIN ck ON lower(cs.drug) = lower(ck.drug_name) AND cs.section = ck.section_type AND (len(want_species) = 0 OR list_has_any(want_species, ck.species) OR list_contains(ck.species, 'all'))", _TARGETS, _CASES))
def j7_ground_truth(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    return E.ground_truth(_cases(rows), rows)


@query(handbook_sql("SELECT section, drug, array_to_string(species, '+') AS species FROM tg", _TARGETS))
def a20_distinct_targets(spark, sf_dir):
    return E.targets(chunks(spark, sf_dir)).select("section", "drug", F.array_join("species", "+").alias("species"))


@query(handbook_sql("SELECT section, drug, array_to_string(species, '+') AS species, CAST(row_number() OVER (PARTITION BY section ORDER BY drug, array_to_string(species, '+')) AS INT) AS place FROM tg", _TARGETS))
def t7_sorted_targets(spark, sf_dir):
    from pyspark.sql import Window

    rows = E.targets(chunks(spark, sf_dir)).withColumn("species", F.array_join("species", "+"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy("drug", "species")))


_BUCKET = "CASE WHEN len(species) > 0 AND len(list_filter(species, lambda s: s NOT IN ('dog', 'cat'))) = 0 THEN 'companion' WHEN list_distinct(species) = ['all'] THEN 'generic' ELSE 'other' END"
_FLOW = f"fl AS (SELECT drug, section, species, {S.mapping({s: f for f, s in V.FLOW_SECTIONS.items()})}[section] AS flow, array_to_string(species, '+') AS signature, {_BUCKET} AS bucket FROM tg)"
_SHUFFLE = "md5('7' || flow || drug)"


def _rr(source: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY flow ORDER BY turn, signature) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY flow, signature ORDER BY {_SHUFFLE}, drug) AS turn FROM {source})"


PER_FLOW, FRACTION = 40, 0.25
_SAMPLED = [
    f"n AS (SELECT flow, count(*) FILTER (bucket = 'other') AS n_other, count(*) FILTER (bucket <> 'other') AS n_main FROM fl WHERE flow IS NOT NULL GROUP BY flow)",
    f"q AS (SELECT flow, least(n_other, greatest(1, round_even({PER_FLOW * FRACTION}, 0)))::INT AS quota, n_main FROM n)",
    f"o AS ({_rr('''(SELECT * FROM fl WHERE bucket = 'other' AND flow IS NOT NULL)''')})",
    f"m AS ({_rr('''(SELECT * FROM fl WHERE bucket <> 'other' AND flow IS NOT NULL)''')})",
    "lo AS (SELECT o.drug, o.section, o.species, o.flow, o.signature, o.bucket FROM o JOIN q USING (flow) WHERE pick > quota)",
    f"lr AS ({_rr('lo')})",
    f"""sm AS (SELECT flow, drug, section, species, signature, 0 AS part, pick FROM o JOIN q USING (flow) WHERE pick <= quota
      UNION ALL SELECT flow, drug, section, species, signature, 1, pick FROM m JOIN q USING (flow) WHERE pick <= {PER_FLOW} - quota
      UNION ALL SELECT flow, drug, section, species, signature, 2, pick FROM lr JOIN q USING (flow) WHERE pick <= greatest(0, {PER_FLOW} - quota - n_main))""",
]


def _flow_targets(rows):
    names = F.create_map(*[F.lit(x) for f, s in V.FLOW_SECTIONS.items() for x in (s, f)])
    found = E.targets(rows).withColumn("flow", F.try_element_at(names, F.col("section"))).where("flow IS NOT NULL")
    return found.withColumn("signature", F.array_join("species", "+")).withColumn("bucket", text.species_bucket("species"))


def _shuffle():
    return F.md5(F.concat(F.lit("7"), F.col("flow"), F.col("drug")).cast("binary"))


@query(handbook_sql(f"SELECT flow, drug, signature, CAST(pick AS INT) AS pick FROM ({_rr('(SELECT * FROM fl WHERE flow IS NOT NULL)')}) WHERE pick <= 30", _TARGETS, _FLOW))
def w7_round_robin(spark, sf_dir):
    rows = E.round_robin(_flow_targets(chunks(spark, sf_dir)), ["flow"], "signature", _shuffle(), ["drug"], 30)
    return rows.select("flow", "drug", "signature", "pick")


@query(handbook_sql("SELECT flow, drug, signature, part, CAST(pick AS INT) AS pick FROM sm", _TARGETS, _FLOW, *_SAMPLED))
def w8_stratified_quota(spark, sf_dir):
    return E.sample_targets(_flow_targets(chunks(spark, sf_dir)), PER_FLOW, FRACTION, _shuffle(), ["drug"]).select("flow", "drug", "signature", "part", "pick")


@query(handbook_sql("SELECT flow, drug, signature FROM fl WHERE bucket = 'companion' UNION ALL SELECT flow, drug, signature FROM fl WHERE bucket = 'generic'", _TARGETS, _FLOW))
def o2_primary_pool(spark, sf_dir):
    rows = _flow_targets(chunks(spark, sf_dir)).select("flow", "drug", "signature", "bucket")
    return rows.where("bucket = 'companion'").unionByName(rows.where("bucket = 'generic'")).drop("bucket")


@query(handbook_sql("SELECT flow, drug, signature FROM lo", _TARGETS, _FLOW, *_SAMPLED))
def o3_leftover(spark, sf_dir):
    rows = _flow_targets(chunks(spark, sf_dir)).where("bucket = 'other'")
    picked = E.sample_targets(_flow_targets(chunks(spark, sf_dir)), PER_FLOW, FRACTION, _shuffle(), ["drug"]).where("part = 0")
    return rows.join(picked, ["flow", "drug", "signature"], "left_anti").select("flow", "drug", "signature")


_G9 = """SELECT s.flow || '|' || s.drug || '|' || s.signature AS case_id, 'Q: ' || s.drug || '/' || s.section || '/' || s.signature AS query, s.flow,
  string_agg(c.logical_key, ',' ORDER BY c.logical_key) AS keys FROM sm s JOIN ck c ON lower(s.drug) = lower(c.drug_name) AND s.section = c.section_type
  AND (len(s.species) = 0 OR list_has_any(s.species, c.species) OR list_contains(c.species, 'all')) GROUP BY ALL"""


@query(handbook_sql(_G9, _TARGETS, _FLOW, *_SAMPLED))
def g9_build_eval_set(spark, sf_dir):
    rows = E.build_eval_set(chunks(spark, sf_dir), V.FLOW_SECTIONS, PER_FLOW, 7, FRACTION, "logical_key")
    return rows.select("case_id", "query", "flow", F.array_join("relevant_logical_keys", ",").alias("keys"))


@query(handbook_sql(f"SELECT query, flow FROM ({_G9})", _TARGETS, _FLOW, *_SAMPLED))
def u4_template_phraser(spark, sf_dir):
    return g9_build_eval_set(spark, sf_dir).select("query", "flow")


# Retrieval requests

_ASK = "SELECT conv_id, turn, CASE WHEN conv_id % 10 = 0 THEN '  ' ELSE text END AS query, CAST(turn * 7 % 25 AS INT) AS top_k, CASE conv_id % 4 WHEN 0 THEN 'doses' WHEN 1 THEN 'bogus' END AS section FROM {conversations}"


@query(
    f"""SELECT conv_id, turn, CASE WHEN query IS NULL OR trim(query) = '' THEN 'query must not be blank' WHEN top_k < 1 OR top_k > 20 THEN 'top_k out of range'
    WHEN section IS NOT NULL AND section NOT IN ({', '.join(map(S.quoted, V.SECTION_TYPES))}) THEN 'unknown section' END AS problem FROM ({_ASK.format(conversations='conversations')})"""
)
def p14_request_validation(spark, sf_dir):
    rows = spark.sql(_ASK, conversations=table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", R.request_problem(F.col("query"), F.col("top_k"), F.col("section")).alias("problem"))


_RQ = """rq AS (SELECT query_id AS request_id, query_vector, CASE WHEN query_id % 100 = 0 THEN 'drug ' || query_label END AS want_drug, CASE WHEN query_id % 150 = 0 THEN 'doses' END AS want_section,
  CASE query_id % 200 WHEN 0 THEN 'dog' WHEN 50 THEN 'unicorn' END AS want_species, CAST(query_id % 7 + 1 AS INT) AS top_k FROM q)"""
_HITS = """hits AS (SELECT * FROM (SELECT r.request_id, r.top_k, v.logical_key, CAST(row_number() OVER (PARTITION BY r.request_id ORDER BY list_dot_product(r.query_vector, v.vector) DESC, v.logical_key) AS INT) AS rank
  FROM rq r JOIN v ON (r.want_drug IS NULL OR v.drug_name = r.want_drug) AND (r.want_section IS NULL OR v.section_type = r.want_section) AND (r.want_species IS NULL OR list_contains(v.species, r.want_species))) WHERE rank <= top_k)"""


def _retrieve(spark, sf_dir):
    rows = vector_corpus(spark, sf_dir).withColumn("book_page", F.lit(1)).withColumn("text", F.col("logical_key"))
    asked = vector_queries(rows).select(
        F.col("query_id").alias("request_id"), F.lit("find").alias("query"), "query_vector", F.when(F.col("query_id") % 100 == 0, F.concat(F.lit(" DRUG  "), F.col("query_label").cast("string"))).alias("drug"),
        F.when(F.col("query_id") % 150 == 0, "doses").alias("section"), F.expr("CASE query_id % 200 WHEN 0 THEN 'Dogs' WHEN 50 THEN ' Unicorn ' END").alias("species"), (F.col("query_id") % 7 + 1).cast("int").alias("top_k"),
    )
    return R.retrieve(asked, rows, N.canonical(rows))


@query(f"WITH {_V}, {_Q}, {_RQ}, {_HITS} SELECT request_id, rank, logical_key FROM hits")
def t2_batched_retrieval(spark, sf_dir):
    return _retrieve(spark, sf_dir)[0].select("request_id", "rank", "logical_key")


@query(
    f"""WITH {_V}, {_Q}, {_RQ}, {_HITS} SELECT request_id, concat_ws(';', 'drug=' || want_drug, 'section=' || want_section, 'species=' || want_species) AS filters FROM rq
    WHERE request_id NOT IN (SELECT request_id FROM hits)"""
)
def p15_empty_results(spark, sf_dir):
    shown = F.array_join(F.transform(F.map_entries("filters"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return _retrieve(spark, sf_dir)[1].select("request_id", shown.alias("filters"))


@query(f"WITH {_V}, {_Q}, {_RQ}, {_HITS} SELECT request_id, rank, logical_key FROM hits UNION ALL SELECT request_id, 0, 'empty' FROM rq WHERE request_id NOT IN (SELECT request_id FROM hits)")
def g5_retrieve(spark, sf_dir):
    hits, empty, rejects = _retrieve(spark, sf_dir)
    rows = hits.select("request_id", "rank", "logical_key").unionByName(empty.select("request_id", F.lit(0).alias("rank"), F.lit("empty").alias("logical_key")))
    return rows.unionByName(rejects.select("request_id", F.lit(-1).alias("rank"), F.col("problem").alias("logical_key")))


# Dosing

_LOW = "CASE l_linenumber % 5 WHEN 0 THEN '0' WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS STRING) WHEN 2 THEN 'twenty' WHEN 3 THEN CAST(CAST(l_quantity AS INT) AS STRING) || '.50' ELSE CASE WHEN l_suppkey % 2 = 0 THEN '10001' ELSE '2.5' END END"
_HIGH = "CASE WHEN l_suppkey % 3 = 0 THEN CAST(CAST(l_quantity AS INT) + 5 AS STRING) END"


@query(
    f"""SELECT * FROM (SELECT l_orderkey, l_linenumber, l_suppkey, {_LOW} AS given, TRY_CAST({_LOW} AS DECIMAL(11,6)) AS low, TRY_CAST({_HIGH} AS DECIMAL(11,6)) AS high FROM lineitem)
    WHERE low > 0 AND low <= 10000 AND (high IS NULL OR high > 0 AND high <= 10000)"""
)
def p19_regimen_parsing(spark, sf_dir):
    json = f"concat('[{{\"indication\":\"pain\",\"mg_per_kg_low\":\"', {_LOW}, '\",\"mg_per_kg_high\":', coalesce(concat('\"', {_HIGH}, '\"'), 'null'), ',\"route\":\"PO\",\"frequency\":\"q12h\"}}]') AS regimens_json"
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey", json)
    return D.parsed_regimens(rows).select("l_orderkey", "l_linenumber", "l_suppkey", F.col("mg_per_kg_low").alias("given"), "low", "high")


@query(
    f"""SELECT request_id, concat_ws('|', indication, low) AS regimen FROM (SELECT l_orderkey AS request_id, l_linenumber, 'pain ' || l_returnflag AS indication, {_LOW} AS low FROM lineitem) WHERE TRY_CAST(low AS DECIMAL(11,6)) > 0 AND TRY_CAST(low AS DECIMAL(11,6)) <= 10000"""
)
def u3_regimen_extractor(spark, sf_dir):
    """Candidate regimens from a table, as an extractor would give them, through the JSON seam."""
    regimen = F.struct(F.concat(F.lit("pain "), F.col("l_returnflag")).alias("indication"), F.expr(_LOW).alias("mg_per_kg_low"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.to_json(F.array(regimen)).alias("regimens_json"))
    return D.parsed_regimens(rows).select("request_id", F.concat_ws("|", "indication", "mg_per_kg_low").alias("regimen"))


_PASSAGE = "concat('Give ', CAST(CAST(l_quantity AS INT) AS STRING), '.0 mg/kg up to ', CAST(CAST(l_quantity AS INT) + 5 AS STRING), CASE WHEN l_linenumber % 2 = 0 THEN ' mg/kg' ELSE '.' END)"
_NUM = "CASE l_linenumber % 4 WHEN 0 THEN CAST(CAST(l_quantity AS INT) AS STRING) WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS STRING) || '.0' WHEN 2 THEN CAST(CAST(l_quantity AS INT) + 5 AS STRING) ELSE CAST(CAST(l_quantity AS INT) + 5 AS STRING) || '.0' END"


def _in_text(number: str, passage: str) -> str:
    short = f"regexp_replace(regexp_replace({number}, '^(-?\\d+\\.\\d*?)0+$', '\\1'), '\\.$', '')"
    one = lambda n: f"regexp_matches({passage}, '(^|[^0-9.])' || replace({n}, '.', '\\.') || '($|[^0-9.])')"
    return f"({one(number)} OR {one(short)})"


@query(f"SELECT l_orderkey, l_linenumber, l_suppkey, {_in_text('n', 't')} AS grounded FROM (SELECT *, {_NUM} AS n, {_PASSAGE} AS t FROM lineitem)")
def p20_grounding(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey", f"{_NUM} AS n", f"{_PASSAGE} AS t")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", text.number_in_text("n", "t").alias("grounded"))


@query("SELECT p_partkey, p_size % 3 = 0 OR CAST(p_size % 10 AS DECIMAL(11,6)) > CAST(p_size % 7 AS DECIMAL(11,6)) AS ordered FROM part")
def p21_range_order(spark, sf_dir):
    low, high = F.expr("CAST(p_size % 7 AS DECIMAL(11,6))"), F.expr("CASE WHEN p_size % 3 <> 0 THEN CAST(p_size % 10 AS DECIMAL(11,6)) END")
    return table(spark, sf_dir, "part").select("p_partkey", D.range_ordered(low, high).alias("ordered"))


_ASKED = "CASE p_size % 4 WHEN 0 THEN upper(substring(p_type, 1, 4)) WHEN 1 THEN '  ' WHEN 2 THEN concat('for ', p_type, ' use') ELSE 'zzz' END"


@query(f"SELECT p_partkey, length(a) > 0 AND (contains(b, a) OR contains(a, b)) AS matches FROM (SELECT p_partkey, lower(trim({_ASKED})) AS a, lower(trim(p_type)) AS b FROM part)")
def p22_indication_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.indication_matches(F.expr(_ASKED), F.col("p_type")).alias("matches"))


_WEIGHT = "CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN l_quantity WHEN 2 THEN l_quantity * 200 ELSE -1 END"
_UNIT = "CASE l_suppkey % 3 WHEN 0 THEN 'kg' WHEN 1 THEN 'lb' ELSE 'stone' END"


@query(
    f"""SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN w <= 0 THEN 'weight must be over 0' WHEN w > 5000 THEN 'weight is too large' WHEN u = 'stone' THEN 'unknown unit' END AS problem
    FROM (SELECT *, CAST({_WEIGHT} AS DECIMAL(14,6)) AS w, {_UNIT} AS u FROM lineitem)"""
)
def p23_weight_bounds(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey", f"CAST({_WEIGHT} AS DECIMAL(14,6)) AS w", f"{_UNIT} AS u")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", identity.weight_problem(F.col("w"), F.col("u")).alias("problem"))


@query("SELECT p_partkey, p_size % 3 <> 0 AND p_size * 300 <= 10000 AS valid FROM part")
def p24_rule_validity(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_size % 3 = 0 THEN array() ELSE array('dog') END AS species", "CAST(p_size * 300 AS DECIMAL(11,6)) AS low")
    return rows.select("p_partkey", ((F.size("species") > 0) & (F.col("low") > 0) & (F.col("low") <= V.MAX_MG_PER_KG)).alias("valid"))


_VR = "vr AS (SELECT o_orderkey AS request_id, CASE o_orderkey % 4 WHEN 1 THEN 'Flag R' WHEN 2 THEN ' FLAG ' WHEN 3 THEN 'zzz' END AS indication, o_orderkey % 7 = 0 AS all_regimens FROM orders)"
_VG = "vg AS (SELECT l_orderkey AS request_id, 'flag ' || lower(l_returnflag) AS ri, l_linenumber % 3 <> 0 AS g, l_linenumber, l_suppkey, l_tax FROM lineitem)"
_VC = """vc AS (SELECT r.*, coalesce(count(g.ri) FILTER (g.g), 0) AS v, coalesce(count(g.ri) FILTER (NOT g.g), 0) AS d,
  coalesce(count(g.ri) FILTER (g.g AND (contains(g.ri, lower(trim(r.indication))) OR contains(lower(trim(r.indication)), g.ri))), 0) AS m,
  string_agg(g.ri, ',' ORDER BY g.ri) FILTER (g.g) AS every, string_agg(g.ri, ',' ORDER BY g.ri) FILTER (g.g AND (contains(g.ri, lower(trim(r.indication))) OR contains(lower(trim(r.indication)), g.ri))) AS own
  FROM vr r LEFT JOIN vg g USING (request_id) GROUP BY ALL)"""
_VK = """vk AS (SELECT *, CASE WHEN v = 0 THEN 'needs_clarification' WHEN all_regimens THEN 'dose_rule_set' WHEN indication IS NOT NULL AND m = 1 OR indication IS NULL AND v = 1 THEN 'dose_rule' ELSE 'needs_clarification' END AS kind FROM vc)"""


def _verdicts(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS request_id", "CASE o_orderkey % 4 WHEN 1 THEN 'Flag R' WHEN 2 THEN ' FLAG ' WHEN 3 THEN 'zzz' END AS indication", "o_orderkey % 7 = 0 AS all_regimens")
    regimens = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS request_id", "concat('flag ', lower(l_returnflag)) AS regimen_indication", "l_linenumber % 3 <> 0 AS is_grounded")
    return D.verdicts(asked, regimens)


@query(
    f"""WITH {_VR}, {_VG}, {_VC}, {_VK} SELECT request_id, kind, CASE WHEN v = 0 AND d > 0 THEN d || ' extracted regimen(s) failed the grounding check' WHEN v = 0 THEN 'no dose regimens could be extracted'
    WHEN kind <> 'needs_clarification' THEN NULL WHEN indication IS NOT NULL AND m = 0 THEN 'no regimen matches the indication' WHEN indication IS NOT NULL THEN 'multiple regimens match the indication' ELSE 'multiple regimens in passage' END AS reason,
    coalesce(CASE WHEN v = 0 THEN '' WHEN indication IS NOT NULL AND m > 0 AND NOT all_regimens THEN own ELSE every END, '') AS candidates FROM vk"""
)
def a17_regimen_verdict(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("request_id", "kind", "reason", F.array_join("candidates", ",").alias("candidates"))


_DOSE = "CAST(CAST(o_custkey % 90 + 1 AS DECIMAL(10,6)) * CASE WHEN o_orderkey % 2 = 0 THEN CAST('0.45359237' AS DECIMAL(9,8)) ELSE CAST('1' AS DECIMAL(9,8)) END * (CAST(l_tax AS DECIMAL(11,6)) + CAST('0.5' AS DECIMAL(11,6))) AS DECIMAL(34,20))"


def _dosed(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS request_id", "CAST(o_custkey % 90 + 1 AS DECIMAL(10,6)) AS weight", "CASE WHEN o_orderkey % 2 = 0 THEN 'lb' ELSE 'kg' END AS unit")
    rules = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS request_id", "l_linenumber", "l_suppkey", "CAST(CAST(l_tax AS DECIMAL(11,6)) + CAST('0.5' AS DECIMAL(11,6)) AS DECIMAL(11,6)) AS low", "CAST(NULL AS DECIMAL(11,6)) AS high")
    return D.doses(asked.join(rules, "request_id"))


@query(f"SELECT l_orderkey AS request_id, l_linenumber, l_suppkey, CAST({_DOSE} AS VARCHAR) AS dose_mg FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def j14_dose_requests(spark, sf_dir):
    return _dosed(spark, sf_dir).select("request_id", "l_linenumber", "l_suppkey", F.col("dose_mg_low").cast("decimal(34,20)").cast("string").alias("dose_mg"))


@query(f"WITH {_VR}, {_VG}, {_VC}, {_VK} SELECT k.request_id, k.kind, l_linenumber, l_suppkey, CAST({_DOSE} AS VARCHAR) AS dose_mg FROM vk k JOIN orders ON o_orderkey = k.request_id JOIN lineitem ON l_orderkey = o_orderkey WHERE k.kind = 'dose_rule'")
def g6_dose(spark, sf_dir):
    """Verdicts chained with the doses of the requests that end in one rule."""
    ready = _verdicts(spark, sf_dir).where("kind = 'dose_rule'").select("request_id", "kind")
    rows = _dosed(spark, sf_dir).join(ready, "request_id")
    return rows.select("request_id", "kind", "l_linenumber", "l_suppkey", F.col("dose_mg_low").cast("decimal(34,20)").cast("string").alias("dose_mg"))

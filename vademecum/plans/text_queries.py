"""Queries of the scalar layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vademecum import vocabulary as V
from vademecum.functions import identity, text, vectors
from vademecum.plans import handbook
from vademecum.plans import sql as S
from vademecum.plans.registry import query, table
from vademecum.sources.tables import rewritten

H = S.HANDBOOK.format(part="part", lineitem="lineitem")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(
    f"""WITH j AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '-\\n([a-z])', '\\1', 'g'), '[ \\t]+', ' ', 'g'), chr(10)) AS l FROM documents)
    SELECT doc_id, md5({S.strip("regexp_replace(array_to_string(list_transform(l, lambda x: " + S.strip('x') + "), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS text_md5 FROM j"""
)
def p1_clean_page_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(text.clean_page("text").cast("binary")).alias("text_md5"))


_PAGE = "CASE doc_id % 4 WHEN 0 THEN concat(CAST(doc_id AS STRING), ' ', source) WHEN 1 THEN concat(source, ' ', CAST(doc_id AS STRING)) WHEN 2 THEN concat('  ', chr(10), ' ', source, '7 ') ELSE '' END"


@query(
    f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split({_PAGE.replace('STRING', 'VARCHAR')} || chr(10) || coalesce(text, ''), chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '')[1] AS t FROM documents)
    SELECT doc_id, TRY_CAST(coalesce(nullif(regexp_extract(t, '^(\\d+)\\b', 1), ''), nullif(regexp_extract(t, '\\b(\\d+)$', 1), '')) AS BIGINT) AS book_page FROM p"""
)
def p2_book_page(spark, sf_dir):
    page = F.concat(F.expr(_PAGE), F.lit("\n"), F.coalesce("text", F.lit("")))
    return docs(spark, sf_dir).select("doc_id", text.book_page(page).alias("book_page"))


@query(f"WITH h AS ({H}) SELECT book_id, page_idx, line_idx, regexp_extract(txt, {S.TOC}, 1) AS drug_name, CAST(regexp_extract(txt, {S.TOC}, 2) AS INT) AS book_page FROM h WHERE regexp_matches(txt, {S.TOC})")
def p4_toc_line_parse(spark, sf_dir):
    rows = handbook.lines(spark, sf_dir).select("book_id", "page_idx", "line_idx", text.toc_name("txt").alias("drug_name"), text.toc_page("txt").alias("book_page"))
    return rows.where("drug_name IS NOT NULL")


@query(f"WITH h AS ({H}) SELECT txt, {S.header('txt')} AS header, count(*) AS n FROM h GROUP BY 1, 2")
def p5_normalize_header(spark, sf_dir):
    return handbook.lines(spark, sf_dir).groupBy("txt", text.normalize_header("txt").alias("header")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH h AS ({H}) SELECT {S.HEADERS}[{S.header('txt')}] AS section_type, count(*) AS n FROM h GROUP BY 1")
def p6_header_section(spark, sf_dir):
    return handbook.lines(spark, sf_dir).groupBy(text.header_section("txt").alias("section_type")).agg(F.count(F.lit(1)).alias("n"))


_SHAPED = f"regexp_matches({S.strip('txt')}, {S.quoted(V.SPECIES_HEADER)})"


@query(f"WITH h AS ({H}) SELECT book_id, page_idx, line_idx, CASE WHEN {_SHAPED} THEN array_to_string({S.species('txt')}, '+') ELSE '' END AS species FROM h")
def p7_species_header(spark, sf_dir):
    return handbook.lines(spark, sf_dir).select("book_id", "page_idx", "line_idx", F.array_join(text.header_species("txt"), "+").alias("species"))


@query(f"WITH h AS ({H}) SELECT book_id, page_idx, line_idx, {_SHAPED} AND len({S.words('txt')}) > 0 AND NOT list_has_any({S.words('txt')}, {S.listing(V.NOTE_WORDS)}) AS is_header FROM h")
def p8_is_species_header(spark, sf_dir):
    return handbook.lines(spark, sf_dir).select("book_id", "page_idx", "line_idx", text.is_species_header("txt").alias("is_header"))


_MENTION = "concat(CASE doc_id % 5 WHEN 0 THEN 'Dogs and a cow; ' WHEN 1 THEN 'Small mammals. ' WHEN 2 THEN 'hotdogs, pigs ' ELSE '' END, coalesce(text, ''))"


@query(f"SELECT doc_id, array_to_string({S.species(_MENTION)}, '+') AS species FROM documents")
def p9_species_mentions(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(text.species_mentions(F.expr(_MENTION)), "+").alias("species"))


_ONE = "CASE doc_id % 5 WHEN 0 THEN ' Dogs ' WHEN 1 THEN 'Equine' WHEN 2 THEN 'dogs & cats' WHEN 3 THEN ' Unicorn ' END"


@query(
    f"""SELECT doc_id, CASE WHEN len({S.species(_ONE)}) = 1 THEN {S.species(_ONE)}[1] END AS canonical,
    coalesce(CASE WHEN len({S.species(_ONE)}) = 1 THEN {S.species(_ONE)}[1] END, lower({S.strip(_ONE)})) AS requested FROM documents"""
)
def p10_canonical_species(spark, sf_dir):
    one = F.expr(_ONE)
    return docs(spark, sf_dir).select("doc_id", text.canonical_species(one).alias("canonical"), text.requested_species(one).alias("requested"))


@query(f"SELECT doc_id, CASE WHEN len({S.species(_MENTION)}) > 0 THEN array_to_string({S.species(_MENTION)}, '+') ELSE 'all' END AS species FROM documents")
def p11_prose_species(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(text.prose_species(F.expr(_MENTION)), "+").alias("species"))


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'companion' WHEN 1 THEN 'generic' WHEN 2 THEN 'other' WHEN 3 THEN 'companion' ELSE 'other' END AS bucket FROM documents"""
)
def p17_species_bucket(spark, sf_dir):
    value = F.expr("CASE doc_id % 5 WHEN 0 THEN array('cat', 'dog') WHEN 1 THEN array('all') WHEN 2 THEN array('dog', 'swine') WHEN 3 THEN array('dog') ELSE array() END")
    return docs(spark, sf_dir).select("doc_id", text.species_bucket(value).alias("bucket"))


@query(f"SELECT doc_id, CAST(i AS BIGINT) AS line_no, md5(t) AS text_md5 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE {S.strip('t')} <> ''")
def p18_drop_blank(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "t"))
    return rows.where(F.length(text.strip("t")) > 0).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


_CHUNK = "SELECT doc_id, source AS drug_name, lang AS section_type, text, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS INT) AS ordinal FROM documents"
_KEY = "lower(drug_name) || '|' || section_type || '|cat+dog|' || ordinal"


def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and ordinal: the place of a document among those of its source and lang. Numbered by ranges,
    without texts, and kept for the session."""
    from vademecum.operators.ranges import numbered

    made = lambda: rewritten(numbered(docs(spark, sf_dir).select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"], "ordinal", 0).withColumn("ordinal", F.col("ordinal").cast("int")), "ordinals")
    return handbook._once(spark, sf_dir, "ordinals", made)


def chunk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: source is the drug, lang the section, the place among these the ordinal. Texts meet their
    ordinal by doc_id."""
    species = F.array(F.lit("dog"), F.lit("cat"))
    rows = docs(spark, sf_dir).join(ordinals(spark, sf_dir).select("doc_id", "ordinal"), "doc_id")
    return rows.select("doc_id", F.col("source").alias("drug_name"), F.col("lang").alias("section_type"), species.alias("species"), F.lit(1).alias("book_page"), "text", "ordinal")


def keyed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vademecum.operators.loading import keyed

    return keyed(chunk_corpus(spark, sf_dir))


@query(f"SELECT doc_id, {_KEY} AS logical_key FROM ({_CHUNK})")
def x1_logical_key(spark, sf_dir):
    return keyed_corpus(spark, sf_dir).select("doc_id", "logical_key")


@query(f"SELECT doc_id, sha256({_KEY} || '::' || text) AS content_hash FROM ({_CHUNK})")
def x2_content_hash(spark, sf_dir):
    return keyed_corpus(spark, sf_dir).select("doc_id", "content_hash")


def point_sql(key: str) -> str:
    digest = f"sha1(unhex('{V.POINT_NAMESPACE.replace('-', '')}') || encode({key}))"
    return (
        f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || "
        f"substr('89ab', 1 + CAST(('0x' || substr({digest}, 17, 1)) AS INT) % 4, 1) || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12)"
    )


@query(f"SELECT doc_id, {point_sql('k')} AS point_id FROM (SELECT doc_id, {_KEY} AS k FROM ({_CHUNK}))")
def x3_point_id(spark, sf_dir):
    return keyed_corpus(spark, sf_dir).select("doc_id", "point_id")


def norm_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / CASE WHEN sqrt(list_dot_product({v}, {v})) = 0 THEN 1 ELSE sqrt(list_dot_product({v}, {v})) END)"


@query(f"SELECT vec_id, array_to_string(list_transform({norm_sql('v')}, lambda x: CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR)), ',') AS unit FROM (SELECT vec_id, CAST(embedding[1:32] AS DOUBLE[]) AS v FROM embeddings)")
def x4_normalize_vector(spark, sf_dir):
    unit = F.transform(vectors.normalized(F.col("embedding"), 32), lambda x: F.round(x * 1000000).cast("bigint").cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(unit, ",").alias("unit"))


@query(f"SELECT item_id, concat(CASE WHEN item_id % 2 = 0 THEN 'query: ' ELSE '' END, text) AS prefixed FROM benchmark")
def x6_query_prefix(spark, sf_dir):
    prefix = F.expr("CASE WHEN item_id % 2 = 0 THEN 'query: ' END")
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.coalesce(prefix, F.lit("")), F.col("text")).alias("prefixed"))


@query(
    """WITH n AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(15,3)) AS VARCHAR) AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, s AS given, regexp_replace(regexp_replace(s, '^(-?\\d+\\.\\d*?)0+$', '\\1'), '\\.$', '') AS normalized FROM n"""
)
def x7_decimal_forms(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(15,3)").cast("string").alias("given"))
    return rows.withColumn("normalized", F.element_at(text.number_forms("given"), -1))


@query("SELECT p_partkey, regexp_replace(lower(trim('  ' || upper(p_name) || '  x ')), '\\s+', ' ', 'g') AS norm FROM part")
def x11_normalize_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_name(F.concat(F.lit("  "), F.upper("p_name"), F.lit("  x "))).alias("norm"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_name || '- (' || p_size || ')', '([^A-Za-z0-9_\\s-])', '\\\\\\1', 'g'), '[\\s-]+', '[\\s-]+', 'g') AS pattern FROM part".replace("'[\\s-]+', 'g') AS", "'[\\\\s-]+', 'g') AS"))
def x12_name_pattern(spark, sf_dir):
    name = F.concat("p_name", F.lit("- ("), F.col("p_size").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", text.name_pattern(name).alias("pattern"))


@query(
    """SELECT p_partkey, p_name || ': ' || (p_size || CASE WHEN p_size % 2 = 0 THEN '' ELSE '-' || (p_size + 5) END) || ' mg/kg PO q12h' || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' (' || p_type || ')' END AS described FROM part"""
)
def x13_rule_description(spark, sf_dir):
    from vademecum.operators.dosing import describe

    high, why = F.expr("CASE WHEN p_size % 2 <> 0 THEN p_size + 5 END"), F.expr("CASE WHEN p_size % 3 <> 0 THEN p_type END")
    return table(spark, sf_dir, "part").select("p_partkey", describe(F.col("p_name"), F.col("p_size"), high, F.lit("PO"), F.lit("q12h"), why).alias("described"))


@query(f"SELECT flow, {S.mapping(V.FLOW_SECTIONS)}[flow] AS section, count(*) AS n FROM (SELECT {S.listing(list(V.FLOW_SECTIONS))}[CAST(p_partkey % 8 + 1 AS INT)] AS flow FROM part) GROUP BY 1, 2")
def x14_flow_sections(spark, sf_dir):
    names = F.array(*map(F.lit, V.FLOW_SECTIONS))
    table_ = F.create_map(*[F.lit(x) for pair in V.FLOW_SECTIONS.items() for x in pair])
    rows = table(spark, sf_dir, "part").select(F.get(names, (F.col("p_partkey") % 8).cast("int")).alias("flow"))
    return rows.groupBy("flow", F.try_element_at(table_, F.col("flow")).alias("section")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, 'handbook__' || regexp_replace(regexp_replace(lower(p_brand || '/' || p_type || '.'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS table_name FROM part")
def s10_table_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.table_name(F.lit("handbook"), F.concat_ws("", "p_brand", F.lit("/"), "p_type", F.lit("."))).alias("table_name"))


_KG = "CAST(l_quantity AS DECIMAL(10,6)) * CASE WHEN l_linestatus = 'O' THEN CAST('0.45359237' AS DECIMAL(9,8)) ELSE CAST('1' AS DECIMAL(9,8)) END"


@query(f"SELECT l_orderkey, l_linenumber, CAST(({_KG}) AS DECIMAL(20,14)) AS weight_kg FROM lineitem")
def x8_weight_kg(spark, sf_dir):
    unit = F.when(F.col("l_linestatus") == "O", "lb").otherwise("kg")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", identity.weight_kg(F.col("l_quantity").cast("decimal(10,6)"), unit).alias("weight_kg"))


@query(f"SELECT l_orderkey, l_linenumber, CAST(({_KG}) * (CAST(l_tax AS DECIMAL(11,6)) + CAST(0.5 AS DECIMAL(11,6))) AS VARCHAR) AS dose_mg FROM lineitem")
def x9_dose_mg(spark, sf_dir):
    unit = F.when(F.col("l_linestatus") == "O", "lb").otherwise("kg")
    kg = identity.weight_kg(F.col("l_quantity").cast("decimal(10,6)"), unit)
    rate = F.col("l_tax").cast("decimal(11,6)") + F.lit("0.5").cast("decimal(11,6)")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", identity.dose_mg(kg, rate).cast("string").alias("dose_mg"))

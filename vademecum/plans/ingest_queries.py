"""Queries of ingestion over the derived handbook."""

from __future__ import annotations

from pyspark.sql import functions as F

from vademecum.functions import text
from vademecum.operators import ingest as I
from vademecum.operators.splitting import split_long
from vademecum.plans import handbook
from vademecum.plans.registry import query, table
from vademecum.plans.sql import STEPS, handbook_sql

H = STEPS["h"]


def run(spark, sf_dir):
    return handbook.ingestion(spark, sf_dir)


@query(f"WITH h AS ({H}) SELECT book_id, page_idx, md5(string_agg(txt, chr(10) ORDER BY line_idx)) AS text_md5 FROM h GROUP BY book_id, page_idx")
def s1_read_pages(spark, sf_dir):
    return handbook.pages(spark, sf_dir).select("book_id", "page_idx", F.md5(F.col("raw_text").cast("binary")).alias("text_md5"))


@query(f"WITH h AS ({H}) SELECT book_id, page_idx = 0 AS is_toc, CASE WHEN page_idx = 0 THEN 0 ELSE page_idx - 1 END AS page_idx, count(*) AS n_lines FROM h GROUP BY ALL")
def p3_toc_page_range(spark, sf_dir):
    toc, body = I.split_toc(I.clean_pages(handbook.pages(spark, sf_dir)), 0, 0)
    n = F.size(F.split("text", "\n")).cast("bigint").alias("n_lines")
    return toc.select("book_id", F.lit(True).alias("is_toc"), "page_idx", n).unionByName(body.select("book_id", F.lit(False).alias("is_toc"), "page_idx", n))


@query(handbook_sql("SELECT book_id, toc_ord, drug_name, book_page FROM entries"))
def w1_toc_dedupe(spark, sf_dir):
    return run(spark, sf_dir).entries


@query(handbook_sql("SELECT book_id, book_page, page_idx FROM pm"))
def a1_first_page_index(spark, sf_dir):
    return I.page_map(run(spark, sf_dir).pages)


@query(handbook_sql("SELECT a.book_id, a.toc_ord, a.exact AS page_idx FROM a0 a"))
def j1_page_anchor_join(spark, sf_dir):
    r = run(spark, sf_dir)
    joined = r.entries.join(I.page_map(r.pages), ["book_id", "book_page"], "left")
    return joined.select("book_id", "toc_ord", "page_idx")


@query(handbook_sql("SELECT book_id, toc_ord, anchor, interpolated FROM anch"))
def j2_nearest_page(spark, sf_dir):
    return run(spark, sf_dir).anchored.select("book_id", "toc_ord", "anchor", "interpolated")


@query(handbook_sql("SELECT book_id, toc_ord, start_line FROM located"))
def j3_heading_location(spark, sf_dir):
    return run(spark, sf_dir).located.select("book_id", "toc_ord", F.col("start_line").cast("bigint").alias("start_line"))


@query(handbook_sql("SELECT book_id, mono_ord, start_line, end_line FROM spans"))
def w2_monograph_spans(spark, sf_dir):
    return run(spark, sf_dir).spans.select("book_id", "mono_ord", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


@query(handbook_sql("SELECT book_id, mono_ord, line_no, md5(line) AS line_md5 FROM ml"))
def j4_line_assignment(spark, sf_dir):
    rows = run(spark, sf_dir).lines
    return rows.select("book_id", "mono_ord", F.col("line_no").cast("bigint").alias("line_no"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query(handbook_sql("SELECT book_id, toc_ord, drug_name FROM located WHERE start_line IS NULL"))
def j5_missing_headings(spark, sf_dir):
    return I.missing(run(spark, sf_dir).located).select("book_id", "toc_ord", "drug_name")


@query(handbook_sql("SELECT book_id, mono_ord, line_no, section_ord, section_type FROM sl"))
def w3_section_ids(spark, sf_dir):
    rows = run(spark, sf_dir).section_lines
    return rows.select("book_id", "mono_ord", F.col("line_no").cast("bigint").alias("line_no"), F.col("section_ord").cast("bigint").alias("section_ord"), "section_type")


@query(handbook_sql("SELECT book_id, mono_ord, section_ord, section_type, md5(text) AS text_md5 FROM sec"))
def a2_section_text(spark, sf_dir):
    return run(spark, sf_dir).sections.select("book_id", "mono_ord", F.col("section_ord").cast("bigint").alias("section_ord"), "section_type", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(handbook_sql("SELECT book_id, mono_ord, line_no, group_ord, array_to_string(species, '+') AS species FROM sr WHERE st"))
def w4_species_runs(spark, sf_dir):
    rows = run(spark, sf_dir).section_lines.where("section_type = 'doses'")
    species = text.header_species("line")
    starts = rows.where((F.size(species) > 0) | text.is_species_header("line"))
    order = F.expr("row_number() OVER (PARTITION BY book_id, mono_ord, section_ord ORDER BY line_no)")
    named = F.when(F.size(species) > 0, F.array_join(species, "+")).otherwise("unspecified")
    return starts.select("book_id", "mono_ord", F.col("line_no").cast("bigint").alias("line_no"), order.cast("bigint").alias("group_ord"), named.alias("species"))


@query(handbook_sql("SELECT book_id, mono_ord, section_ord, group_ord, array_to_string(species, '+') AS species, md5(text) AS text_md5 FROM dg"))
def a3_species_group_text(spark, sf_dir):
    rows = run(spark, sf_dir).species_groups
    return rows.select("book_id", "mono_ord", F.col("section_ord").cast("bigint").alias("section_ord"), F.col("group_ord").cast("bigint").alias("group_ord"), F.array_join("species", "+").alias("species"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(handbook_sql("SELECT book_id, mono_ord, drug_name, string_agg(section_type || ':' || md5(text), ',' ORDER BY section_ord) AS sections FROM sec GROUP BY book_id, mono_ord, drug_name"))
def a4_nested_monographs(spark, sf_dir):
    shown = F.transform("sections", lambda s: F.concat(s["section_type"], F.lit(":"), F.md5(s["text"].cast("binary"))))
    return I.monographs(run(spark, sf_dir).sections).select("book_id", "mono_ord", "drug_name", F.array_join(shown, ",").alias("sections"))


@query(handbook_sql("SELECT book_id, mono_ord, md5(arg_min(text, section_ord) FILTER (section_type = 'doses')) AS doses_md5 FROM sec GROUP BY book_id, mono_ord"))
def p25_section_text_lookup(spark, sf_dir):
    rows = I.monographs(run(spark, sf_dir).sections)
    return rows.select("book_id", "mono_ord", F.md5(I.section_text("sections", F.lit("doses")).cast("binary")).alias("doses_md5"))


_REPORT = """SELECT l.book_id, count(*) AS toc_entries, count(l.start_line) AS drugs_parsed,
  array_to_string(list_sort(list(l.drug_name) FILTER (l.start_line IS NULL)), ',') AS missing_headings, any_value(o.odd) AS without_sections
  FROM located l LEFT JOIN (SELECT s.book_id, string_agg(s.drug_name, ',' ORDER BY s.drug_name) AS odd FROM spans s
    WHERE NOT EXISTS (SELECT 1 FROM sec WHERE sec.book_id = s.book_id AND sec.mono_ord = s.mono_ord) GROUP BY s.book_id) o ON l.book_id = o.book_id GROUP BY l.book_id"""


@query(handbook_sql(f"SELECT book_id, toc_entries, drugs_parsed, coalesce(missing_headings, '') AS missing_headings, coalesce(without_sections, '') AS without_sections FROM ({_REPORT})"))
def a5_parse_report(spark, sf_dir):
    joined = [F.array_join(c, ",").alias(c) for c in ("missing_headings", "without_sections")]
    return run(spark, sf_dir).report.select("book_id", "toc_entries", "drugs_parsed", *joined)


@query(handbook_sql("SELECT count(*) AS toc_entries, count(*) - count(start_line) AS missing, count(*) > 0 AND count(*) - count(start_line) <= 0 AS passed FROM located"))
def a6_coverage_gate(spark, sf_dir):
    return I.coverage_gate(run(spark, sf_dir).report)


@query(handbook_sql("SELECT book_id, count(DISTINCT nm) FILTER (nm <> '') AS parsed, count(*) FILTER (nm = '') AS skipped, count(*) FILTER (nm <> '') - count(DISTINCT nm) FILTER (nm <> '') AS duplicates FROM toc GROUP BY book_id"))
def a21_ingestion_counters(spark, sf_dir):
    return I.toc_counters(run(spark, sf_dir).toc_lines)


@query(handbook_sql("SELECT book_id, mono_ord, logical_key, sha256(logical_key || '::' || text) AS content_hash FROM ck"))
def w5_chunk_ordinals(spark, sf_dir):
    rows = handbook.whole_chunks(spark, sf_dir)
    return rows.select("book_id", "mono_ord", "logical_key", "content_hash")


@query()
def x10_structural_split(spark, sf_dir):
    pieces = split_long(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 1200)
    return pieces.select("doc_id", "piece_ord", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query()
def g1_ingest(spark, sf_dir):
    """The whole job from its pages, whatever ran before."""
    rows = handbook.ingest_anew(spark, sf_dir).chunks
    return rows.select("book_id", "mono_ord", "drug_name", "book_page", "section_type", F.array_join("species", "+").alias("species"), "ordinal", "logical_key", "content_hash")


@query(handbook_sql("SELECT section_type, count(*) AS sections FROM sec GROUP BY section_type"))
def s3_artifacts(spark, sf_dir):
    """Writes the artifacts to the shared folder and reads the section counts back."""
    from vademecum.sources import tables

    r = run(spark, sf_dir)
    folder = tables.scratch(spark, "artifacts")
    tables.write_artifacts(I.monographs(r.sections), r.chunks, r.report, folder)
    nested = spark.read.parquet(f"{folder}/monographs").select(F.explode("sections").alias("s"))
    return nested.groupBy(F.col("s.section_type").alias("section_type")).agg(F.count(F.lit(1)).alias("sections"))

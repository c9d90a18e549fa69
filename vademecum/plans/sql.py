"""DuckDB SQL shared by the oracles: vocabularies as literals, and a handbook derived from part and lineitem."""

from __future__ import annotations

from vademecum import vocabulary as V


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def mapping(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in table.items()) + "}"


def listing(items: list[str]) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z]+')"


def species(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform({words(x)}, lambda w: {mapping(V.SPECIES_WORDS)}[w]), lambda y: y IS NOT NULL)))"


def header(x: str) -> str:
    return f"regexp_replace(regexp_replace({strip(x)}, '\\s*/\\s*', '/', 'g'), '\\s+', ' ', 'g')"


TOC = quoted(V.TOC_ENTRY)
HEADERS = mapping(V.HEADER_SECTIONS)

#: Runs unchanged in both engines once {part} and {lineitem} are filled in: a book per brand, two entries per page.
HANDBOOK = """
WITH parts AS (
  SELECT p_partkey, p_brand AS book_id, p_type, p_size, p_name || ' ' || translate(CAST(p_partkey AS STRING), '0123456789', 'abcdefghij') AS drug_name,
         row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn
  FROM {part}),
d AS (
  SELECT *, CAST(floor((rn + 1) / 2) AS INT) AS page_idx, CAST(1000 * ((rn + 1) % 2) AS INT) AS base, lag(drug_name) OVER (PARTITION BY book_id ORDER BY rn) AS prev_name
  FROM parts),
li AS (
  SELECT d.book_id, d.page_idx, d.base, d.drug_name, l_returnflag AS flag, CAST(CAST(l_quantity AS INT) AS STRING) || ' mg/kg PO q' || CAST(4 * l_linenumber AS STRING) || 'h' AS txt,
         row_number() OVER (PARTITION BY d.book_id, d.drug_name, l_returnflag ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS k
  FROM d JOIN {lineitem} ON l_partkey = p_partkey),
lines AS (
  SELECT book_id, 0 AS page_idx, 0 AS line_idx, 'Table of Contents' AS txt FROM d WHERE rn = 1
  UNION ALL SELECT book_id, 0, 1, 'Preface vii' FROM d WHERE rn = 1
  UNION ALL SELECT book_id, 0, CAST(1 + rn AS INT), drug_name || ' ' || CAST(100 + page_idx AS STRING) FROM d
  UNION ALL SELECT book_id, 0, 900000, drug_name || ' ' || CAST(100 + page_idx AS STRING) FROM d WHERE rn = 1
  UNION ALL SELECT book_id, 0, 900001, 'ghost drug 9999' FROM d WHERE rn = 1
  UNION ALL SELECT book_id, page_idx, 0, CASE WHEN page_idx % 7 = 0 THEN drug_name WHEN page_idx % 2 = 0 THEN CAST(100 + page_idx AS STRING) || ' ' || drug_name
         ELSE drug_name || ' ' || CAST(100 + page_idx AS STRING) END FROM d WHERE base = 0
  UNION ALL SELECT book_id, page_idx, base, drug_name FROM d WHERE base = 1000
  UNION ALL SELECT book_id, page_idx, base + 1, 'Uses / Indications' FROM d
  UNION ALL SELECT book_id, page_idx, base + 2, 'Used for ' || lower(p_type) || CASE WHEN p_size % 3 = 0 THEN ' cases.' ELSE ' cases in dogs and cats.' END FROM d
  UNION ALL SELECT book_id, page_idx, base + 3, 'Drug Interactions' FROM d
  UNION ALL SELECT book_id, page_idx, base + 4, coalesce(prev_name, 'none known') || ': may increase levels.' FROM d
  UNION ALL SELECT book_id, page_idx, base + 5, CASE WHEN p_size % 2 = 0 THEN 'Dosages' ELSE 'Suggested Dosages/Uses' END FROM d
  UNION ALL SELECT book_id, page_idx, base + 6, 'Give with food.' FROM d WHERE p_size % 5 = 0
  UNION ALL SELECT DISTINCT book_id, page_idx, base + CASE flag WHEN 'A' THEN 100 WHEN 'N' THEN 300 ELSE 500 END,
         CASE flag WHEN 'A' THEN 'DOGS:' WHEN 'N' THEN 'DOGS & CATS:' ELSE 'GERBILS:' END FROM li
  UNION ALL SELECT book_id, page_idx, CAST(base + CASE flag WHEN 'A' THEN 100 WHEN 'N' THEN 300 ELSE 500 END + k AS INT), txt FROM li
  UNION ALL SELECT book_id, page_idx, base + 700, 'NOTES:' FROM d
  UNION ALL SELECT book_id, page_idx, base + 701, 'Shake well.' FROM d)
SELECT book_id, page_idx, line_idx, txt FROM lines
"""

_W = "(PARTITION BY book_id, mono_ord ORDER BY line_no ROWS UNBOUNDED PRECEDING)"
_G = "(PARTITION BY book_id, mono_ord, section_ord ORDER BY line_no ROWS UNBOUNDED PRECEDING)"

#: The steps of ingestion over the handbook's lines, each a named table that may use those before it.
STEPS = {
    "h": HANDBOOK.format(part="part", lineitem="lineitem"),
    "toc": f"SELECT book_id, line_idx, {strip('txt')} AS line, regexp_extract({strip('txt')}, {TOC}, 1) AS nm, regexp_extract({strip('txt')}, {TOC}, 2) AS pg FROM h WHERE page_idx = 0 AND {strip('txt')} <> ''",
    "entries": """SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY line_idx) - 1 AS toc_ord, nm AS drug_name, CAST(pg AS BIGINT) AS book_page
      FROM (SELECT *, row_number() OVER (PARTITION BY book_id, nm ORDER BY line_idx) AS rn FROM toc WHERE nm <> '') WHERE rn = 1""",
    "bl": "SELECT book_id, page_idx - 1 AS page_idx, line_idx, txt, row_number() OVER (PARTITION BY book_id ORDER BY page_idx, line_idx) - 1 AS line_no FROM h WHERE page_idx > 0",
    "pg": """SELECT book_id, page_idx, TRY_CAST(coalesce(nullif(regexp_extract(t, '^(\\d+)\\b', 1), ''), nullif(regexp_extract(t, '\\b(\\d+)$', 1), '')) AS BIGINT) AS book_page
      FROM (SELECT book_id, page_idx, arg_min(txt, line_idx) AS t FROM bl GROUP BY book_id, page_idx)""",
    "pm": "SELECT book_id, book_page, min(page_idx) AS page_idx FROM pg WHERE book_page IS NOT NULL GROUP BY book_id, book_page",
    "np": "SELECT book_id, max(page_idx) + 1 AS n_pages FROM bl GROUP BY book_id",
    "a0": "SELECT e.*, pm.page_idx AS exact FROM entries e LEFT JOIN pm USING (book_id, book_page)",
    "near": """SELECT a.book_id, a.toc_ord, pm.page_idx - (pm.book_page - a.book_page) AS guess,
      row_number() OVER (PARTITION BY a.book_id, a.toc_ord ORDER BY abs(pm.book_page - a.book_page), pm.page_idx) AS rn FROM a0 a JOIN pm ON a.book_id = pm.book_id WHERE a.exact IS NULL""",
    "anch": """SELECT a.book_id, a.toc_ord, a.drug_name, a.book_page, CAST(coalesce(a.exact, CASE WHEN n.guess >= 0 AND n.guess < np.n_pages THEN n.guess END) AS INT) AS anchor, a.exact IS NULL AS interpolated
      FROM a0 a LEFT JOIN near n ON a.book_id = n.book_id AND a.toc_ord = n.toc_ord AND n.rn = 1 LEFT JOIN np ON a.book_id = np.book_id""",
    "cand": """SELECT x.book_id, x.toc_ord, min(CASE WHEN l.txt = x.drug_name THEN l.line_no END) AS bare,
      min(CASE WHEN starts_with(l.txt, x.drug_name || ' ') AND regexp_full_match(substr(l.txt, length(x.drug_name) + 2), '\\d+')
             OR ends_with(l.txt, ' ' || x.drug_name) AND regexp_full_match(substr(l.txt, 1, length(l.txt) - length(x.drug_name) - 1), '\\d+') THEN l.line_no END) AS numbered,
      min(CASE WHEN l.page_idx = x.anchor THEN l.line_no END) AS top
      FROM anch x JOIN bl l ON l.book_id = x.book_id AND l.page_idx BETWEEN x.anchor AND x.anchor + 2 GROUP BY x.book_id, x.toc_ord""",
    "located": """SELECT x.*, coalesce(c.bare, c.numbered, CASE WHEN NOT x.interpolated THEN c.top END) AS start_line
      FROM anch x LEFT JOIN cand c ON x.book_id = c.book_id AND x.toc_ord = c.toc_ord""",
    "spans": """SELECT book_id, row_number() OVER w - 1 AS mono_ord, drug_name, book_page, start_line, lead(start_line) OVER w AS end_line
      FROM located WHERE start_line IS NOT NULL WINDOW w AS (PARTITION BY book_id ORDER BY start_line, toc_ord)""",
    "ml": """SELECT s.book_id, s.mono_ord, s.drug_name, s.book_page, l.line_no, l.txt AS line FROM bl l
      JOIN spans s ON l.book_id = s.book_id AND l.line_no >= s.start_line AND l.line_no < coalesce(s.end_line, 9999999999)""",
    "hdr": f"SELECT *, {HEADERS}[{header('line')}] AS typ FROM ml",
    "sl": f"""SELECT * FROM (SELECT *, CAST(sum(CASE WHEN typ IS NOT NULL THEN 1 ELSE 0 END) OVER {_W} AS BIGINT) AS section_ord, last_value(typ IGNORE NULLS) OVER {_W} AS section_type FROM hdr)
      WHERE section_ord > 0 AND typ IS NULL""",
    "sec": f"""SELECT * FROM (SELECT book_id, mono_ord, drug_name, book_page, section_ord, section_type, {strip("string_agg(line, chr(10) ORDER BY line_no)")} AS text
      FROM sl GROUP BY book_id, mono_ord, drug_name, book_page, section_ord, section_type) WHERE text <> ''""",
    "sg": f"""SELECT *, shaped AND (len(sp) > 0 OR len({words('line')}) > 0 AND NOT list_has_any({words('line')}, {listing(V.NOTE_WORDS)})) AS st
      FROM (SELECT *, regexp_matches({strip('line')}, {quoted(V.SPECIES_HEADER)}) AS shaped, {species('line')} AS sp FROM sl WHERE section_type = 'doses')""",
    "sr": f"""SELECT *, CAST(sum(CAST(st AS INT)) OVER {_G} AS BIGINT) AS group_ord,
      coalesce(last_value(CASE WHEN st THEN CASE WHEN len(sp) > 0 THEN sp ELSE ['unspecified'] END END IGNORE NULLS) OVER {_G}, ['unspecified']) AS species FROM sg""",
    "dg": f"""SELECT * FROM (SELECT book_id, mono_ord, drug_name, book_page, section_ord, section_type, group_ord, species, {strip("string_agg(line, chr(10) ORDER BY line_no)")} AS text
      FROM sr WHERE NOT st GROUP BY book_id, mono_ord, drug_name, book_page, section_ord, section_type, group_ord, species) WHERE text <> ''""",
    "grp": f"""SELECT * FROM dg UNION ALL SELECT book_id, mono_ord, drug_name, book_page, section_ord, section_type, CAST(0 AS BIGINT), CASE WHEN len({species('text')}) > 0 THEN {species('text')} ELSE ['all'] END, text
      FROM sec WHERE section_type <> 'doses'""",
    "ck": """SELECT *, lower(drug_name) || '|' || section_type || '|' || array_to_string(species, '+') || '|' || ordinal AS logical_key
      FROM (SELECT *, CAST(row_number() OVER (PARTITION BY book_id, mono_ord, section_type, species ORDER BY section_ord, group_ord) - 1 AS INT) AS ordinal FROM grp)""",
}


def handbook_sql(select: str, *extra: str) -> str:
    """A query over the steps; ``extra`` are more named tables as 'name AS (...)'."""
    return "WITH " + ", ".join([*(f"{k} AS ({v})" for k, v in STEPS.items()), *extra]) + " " + select

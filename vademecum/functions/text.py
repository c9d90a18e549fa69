"""Text expressions: page cleaning, headers, species, names and number forms. All are plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vademecum import vocabulary as V

_WHITE = "[\\s\\x1c-\\x1f]"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(text), f"(?U)^{_WHITE}+|{_WHITE}+$", "")


def clean_page(raw: Column | str) -> Column:
    """Joins words wrapped at a hyphen, collapses blanks, strips lines, keeps one blank line at most; null: empty."""
    joined = F.regexp_replace(F.coalesce(_c(raw), F.lit("")), "-\n([a-z])", "$1")
    lines = F.transform(F.split(F.regexp_replace(joined, "[ \\t]+", " "), "\n"), strip)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def book_page(page: Column | str) -> Column:
    """The printed page number: a leading or else trailing number of the first line that isn't blank; else null."""
    lines = F.filter(F.transform(F.split(_c(page), "\n"), strip), lambda x: x != "")
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    lead, trail = F.regexp_extract(first, "^(\\d+)\\b", 1), F.regexp_extract(first, "\\b(\\d+)$", 1)
    return F.nullif(F.coalesce(F.nullif(lead, F.lit("")), trail), F.lit("")).try_cast("bigint")


def toc_name(line: Column | str) -> Column:
    """The entry's name on a table-of-contents line; null if the line is no entry."""
    return F.nullif(F.regexp_extract(strip(line), V.TOC_ENTRY, 1), F.lit(""))


def toc_page(line: Column | str) -> Column:
    return F.regexp_extract(strip(line), V.TOC_ENTRY, 2).try_cast("int")


def normalize_header(line: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(line), "(?U)\\s*/\\s*", "/"), "(?U)\\s+", " ")


def header_section(line: Column | str) -> Column:
    """The section type that a header line starts; null for other lines."""
    table = F.create_map(*[F.lit(x) for pair in V.HEADER_SECTIONS.items() for x in pair])
    return F.try_element_at(table, normalize_header(line))


def species_mentions(text: Column | str) -> Column:
    """The species named in a text, sorted, each once."""
    table = F.create_map(*[F.lit(x) for pair in V.SPECIES_WORDS.items() for x in pair])
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    known = F.filter(words, lambda w: w.isin(list(V.SPECIES_WORDS)))
    return F.array_sort(F.array_distinct(F.transform(known, lambda w: F.try_element_at(table, w))))


def _header_shaped(line: Column | str) -> Column:
    return strip(line).rlike(V.SPECIES_HEADER)


def header_species(line: Column | str) -> Column:
    """The species of a sub-header line; empty for other lines."""
    return F.when(_header_shaped(line), species_mentions(line)).otherwise(F.array().cast("array<string>"))


def is_species_header(line: Column | str) -> Column:
    """Whether a line is shaped like a species sub-header and names no note or route."""
    words = F.regexp_extract_all(F.lower(_c(line)), F.lit("[a-z]+"), F.lit(0))
    return _header_shaped(line) & (F.size(words) > 0) & ~F.arrays_overlap(words, F.array(*map(F.lit, V.NOTE_WORDS)))


def canonical_species(text: Column | str) -> Column:
    """The one species that a text names; null for none or several."""
    found = species_mentions(text)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def requested_species(text: Column | str) -> Column:
    """The canonical species, or else the request itself in lower case."""
    return F.coalesce(canonical_species(text), F.lower(strip(text)))


def prose_species(text: Column | str) -> Column:
    found = species_mentions(text)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("all")))


def species_bucket(species: Column | str) -> Column:
    rest = F.array_except(_c(species), F.array(*map(F.lit, V.COMPANIONS)))
    generic = F.array_distinct(_c(species)) == F.array(F.lit("all"))
    return F.when((F.size(_c(species)) > 0) & (F.size(rest) == 0), "companion").when(generic, "generic").otherwise("other")


def normalize_name(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(strip(name)), "(?U)\\s+", " ")


def name_pattern(name: Column | str) -> Column:
    """A regular expression for a name with any spaces or hyphens between its parts."""
    parts = F.filter(F.split(strip(name), "[\\s-]+"), lambda x: x != "")
    escaped = F.transform(parts, lambda x: F.regexp_replace(x, "([^A-Za-z0-9_])", "\\\\$1"))
    return F.array_join(escaped, "[\\s-]+")


def number_forms(number: Column | str) -> Column:
    """A number as written and without trailing zeros after the point."""
    short = F.regexp_replace(F.regexp_replace(_c(number), "^(-?\\d+\\.\\d*?)0+$", "$1"), "\\.$", "")
    return F.array_distinct(F.array(_c(number), short))


def number_in_text(number: Column | str, text: Column | str) -> Column:
    """Whether a number stands in a text by itself, in one of its forms; digits and points beside it don't count."""
    pattern = lambda n: F.concat(F.lit("(?<![\\d.])"), F.regexp_replace(n, "\\.", "\\\\."), F.lit("(?![\\d.])"))
    return F.exists(number_forms(number), lambda n: F.call_function("regexp_like", _c(text), pattern(n)))


def indication_matches(query: Column | str, indication: Column | str) -> Column:
    a, b = F.lower(strip(query)), F.lower(strip(indication))
    return (F.length(a) > 0) & (F.contains(b, a) | F.contains(a, b))


def table_name(prefix: Column | str, model: Column | str) -> Column:
    safe = F.regexp_replace(F.regexp_replace(F.lower(_c(model)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(_c(prefix), F.lit("__"), safe)

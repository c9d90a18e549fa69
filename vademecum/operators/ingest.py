"""From pages to chunks: table of contents, heading search, line assignment, sections, species groups.

Every table carries ``book_id``, and lines carry their page and place, so nothing depends on row order. The only wide
exchange moves lines by (book, entry); tables of contents and page numbers are small and are joined by key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vademecum import vocabulary as V
from vademecum.functions import identity, text
from vademecum.operators.splitting import split_long


def clean_pages(pages: DataFrame) -> DataFrame:
    """Adds text and book_page to (book_id, page_idx, raw_text)."""
    cleaned = pages.withColumn("text", text.clean_page("raw_text"))
    return cleaned.withColumn("book_page", text.book_page("text"))


def split_toc(pages: DataFrame, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """The table-of-contents pages ``first`` to ``last``, and the pages after them counted from 0."""
    if first > last:
        raise ValueError(f"the range of contents pages ends ({last}) before it starts ({first})")
    body = pages.where(F.col("page_idx") > last).withColumn("page_idx", F.col("page_idx") - (last + 1))
    return pages.where(F.col("page_idx").between(first, last)), body


def toc_lines(toc_pages: DataFrame) -> DataFrame:
    """Every line that isn't blank, with drug_name and book_page where it is an entry."""
    lines = toc_pages.select("book_id", "page_idx", F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))
    lines = lines.withColumn("line", text.strip("line")).where("line <> ''")
    return lines.withColumn("drug_name", text.strip(text.toc_name("line"))).withColumn("toc_page", text.toc_page("line"))


def toc_entries(lines: DataFrame) -> DataFrame:
    """The first line of each name, in order: book_id, toc_ord, drug_name, book_page."""
    order = ["page_idx", "line_idx"]
    first = F.row_number().over(Window.partitionBy("book_id", "drug_name").orderBy(*order))
    kept = lines.where("drug_name IS NOT NULL").withColumn("_n", first).where("_n = 1")
    placed = kept.withColumn("toc_ord", (F.row_number().over(Window.partitionBy("book_id").orderBy(*order)) - 1).cast("bigint"))
    return placed.select("book_id", "toc_ord", "drug_name", F.col("toc_page").cast("bigint").alias("book_page"))


def page_map(body: DataFrame) -> DataFrame:
    """The first page that carries each printed number."""
    return body.where("book_page IS NOT NULL").groupBy("book_id", "book_page").agg(F.min("page_idx").alias("page_idx"))


def anchors(entries: DataFrame, body: DataFrame) -> DataFrame:
    """Adds the page where each entry should start: anchor (null: none) and interpolated.

    An entry whose number is on no page gets an estimate from the nearest known number, the earliest page on ties.
    """
    known = page_map(body)
    n_pages = body.groupBy("book_id").agg((F.max("page_idx") + 1).alias("n_pages"))
    found = entries.join(known.withColumnRenamed("page_idx", "_exact"), ["book_id", "book_page"], "left")
    # the nearest known numbers below and above each open entry, by running over both in the order of the numbers
    open_ = found.where("_exact IS NULL").select("book_id", "book_page", F.lit(None).cast("struct<known: bigint, idx: int>").alias("at"), "toc_ord")
    marks = known.select("book_id", "book_page", F.struct(F.col("book_page").alias("known"), F.col("page_idx").cast("int").alias("idx")).alias("at"), F.lit(None).cast("bigint").alias("toc_ord"))
    # (a window that ends at the last row would read the rest of the book again for each row; this one runs backwards)
    running = lambda order: F.last("at", ignorenulls=True).over(Window.partitionBy("book_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    last, next_ = running(F.col("book_page").asc()), running(F.col("book_page").desc())
    met = open_.unionByName(marks).select("book_id", "toc_ord", "book_page", last.alias("_last"), next_.alias("_next")).where("toc_ord IS NOT NULL")
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.known") - F.col("book_page")).alias("d"), F.col(f"{c}.idx").alias("idx"), F.col(f"{c}.known").alias("known")))
    best = met.select("book_id", "toc_ord", "book_page", F.least(near("_last"), near("_next")).alias("b"))
    guess = best.select("book_id", "toc_ord", (F.col("b.idx") - (F.col("b.known") - F.col("book_page"))).alias("_guess"))
    both = found.join(guess, ["book_id", "toc_ord"], "left").join(n_pages, "book_id", "left")
    inside = F.when((F.col("_guess") >= 0) & (F.col("_guess") < F.col("n_pages")), F.col("_guess"))
    anchor = F.coalesce("_exact", inside).cast("int").alias("anchor")
    return both.select("book_id", "toc_ord", "drug_name", "book_page", anchor, F.col("_exact").isNull().alias("interpolated"))


def numbered_pages(body: DataFrame) -> DataFrame:
    """Adds n_lines and first_line, the number of the page's first line in its book."""
    counted = body.withColumn("n_lines", F.size(F.split("text", "\n")))
    before = Window.partitionBy("book_id").orderBy("page_idx").rowsBetween(Window.unboundedPreceding, -1)
    # the texts stay out of the window, which holds three numbers per page
    places = counted.select("book_id", "page_idx", F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("first_line"))
    return counted.join(places, ["book_id", "page_idx"])


def signature(value: Column) -> Column:
    """What is left of a name or of lines without spaces, hyphens and digits."""
    return F.regexp_replace(value, "[\\s\\d-]+", "")


def heading_form(lines: Column, name: Column) -> tuple[Column, Column]:
    """Whether some lines, joined by line ends, are an entry's title: alone, or with a number before or after it."""
    bare = text.name_pattern(name)
    whole = lambda *p: F.rlike(lines, F.concat(F.lit("^(?:"), *p, F.lit(")$")))
    return whole(bare), whole(F.lit("\\d+\\s+"), bare) | whole(bare, F.lit("\\s+\\d+"))


def line_groups(pages: DataFrame, lines: str, keep: list[str]) -> DataFrame:
    """Runs of neighbouring lines that may be a title: ``keep``, the place ``first`` of the run's first line in the array
    ``lines`` and of its ``last`` one, ``joined`` and its ``sig``. A run starts with a line whose signature begins one of
    the page's ``names``, a column of signatures, and is no longer than the longest of them. Few lines of a book do."""
    own = pages.withColumn("_sigs", F.transform(lines, signature)).withColumn("_most", F.array_max(F.transform("names", F.length)))
    begins = lambda i: F.exists("names", lambda n: n.startswith(F.get("_sigs", i)))
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (F.length(F.get(lines, i)) > 0) & begins(i))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"))

    def step(state: Column, x: Column) -> Column:
        """Counts lines until their sum passes the longest name; then the sum stays beyond it."""
        total = state["sum"] + F.length(x)
        return F.struct(F.when(total <= F.col("_most"), state["n"] + 1).otherwise(state["n"]).alias("n"), total.alias("sum"))

    run = lambda i: F.aggregate(F.slice("_sigs", i + 1, F.size("_sigs")), start, step)["n"]
    found = F.transform(starts, lambda i: F.struct(i.alias("first"), F.slice(lines, i + 1, run(i)).alias("run")))
    rows = own.where(F.size(lines) > 0).select(*keep, "names", F.explode(found).alias("f")).select(*keep, "names", "f.first", "f.run")
    rows = rows.select(*keep, "names", "first", F.explode(F.transform(F.sequence(F.lit(1), F.size("run")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("run", F.lit(1), n), "\n").alias("joined")))).alias("g"))
    rows = rows.select(*keep, "names", "first", (F.col("first") + F.col("g.n") - 1).alias("last"), F.col("g.joined").alias("joined"), signature(F.col("g.joined")).alias("sig"))
    return rows.where(F.array_contains("names", F.col("sig"))).drop("names")


def heading_candidates(names: DataFrame, pages: DataFrame) -> DataFrame:
    """book_id, page_idx, start_line, end_page, joined and sig of the runs of lines that may be a title: in one page, and
    from a page's end into the next ones. ``names`` has book_id, anchor and sig; a page meets the names that are looked
    for on it as one array, so its text goes on once, and not at all if no name is."""
    wanted = names.select("book_id", F.explode(F.sequence("anchor", F.col("anchor") + V.HEADING_PAGES)).alias("page_idx"), "sig")
    wanted = wanted.groupBy("book_id", "page_idx").agg(F.collect_set("sig").alias("names"))
    lines = F.split("text", "\n").alias("lines")
    rows = pages.select("book_id", "page_idx", "first_line", lines).join(wanted, ["book_id", "page_idx"])
    inside = line_groups(rows, "lines", ["book_id", "page_idx", "first_line"])
    inside = inside.select("book_id", "page_idx", (F.col("first_line") + F.col("first")).alias("start_line"), F.col("page_idx").alias("end_page"), "joined", "sig")
    # the first and last lines of a page whose sum is short enough to be part of a run over its edge
    most = names.groupBy("book_id").agg(F.max(F.length("sig")).alias("most"))
    edges = pages.join(most, "book_id").select("book_id", "page_idx", "first_line", "most", lines)
    fits = lambda c: F.aggregate(c, F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum")), lambda a, x: F.struct(F.when(a["sum"] > F.col("most"), a["n"]).when(a["sum"] + F.length(signature(x)) <= F.col("most"), a["n"] + 1).otherwise(a["n"]).alias("n"), F.when(a["sum"] > F.col("most"), a["sum"]).otherwise(a["sum"] + F.length(signature(x))).alias("sum")))["n"]
    edges = edges.select("book_id", "page_idx", "first_line", F.size("lines").alias("size"), F.slice("lines", F.lit(1), fits(F.col("lines"))).alias("head"), F.reverse(F.slice(F.reverse("lines"), F.lit(1), fits(F.reverse("lines")))).alias("tail"))
    after = lambda k: edges.select("book_id", (F.col("page_idx") - k).alias("page_idx"), F.col("head").alias(f"h{k}"), (F.size("head") == F.col("size")).alias(f"open{k}"))
    over = edges.where(F.size("tail") > 0).select("book_id", "page_idx", "first_line", "size", "tail").join(wanted, ["book_id", "page_idx"])
    none = F.array().cast("array<string>")
    for k in range(1, V.HEADING_PAGES + 1):
        over = over.join(after(k), ["book_id", "page_idx"], "left")
    goes_on, longer, bounds = F.lit(True), F.col("tail"), [F.size("tail")]
    for k in range(1, V.HEADING_PAGES + 1):
        longer = F.concat(longer, F.when(goes_on, F.coalesce(f"h{k}", none)).otherwise(none))
        bounds.append(F.size(longer))
        goes_on = goes_on & F.coalesce(f"open{k}", F.lit(True))
    over = over.select("book_id", "page_idx", "names", (F.col("first_line") + F.col("size") - F.size("tail")).alias("first_line"), F.array(*bounds).alias("bounds"), longer.alias("lines"))
    crossing = line_groups(over, "lines", ["book_id", "page_idx", "first_line", "bounds"]).where("first < bounds[0] AND last >= bounds[0]")
    pages_on = F.size(F.filter("bounds", lambda b: b <= F.col("last")))
    crossing = crossing.select("book_id", "page_idx", (F.col("first_line") + F.col("first")).alias("start_line"), (F.col("page_idx") + pages_on).alias("end_page"), "joined", "sig")
    return inside.unionByName(crossing)


def locate(anchored: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds start_line and start_page of each entry's heading; null where it is missing.

    The heading is searched from the anchor page to HEADING_PAGES pages on: its title alone on its lines, else the first
    place with its title and a number. Without one, an entry starts at its anchor page if that carries its number, and
    is missing if the anchor was estimated. Entries meet runs of lines by their signatures; page texts go on once,
    and only runs with the signature of an entry are held against its pattern.
    """
    names = anchored.where("anchor IS NOT NULL").select("book_id", "toc_ord", "drug_name", "anchor", signature(F.col("drug_name")).alias("sig"))
    near = (F.col("page_idx") >= F.col("anchor")) & (F.col("end_page") <= F.col("anchor") + V.HEADING_PAGES)
    met = heading_candidates(names, pages).join(names, ["book_id", "sig"]).where(near)
    alone, numbered = heading_form(F.col("joined"), F.col("drug_name"))
    place = F.struct("start_line", F.col("page_idx").alias("start_page"))
    found = met.groupBy("book_id", "toc_ord").agg(F.min(F.when(alone, place)).alias("alone"), F.min(F.when(numbered, place)).alias("numbered"))
    found = found.select("book_id", "toc_ord", F.coalesce("alone", "numbered").alias("at")).where("at IS NOT NULL")
    first = pages.select("book_id", F.col("page_idx").alias("anchor"), F.col("first_line").alias("_first"))
    rows = anchored.join(found, ["book_id", "toc_ord"], "left").join(first, ["book_id", "anchor"], "left")
    at_page = F.when(F.col("at").isNull() & ~F.col("interpolated"), F.struct(F.col("_first").alias("start_line"), F.col("anchor").alias("start_page")))
    at = F.coalesce("at", at_page)
    return rows.select(*anchored.columns, at["start_line"].alias("start_line"), at["start_page"].alias("start_page"))


def monograph_spans(located: DataFrame) -> DataFrame:
    """The located entries with mono_ord and the start of the next one (null: to the end of the book)."""
    order = Window.partitionBy("book_id").orderBy("start_line", "toc_ord")
    spans = located.where("start_line IS NOT NULL")
    return spans.select(
        "book_id", (F.row_number().over(order) - 1).cast("bigint").alias("mono_ord"), "drug_name", "book_page", "start_line", "start_page",
        F.lead("start_line").over(order).alias("end_line"), F.lead("start_page").over(order).alias("end_page"),
    )


def monograph_lines(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Every body line with the entry that it belongs to; lines before the first heading are dropped.

    An entry's span is spread over the pages it touches, so lines are found by (book, page) and never sorted as a book.
    """
    last = pages.groupBy("book_id").agg(F.max("page_idx").alias("_last"))
    spread = spans.join(last, "book_id").withColumn("page_idx", F.explode(F.sequence("start_page", F.coalesce("end_page", "_last"))))
    lines = pages.select("book_id", "page_idx", "first_line", F.posexplode(F.split("text", "\n")).alias("_k", "line"))
    lines = lines.withColumn("line_no", F.col("first_line") + F.col("_k")).select("book_id", "page_idx", "line_no", "line")
    found = lines.join(spread.select("book_id", "page_idx", "mono_ord", "drug_name", "book_page", "start_line", "end_line"), ["book_id", "page_idx"])
    own = (F.col("line_no") >= F.col("start_line")) & (F.col("end_line").isNull() | (F.col("line_no") < F.col("end_line")))
    return found.where(own).select("book_id", "mono_ord", "drug_name", "book_page", "line_no", "line")


def joined_lines(order: str, line: str) -> Column:
    """Lines in order, joined and stripped; an aggregate."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("t"))))
    return text.strip(F.array_join(F.transform(rows, lambda x: x["t"]), "\n"))


def section_lines(lines: DataFrame) -> DataFrame:
    """Lines under a known header with section_ord and section_type; header lines and lines before any are dropped."""
    tagged = lines.withColumn("_type", text.header_section("line"))
    running = Window.partitionBy("book_id", "mono_ord").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    tagged = tagged.withColumn("section_ord", F.sum(F.col("_type").isNotNull().cast("int")).over(running))
    tagged = tagged.withColumn("section_type", F.last("_type", ignorenulls=True).over(running))
    return tagged.where("section_ord > 0 AND _type IS NULL").drop("_type")


ENTRY = ["book_id", "mono_ord", "drug_name", "book_page"]


def sections(tagged: DataFrame) -> DataFrame:
    """One row per section that isn't empty."""
    grouped = tagged.groupBy(*ENTRY, "section_ord", "section_type").agg(joined_lines("line_no", "line").alias("text"))
    return grouped.where(F.length("text") > 0)


def monographs(section_rows: DataFrame) -> DataFrame:
    """Entries with their sections as an array in order."""
    nested = F.array_sort(F.collect_list(F.struct("section_ord", "section_type", "text")))
    grouped = section_rows.groupBy(*ENTRY).agg(nested.alias("s"))
    plain = F.transform("s", lambda x: F.struct(x["section_type"].alias("section_type"), x["text"].alias("text")))
    return grouped.select(*ENTRY, plain.alias("sections"))


def section_text(sections_column: str, section_type: Column) -> Column:
    """The first text of a section type in an array of sections; null if there is none."""
    return F.try_element_at(F.filter(sections_column, lambda s: s["section_type"] == section_type), F.lit(1))["text"]


def species_groups(tagged: DataFrame) -> DataFrame:
    """The lines of doses sections by species sub-header; known species, or 'unspecified' before any and under an
    unknown one. Notes and routes are content."""
    doses = tagged.where("section_type = 'doses'").withColumn("_species", text.header_species("line"))
    starts = (F.size("_species") > 0) | text.is_species_header("line")
    running = Window.partitionBy("book_id", "mono_ord", "section_ord").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    unknown = F.array(F.lit("unspecified"))
    doses = doses.withColumn("_start", starts).withColumn("group_ord", F.sum(F.col("_start").cast("int")).over(running))
    header = F.when(F.col("_start"), F.when(F.size("_species") > 0, F.col("_species")).otherwise(unknown))
    doses = doses.withColumn("species", F.coalesce(F.last(header, ignorenulls=True).over(running), unknown)).where("NOT _start")
    grouped = doses.groupBy(*ENTRY, "section_ord", "section_type", "group_ord", "species").agg(joined_lines("line_no", "line").alias("text"))
    return grouped.where(F.length("text") > 0)


def prose_groups(section_rows: DataFrame) -> DataFrame:
    """The sections other than doses, tagged with the species they name."""
    prose = section_rows.where("section_type <> 'doses'").withColumn("group_ord", F.lit(0).cast("bigint"))
    return prose.withColumn("species", text.prose_species("text")).select(*ENTRY, "section_ord", "section_type", "group_ord", "species", "text")


def chunks(groups: DataFrame, max_chars: int = V.MAX_CHUNK_CHARS, overlap: int = 0) -> DataFrame:
    """Splits long texts and numbers the pieces per (entry, section type, species); adds logical_key and content_hash."""
    pieces = split_long(groups, "text", max_chars, overlap)
    order = Window.partitionBy("book_id", "mono_ord", "section_type", "species").orderBy("section_ord", "group_ord", "piece_ord")
    numbered = pieces.withColumn("ordinal", (F.row_number().over(order) - 1).cast("int"))
    key = identity.logical_key(F.col("drug_name"), F.col("section_type"), F.col("species"), F.col("ordinal"))
    keyed = numbered.withColumn("logical_key", key).withColumn("content_hash", identity.content_hash(F.col("logical_key"), F.col("text")))
    return keyed.select("book_id", "mono_ord", "drug_name", "book_page", "section_ord", "section_type", "group_ord", "species", "ordinal", "text", "logical_key", "content_hash")


def missing(located: DataFrame) -> DataFrame:
    """The entries without a heading: contents against located ones."""
    keys = ["book_id", "toc_ord"]
    return located.select(*keys, "drug_name", "book_page").join(located.where("start_line IS NOT NULL").select(*keys), keys, "left_anti")


def parse_report(located: DataFrame, section_rows: DataFrame) -> DataFrame:
    """Per book: toc_entries, drugs_parsed, missing_headings and the entries without any section (sorted names)."""
    counts = located.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("toc_entries"), F.count("start_line").alias("drugs_parsed"),
        F.array_sort(F.collect_list(F.when(F.col("start_line").isNull(), F.col("drug_name")))).alias("missing_headings"),
    )
    empty = monograph_spans(located).join(section_rows.select("book_id", "mono_ord").distinct(), ["book_id", "mono_ord"], "left_anti")
    odd = empty.groupBy("book_id").agg(F.array_sort(F.collect_list("drug_name")).alias("without_sections"))
    joined = counts.join(odd, "book_id", "left")
    return joined.withColumn("without_sections", F.coalesce("without_sections", F.array().cast("array<string>")))


def coverage_gate(report: DataFrame, max_missing: int = 0) -> DataFrame:
    """One row: total entries and missing ones of all books, and whether the run passes."""
    total = report.agg(F.coalesce(F.sum("toc_entries"), F.lit(0)).alias("toc_entries"), F.coalesce(F.sum(F.size("missing_headings")), F.lit(0)).alias("missing"))
    return total.withColumn("passed", (F.col("toc_entries") > 0) & (F.col("missing") <= max_missing))


def toc_counters(lines: DataFrame) -> DataFrame:
    """Per book: entries parsed, lines skipped, repeated entries."""
    names = F.countDistinct("drug_name")
    return lines.groupBy("book_id").agg(
        names.alias("parsed"), F.count_if(F.col("drug_name").isNull()).alias("skipped"), (F.count("drug_name") - names).alias("duplicates"),
    )


class Ingestion:
    """All tables of one run over (book_id, page_idx, raw_text); nothing is made or kept until a table that needs it is used.

    ``keep`` is applied to the tables that several others are made from; pass a function that writes and rereads them
    to cut lineage.
    """

    def __init__(self, pages: DataFrame, toc_first: int, toc_last: int, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        if toc_first > toc_last:
            raise ValueError(f"the range of contents pages ends ({toc_last}) before it starts ({toc_first})")
        self._raw, self._toc, self._keep = pages, (toc_first, toc_last), keep

    _split = cached_property(lambda self: split_toc(self._keep(clean_pages(self._raw)), *self._toc))
    toc_lines = cached_property(lambda self: toc_lines(self._split[0]))
    entries = cached_property(lambda self: toc_entries(self.toc_lines))
    pages = cached_property(lambda self: numbered_pages(self._split[1]))
    anchored = cached_property(lambda self: anchors(self.entries, self.pages))
    located = cached_property(lambda self: self._keep(locate(self.anchored, self.pages)))
    spans = cached_property(lambda self: monograph_spans(self.located))
    lines = cached_property(lambda self: monograph_lines(self.spans, self.pages))
    section_lines = cached_property(lambda self: self._keep(section_lines(self.lines)))
    sections = cached_property(lambda self: self._keep(sections(self.section_lines)))
    species_groups = cached_property(lambda self: species_groups(self.section_lines))
    groups = cached_property(lambda self: self._keep(self.species_groups.unionByName(prose_groups(self.sections))))
    chunks = cached_property(lambda self: chunks(self.groups))
    report = cached_property(lambda self: parse_report(self.located, self.sections))

import random
import re

import pytest

from vademecum.operators import ingest as I
from vademecum.operators.splitting import split_long, split_text

PAGES = [
    ("Metronidazole 873\nMidazolam 880\nGhost 999\nMetronidazole 873\nContents", 0),
    ("Metronidazole 873\nMetronidazole\nintro\nUses / Indications\nFor dogs.\nDosages\nfirst\nDOGS:\n25 mg/kg PO q12h\nGERBILS:\n5 mg/kg\nNOTES:\nshake", 1),
    ("874 Metronidazole\nmore doses\nDoses\nCATS:\n10 mg/kg", 2),
    ("Midazolam 880\nMidazolam\nUses/Indications\nSedation.", 3),
]


@pytest.fixture(scope="module")
def run(spark):
    return I.Ingestion(spark.createDataFrame([("b", i, t) for t, i in PAGES], "book_id string, page_idx int, raw_text string"), 0, 0)


def test_entries_and_missing(run):
    assert [(r.toc_ord, r.drug_name, r.book_page) for r in run.entries.orderBy("toc_ord").collect()] == [(0, "Metronidazole", 873), (1, "Midazolam", 880), (2, "Ghost", 999)]
    assert [r.drug_name for r in I.missing(run.located).collect()] == ["Ghost"]
    counters = I.toc_counters(run.toc_lines).first()
    assert (counters.parsed, counters.skipped, counters.duplicates) == (3, 1, 1)


def test_chunks(run):
    rows = run.chunks.orderBy("mono_ord", "section_ord", "group_ord", "ordinal").collect()
    assert [(r.drug_name, r.section_type, r.species, r.ordinal, r.text) for r in rows] == [
        ("Metronidazole", "indications", ["dog"], 0, "For dogs."),
        ("Metronidazole", "doses", ["unspecified"], 0, "first"),
        ("Metronidazole", "doses", ["dog"], 0, "25 mg/kg PO q12h"),
        ("Metronidazole", "doses", ["unspecified"], 1, "5 mg/kg\nNOTES:\nshake\n874 Metronidazole\nmore doses"),
        ("Metronidazole", "doses", ["cat"], 0, "10 mg/kg\nMidazolam 880"),  # a running header stays in the text before the bare title
        ("Midazolam", "indications", ["all"], 0, "Sedation."),
    ]
    assert rows[2].logical_key == "metronidazole|doses|dog|0"


def test_report_and_gate(run):
    report = run.report.first()
    assert (report.toc_entries, report.drugs_parsed, report.missing_headings, report.without_sections) == (3, 2, ["Ghost"], [])
    assert I.coverage_gate(run.report).first().passed is False
    assert I.coverage_gate(run.report, 1).first().passed is True


def test_range_must_be_in_order(run):
    with pytest.raises(ValueError):
        I.split_toc(run.pages, 2, 1)


def test_heading_forms(spark):
    def located(pages, name, page):
        rows = [("b", 0, f"{name} {page}")] + [("b", i + 1, p) for i, p in enumerate(pages)]
        run = I.Ingestion(spark.createDataFrame(rows, "book_id string, page_idx int, raw_text string"), 0, 0)
        return run.located.first()

    assert located(["Tail 7\nL-Theanine\nx"], "L- Theanine", 7).start_line == 1
    assert located(["7 Other\nno title here"], "Absent", 7).start_line == 0  # the page start
    assert located(["8 Other\nno title here"], "Absent", 7).start_line is None  # an estimate needs a title
    assert located(["xy\nno number", "8 b\ny"], "xy", 7).start_line == 0


def test_empty_input(spark):
    run = I.Ingestion(spark.createDataFrame([], "book_id string, page_idx int, raw_text string"), 0, 0)
    assert run.chunks.count() == 0
    assert I.coverage_gate(run.report).first().passed is False


def test_split_text():
    words = " ".join(f"word{i}" for i in range(1000))
    pieces = split_text(words, 200)
    assert all(len(p) <= 200 for p in pieces)
    assert " ".join(pieces) == words
    assert split_text("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    paragraphs = "a" * 50 + "\n\n" + "b" * 50 + "\n" + "c" * 30
    assert split_text(paragraphs, 60) == ["a" * 50, "b" * 50, "c" * 30]
    overlapping = split_text(words, 200, 50)
    assert all(len(p) <= 200 for p in overlapping) and len(overlapping) > len(pieces)


def test_split_long_keeps_columns(spark):
    df = spark.createDataFrame([(1, "x " * 30), (2, " "), (3, None), (4, " short ")], "id int, text string")
    rows = split_long(df, "text", 20).orderBy("id", "piece_ord").collect()
    assert [r.id for r in rows].count(1) == 3
    assert [(r.id, r.text) for r in rows if r.id != 1] == [(4, "short")]


def plain_split(text, most, overlap, separators=("\n\n", "\n", " ", "")):
    """The splitting rule over lists of parts, as it is worded."""
    at = next(i for i, s in enumerate(separators) if s in text)
    separator, finer = separators[at], separators[at + 1 :]
    head, *rest = text.split(separator) if separator else [text[:1], *text[1:]]
    parts = [p for p in [head, *(separator + r for r in rest)] if p]
    out, run = [], []

    def close():
        if run:
            out.append("".join(run).strip())

    for part in parts:
        if len(part) >= most:
            close()
            run = []
            out += plain_split(part, most, overlap, finer) if finer else [part]
            continue
        if run and len("".join(run)) + len(part) > most:
            close()
            while run and (len("".join(run)) > overlap or len("".join(run)) + len(part) > most):
                run = run[1:]
        run = [*run, part]
    close()
    return [p for p in out if p]


def test_splitting_equals_the_plain_rule_on_all_documents(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() if r.text]
    odd = ["\n\n" * 9, " \n \n\n x", "a\n\n\n\nb", "\n" + "y" * 70 + "\n\n" + " z" * 40, "\u2028 été \t" * 30, "x"]
    for text in [*odd, *(t[:6000] for t in texts)]:
        for most, overlap in ((1200, 0), (300, 60), (40, 13)):
            pieces = split_text(text, most, overlap)
            assert pieces == plain_split(text, most, overlap)
            assert all(len(p) <= most for p in pieces)
            if not overlap:
                assert "".join("".join(pieces).split()) == "".join(text.split())
    for text in sorted(texts, key=len)[-3:]:
        assert split_text(text, 1200) == plain_split(text, 1200, 0)


def plain_heading(pages, anchor, name, interpolated):
    """The line number of a title by searching the text of its window, as the rule is worded."""
    shown = [p for p in range(anchor, anchor + 3) if p < len(pages)]
    window = "\n".join(pages[p] for p in shown)
    bare = r"[\s-]+".join(re.escape(x) for x in re.split(r"[\s-]+", name.strip()) if x)
    found = [re.search(p, window, re.M | re.A) for p in (rf"^{bare}\s*$", rf"^\d+\s+{bare}\s*$", rf"^{bare}\s+\d+\s*$")]
    at = found[0] or min((f for f in found[1:] if f), key=lambda f: f.start(), default=None)
    if at is None and interpolated:
        return None
    return sum(pages[p].count("\n") + 1 for p in range(anchor)) + (window[: at.start()].count("\n") if at else 0)


def test_headings_equal_the_plain_search(spark):
    """Titles on one line, over several lines, over page ends, beside numbers, beside lines that only look alike."""
    rng = random.Random(12)
    names = ["L-Theanine", "Vitamin B 12", "5-Fluorouracil", "Co-trimoxazole DS", "A", "77", "Ace + Plus", "Metronidazole"]
    words = ["L", "Theanine", "L-Theanine", "L -", "-", "", "Vitamin", "B", "12", "Vitamin B", "B 12", "5", "Fluorouracil", "5-Fluorouracil 874", "874 A", "A", "77", "9 77", "Ace", "+ Plus", "Ace + Plus 3", "Metronidazole", "12 Metronidazole", "metronidazole", "Co-trimoxazole", "DS", "a long line of text that is no title at all", "874"]
    books, entries, want = [], [], {}
    for b in range(60):
        pages = ["\n".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 3, 7]))) for _ in range(6)]
        books += [(f"b{b}", i, p) for i, p in enumerate(pages)]
        for o, name in enumerate(names):
            anchor, interpolated = rng.randrange(6), rng.random() < 0.5
            entries.append((f"b{b}", o, name, anchor, interpolated))
            want[f"b{b}", o] = plain_heading(pages, anchor, name, interpolated)
    anchored = spark.createDataFrame(entries, "book_id string, toc_ord bigint, drug_name string, anchor int, interpolated boolean")
    pages = I.numbered_pages(spark.createDataFrame(books, "book_id string, page_idx int, text string"))
    got = {(r.book_id, r.toc_ord): r.start_line for r in I.locate(anchored, pages).collect()}
    assert [(k, got[k], want[k]) for k in want if got[k] != want[k]] == [] and len(got) == len(want)
    assert sum(v is not None for v in want.values()) > 200


def test_anchors_equal_the_plain_search_in_one_pass(spark):
    """Estimates from the nearest known number on either side, by windows that never read to the end of a book."""
    rng = random.Random(4)
    pages = [(b, i, rng.choice([None, rng.randrange(60)])) for b in ("x", "y") for i in range(30)]
    entries = [(b, i, f"n{i}", rng.choice([None, rng.randrange(70), rng.randrange(70)])) for b in ("x", "y", "z") for i in range(40)]
    body = spark.createDataFrame(pages, "book_id string, page_idx int, book_page bigint")
    got = I.anchors(spark.createDataFrame(entries, "book_id string, toc_ord bigint, drug_name string, book_page bigint"), body)
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    want = {}
    for book, n, _, number in entries:
        known = {}
        for b, i, p in pages:
            if b == book and p is not None:
                known.setdefault(p, i)
        anchor = known.get(number)
        if number is not None and anchor is None and known:
            _, i, p = min((abs(p - number), i, p) for p, i in known.items())
            anchor = i - (p - number) if 0 <= i - (p - number) < 30 else None
        want[book, n] = (anchor, number not in known)
    assert {(r.book_id, r.toc_ord): (r.anchor, r.interpolated) for r in got.collect()} == want


def test_anchors_keep_no_table_behind_them(spark):
    """Who asks for the entries' pages doesn't pay for headings, lines, sections and groups."""
    kept = []
    pages = spark.createDataFrame([("x", 0, "Table of Contents\nAspirin 5"), ("x", 1, "5\nAspirin\nDosages\nDOGS:\n2 mg")], "book_id string, page_idx int, raw_text string")
    run = I.Ingestion(pages, 0, 0, keep=lambda df: kept.append(df.columns) or df)
    assert not kept
    assert [(r.drug_name, r.anchor) for r in run.anchored.collect()] == [("Aspirin", 0)] and len(kept) == 1
    assert run.chunks.count() == 1 and len(kept) == 5

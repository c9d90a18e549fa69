import re

import pytest
from pyspark.sql import functions as F

from vademecum.functions import identity, text


def value(spark, column, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("metroni-\ndazole is", "metronidazole is"),
        ("(8.1-\n25 lb)", "(8.1-\n25 lb)"),
        ("A\n\n\n\nB", "A\n\nB"),
        ("A\n \n \n \nB", "A\n\nB"),
        ("  a \t b  \n c ", "a b\nc"),
        ("", ""),
        (None, ""),
    ],
)
def test_clean_page(spark, raw, want):
    assert value(spark, text.clean_page("t"), t=raw) == want


@pytest.mark.parametrize(("page", "want"), [("874 Metronidazole\nx", 874), ("Metronidazole 873\nx", 873), ("\n\n  12 a", 12), ("Preface\n12", None), ("", None), ("12a b", None)])
def test_book_page(spark, page, want):
    assert value(spark, text.book_page("t"), t=page) == want


@pytest.mark.parametrize(("line", "name", "page"), [("Moxidectin/Moxidectin Combination Products 912", "Moxidectin/Moxidectin Combination Products", 912), ("Preface vii", None, None), ("A 12345", None, None), ("", None, None)])
def test_toc_line(spark, line, name, page):
    assert value(spark, text.toc_name("t"), t=line) == name
    assert value(spark, text.toc_page("t"), t=line) == page


@pytest.mark.parametrize(("line", "want"), [("Uses / Indications", "indications"), ("  Drug   Interactions ", "drug_interactions"), ("uses/indications", None), ("Dosages", "doses")])
def test_header_section(spark, line, want):
    assert value(spark, text.header_section("t"), t=line) == want


@pytest.mark.parametrize(
    ("line", "species", "header"),
    [("DOGS & CATS:", ["cat", "dog"], True), ("REPTILES :", ["reptile"], True), ("GERBILS:", [], True), ("NOTES:", [], False), ("IM:", [], False), ("DOGS NOTES:", ["dog"], False), ("25 mg/kg PO q12h", [], False)],
)
def test_species_headers(spark, line, species, header):
    assert value(spark, text.header_species("t"), t=line) == species
    assert value(spark, text.is_species_header("t"), t=line) is header


def test_canonical_species(spark):
    assert value(spark, text.canonical_species("t"), t="Dogs") == "dog"
    assert value(spark, text.canonical_species("t"), t="dogs and cats") is None
    assert value(spark, text.requested_species("t"), t=" Unicorn ") == "unicorn"
    assert value(spark, text.prose_species("t"), t="nothing") == ["all"]
    assert value(spark, text.species_mentions("t"), t=None) == []


@pytest.mark.parametrize("name", ["L- Theanine", "A (b) c", "x/y-z", "1.5% gel"])
def test_name_pattern_matches_its_name(spark, name):
    pattern = value(spark, text.name_pattern("t"), t=name)
    assert re.fullmatch(pattern, name)
    assert re.fullmatch(pattern, re.sub(r"[\s-]+", "  ", name))


@pytest.mark.parametrize(
    ("number", "body", "want"),
    [("50.0", "give 50 mg", True), ("50", "give 50.0 mg", False), ("0.5", "1.0.5", False), ("25", "125 mg", False), ("25", "at 25.", False), ("0.50", "0.5 mg", True), ("1000", "1,000", False), ("12.500", "12.5-13", True)],
)
def test_number_in_text(spark, number, body, want):
    assert value(spark, text.number_in_text("n", "t"), n=number, t=body) is want


def test_indication_match(spark):
    match = text.indication_matches("a", "b")
    assert value(spark, match, a="Pain", b="chronic pain ") is True
    assert value(spark, match, a="  ", b="pain") is False
    assert value(spark, match, a="pain", b=" ") is True


def test_point_id_is_a_name_based_uuid(spark):
    import uuid

    from vademecum.vocabulary import POINT_NAMESPACE

    for key in ("metronidazole|doses|dog|0", "é|x|all|12", ""):
        assert value(spark, identity.point_id(F.col("k")), k=key) == str(uuid.uuid5(uuid.UUID(POINT_NAMESPACE), key))


@pytest.mark.parametrize(("weight", "unit", "rate", "want"), [("12", "kg", "25", "300"), ("22", "lb", "10", "99.7903214"), ("4.2", "kg", "0.0025", "0.0105")])
def test_doses_are_exact(spark, weight, unit, rate, want):
    from decimal import Decimal

    kg = identity.weight_kg(F.col("w").cast("decimal(10,6)"), F.col("u"))
    assert value(spark, identity.dose_mg(kg, F.col("r").cast("decimal(11,6)")), w=weight, u=unit, r=rate) == Decimal(want)


@pytest.mark.parametrize(("weight", "unit", "bad"), [("0", "kg", True), ("-4", "kg", True), ("5001", "kg", True), ("5000", "lb", False), ("3", "stone", True)])
def test_weight_bounds(spark, weight, unit, bad):
    problem = identity.weight_problem(F.col("w").cast("decimal(14,6)"), F.col("u"))
    assert (value(spark, problem, w=weight, u=unit) is not None) is bad

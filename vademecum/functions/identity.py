"""Keys, hashes and point ids of chunks, and doses in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vademecum import vocabulary as V


def logical_key(drug: Column, section: Column, species: Column, ordinal: Column) -> Column:
    return F.concat_ws("|", F.lower(drug), section, F.array_join(F.array_sort(species), "+"), ordinal.cast("string"))


def content_hash(key: Column, text: Column) -> Column:
    return F.sha2(F.concat(key, F.lit("::"), text), 256)


def point_id(key: Column) -> Column:
    """The name-based (SHA-1) UUID of a key."""
    space = F.unhex(F.lit(V.POINT_NAMESPACE.replace("-", "")))
    digest = F.sha1(F.concat(space, F.encode(key, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def weight_kg(weight: Column, unit: Column) -> Column:
    """decimal(20,14): pounds by the exact factor, kilograms as they are."""
    factor = F.when(unit == "lb", F.lit(V.LB_IN_KG).cast("decimal(9,8)")).otherwise(F.lit("1").cast("decimal(9,8)"))
    return weight.cast("decimal(10,6)") * factor


def dose_mg(kg: Column, mg_per_kg: Column) -> Column:
    return kg * mg_per_kg.cast("decimal(11,6)")


def weight_problem(weight: Column, unit: Column) -> Column:
    """Why a weight is rejected; null if it is usable."""
    return (
        F.when(weight.isNull() | (weight <= 0), "weight must be over 0")
        .when(weight > V.MAX_WEIGHT_KG, "weight is too large")
        .when(unit.isNull() | ~unit.isin("kg", "lb"), "unknown unit")
    )

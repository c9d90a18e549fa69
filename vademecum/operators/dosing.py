"""Dose rules: regimens grounded in their passage, one verdict per request, doses in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vademecum import schemas
from vademecum import vocabulary as V
from vademecum.functions import identity, text


def parsed_regimens(requests: DataFrame, column: str = "regimens_json") -> DataFrame:
    """One row per usable regimen of a JSON array with string doses; malformed doses, doses of 0 or less and doses
    over the limit are dropped. The dose strings are kept, since they are looked up as written."""
    listed = requests.withColumn("_r", F.explode(F.from_json(column, schemas.REGIMENS))).drop(column)
    rows = listed.select("*", "_r.*").drop("_r")
    number = lambda c: F.col(c).try_cast("decimal(11,6)")
    rows = rows.withColumn("low", number("mg_per_kg_low")).withColumn("high", number("mg_per_kg_high"))
    usable = lambda c: (F.col(c) > 0) & (F.col(c) <= V.MAX_MG_PER_KG)
    return rows.where(usable("low") & (F.col("mg_per_kg_high").isNull() | usable("high")))


def range_ordered(low: Column, high: Column) -> Column:
    return high.isNull() | (high > low)


def grounded(rows: DataFrame) -> Column:
    """Whether a regimen's doses stand in passage_text and its range is in order."""
    low = text.number_in_text("mg_per_kg_low", "passage_text")
    high = F.col("mg_per_kg_high").isNull() | text.number_in_text("mg_per_kg_high", "passage_text")
    return range_ordered(F.col("low"), F.col("high")) & low & high


def verdicts(requests: DataFrame, regimens: DataFrame) -> DataFrame:
    """One row per request: kind, reason, and the candidates' indications.

    ``requests`` has request_id, indication (null: any) and all_regimens; ``regimens`` has request_id,
    regimen_indication and is_grounded.
    """
    rows = regimens.join(requests.select("request_id", "indication"), "request_id")
    match = F.col("is_grounded") & F.coalesce(text.indication_matches("indication", "regimen_indication"), F.lit(False))
    name = F.col("regimen_indication")
    counts = rows.groupBy("request_id").agg(
        F.count_if("is_grounded").alias("v"), F.count_if(~F.col("is_grounded")).alias("d"), F.count_if(match).alias("m"),
        F.array_sort(F.collect_list(F.when(F.col("is_grounded"), name))).alias("all"), F.array_sort(F.collect_list(F.when(match, name))).alias("own"),
    )
    both = requests.join(counts, "request_id", "left")
    v, d, m = (F.coalesce(c, F.lit(0)) for c in ("v", "d", "m"))
    asked = F.col("indication").isNotNull()
    kind = F.when(v == 0, "needs_clarification").when(F.col("all_regimens"), "dose_rule_set").when(F.when(asked, m).otherwise(v) == 1, "dose_rule").otherwise("needs_clarification")
    reason = (
        F.when((v == 0) & (d > 0), F.concat(d.cast("string"), F.lit(" extracted regimen(s) failed the grounding check")))
        .when(v == 0, "no dose regimens could be extracted")
        .when(kind != "needs_clarification", F.lit(None))
        .when(asked & (m == 0), "no regimen matches the indication")
        .when(asked, "multiple regimens match the indication")
        .otherwise("multiple regimens in passage")
    )
    chosen = F.when(v == 0, F.array().cast("array<string>")).when(asked & (m > 0) & ~F.col("all_regimens"), F.col("own")).otherwise(F.col("all"))
    return both.select("request_id", kind.alias("kind"), reason.alias("reason"), F.coalesce(chosen, F.array().cast("array<string>")).alias("candidates"))


def doses(requests: DataFrame) -> DataFrame:
    """Adds weight_kg, dose_mg_low and dose_mg_high (null without a high) to rows of weight, unit, low and high."""
    kg = requests.withColumn("weight_kg", identity.weight_kg(F.col("weight"), F.col("unit")))
    return kg.withColumn("dose_mg_low", identity.dose_mg(F.col("weight_kg"), F.col("low"))).withColumn("dose_mg_high", identity.dose_mg(F.col("weight_kg"), F.col("high")))


def dose_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, doses) of requests (request_id, drug, indication, all_regimens, weight, unit, passage, regimens_json).

    Verdicts have one row per request, with problem for a weight or unit that is rejected. Doses have one row per chosen
    regimen of the requests without a problem that end in a rule or a set of rules.
    """
    asked = requests.select("request_id", "indication", F.coalesce("all_regimens", F.lit(False)).alias("all_regimens"))
    regimens = parsed_regimens(requests.select("request_id", F.col("passage").alias("passage_text"), "regimens_json"))
    regimens = regimens.withColumn("is_grounded", F.coalesce(grounded(regimens), F.lit(False))).withColumnRenamed("indication", "regimen_indication")
    problem = identity.weight_problem(F.col("weight"), F.col("unit")).alias("problem")
    verdict = verdicts(asked, regimens).join(requests.select("request_id", "drug", problem), "request_id")
    ready = verdict.where("problem IS NULL AND kind IN ('dose_rule', 'dose_rule_set')").select("request_id", "drug", "kind", "candidates")
    chosen = regimens.where("is_grounded").join(ready, "request_id").where(F.array_contains("candidates", F.col("regimen_indication")))
    return verdict, doses(chosen.drop("candidates", "passage_text").join(requests.select("request_id", "weight", "unit"), "request_id"))


def describe(drug: Column, low: Column, high: Column, route: Column, frequency: Column, indication: Column) -> Column:
    """A rule in one line."""
    span = F.concat(low.cast("string"), F.when(high.isNull(), F.lit("")).otherwise(F.concat(F.lit("-"), high.cast("string"))))
    return F.concat(drug, F.lit(": "), span, F.lit(" mg/kg "), route, F.lit(" "), frequency, F.when(indication.isNull(), F.lit("")).otherwise(F.concat(F.lit(" ("), indication, F.lit(")"))))

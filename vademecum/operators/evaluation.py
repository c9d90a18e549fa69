"""Retrieval metrics, scorecards and labelled query sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vademecum.functions import text

KS = (1, 3, 5, 10)


def metric_names(ks: tuple[int, ...] = KS) -> list[str]:
    return [f"recall@{k}" for k in ks] + [f"hit_rate@{k}" for k in ks] + ["mrr"]


def relevant_ranks(ranked: DataFrame, relevant: DataFrame, by: list[str]) -> DataFrame:
    """The ranks at which a query's relevant keys stand."""
    return ranked.select(*by, "logical_key", "rank").join(relevant, [b for b in by if b in relevant.columns] + ["logical_key"])


def query_metrics(queries: DataFrame, ranks: DataFrame, by: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """recall@k, hit_rate@k and mrr of every query (by, n_relevant), 0 for one without hits."""
    hits = ranks.groupBy(*by).agg(*[F.count_if(F.col("rank") <= k).alias(f"_h{k}") for k in ks], F.min("rank").alias("_first"))
    rows = queries.join(hits, by, "left")
    h = lambda k: F.coalesce(F.col(f"_h{k}"), F.lit(0))
    recall = [F.when(F.col("n_relevant") > 0, h(k) / F.col("n_relevant")).otherwise(0.0).alias(f"recall@{k}") for k in ks]
    hit = [(h(k) > 0).cast("double").alias(f"hit_rate@{k}") for k in ks]
    return rows.select(*queries.columns, *recall, *hit, F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr"))


def mean_metrics(rows: DataFrame, by: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.avg(f"`{m}`").alias(m) for m in metric_names(ks)])


def long_form(means: DataFrame, by: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    return means.unpivot(by, [f"`{m}`" for m in metric_names(ks)], "metric", "value")


def scorecard(long: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row per model, one column per metric."""
    return long.groupBy("model").pivot("metric", metric_names(ks)).agg(F.first("value"))


def winner(means: DataFrame) -> DataFrame:
    """The model with the highest recall@5, then mrr, then the first listed (``position``)."""
    best = F.max_by("model", F.struct(F.col("`recall@5`"), F.col("mrr"), -F.col("position")))
    return means.agg(best.alias("winner"))


def by_flow(rows: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Means per (model, flow), per model and overall; ``level`` tells them apart (0, 1, 3)."""
    return rows.rollup("model", "flow").agg(F.grouping_id().cast("bigint").alias("level"), *[F.avg(f"`{m}`").alias(m) for m in metric_names(ks)])


def is_relevant(wanted: Column, has: Column) -> Column:
    """Whether a chunk's species answer a case: no species asked, a common one, or a chunk for all."""
    return (F.size(wanted) == 0) | F.arrays_overlap(wanted, has) | F.array_contains(has, "all")


def ground_truth(cases: DataFrame, corpus: DataFrame) -> DataFrame:
    """case_id and logical_key of every chunk that answers a case (case_id, drug, section, want_species)."""
    on = (F.lower("drug") == F.lower("drug_name")) & (F.col("section") == F.col("section_type")) & is_relevant(F.col("want_species"), F.col("species"))
    return cases.join(corpus, on).select("case_id", "logical_key")


def targets(corpus: DataFrame) -> DataFrame:
    """Distinct (section, drug, species)."""
    return corpus.select(F.col("section_type").alias("section"), F.col("drug_name").alias("drug"), "species").distinct()


def turns(rows: DataFrame, by: list[str], signature: str, shuffle_key: Column, tie: list[str], most: int) -> DataFrame:
    """Adds _turn: the place of a row in its shuffled signature, up to ``most``. The bound is a constant, so every task
    sends that many rows of a signature on at most (Spark's window group limit, for bounds below its threshold)."""
    within = Window.partitionBy(*by, signature).orderBy(shuffle_key, *tie)
    return rows.withColumn("_turn", F.row_number().over(within)).where(F.col("_turn") <= most)


def picks(turned: DataFrame, by: list[str], signature: str, most: int) -> DataFrame:
    """Adds pick: the order in which a round-robin over the signatures takes the rows, up to ``most``, bounded likewise."""
    return turned.withColumn("pick", F.row_number().over(Window.partitionBy(*by).orderBy("_turn", signature))).where(F.col("pick") <= most)


def round_robin(rows: DataFrame, by: list[str], signature: str, shuffle_key: Column, tie: list[str], most: int) -> DataFrame:
    """Adds pick to the first ``most`` rows of each group that a shuffled round-robin over its signatures takes."""
    return picks(turns(rows, by, signature, shuffle_key, tie, most), by, signature, most).drop("_turn")


def sample_targets(rows: DataFrame, per_flow: int, other_fraction: float, shuffle_key: Column, tie: list[str]) -> DataFrame:
    """Up to ``per_flow`` targets of each flow (flow, signature, bucket): a quota of other species, the rest companion
    and generic ones, and more of the others where these run out."""
    other = rows.where("bucket = 'other'")
    main = rows.where("bucket <> 'other'")
    counts = rows.groupBy("flow").agg(F.count_if(F.col("bucket") == "other").alias("n_other"), F.count_if(F.col("bucket") != "other").alias("n_main"))
    wanted = F.greatest(F.lit(1), F.bround(F.lit(per_flow * other_fraction)).cast("int"))
    quota = F.least("n_other", wanted) if per_flow > 0 and other_fraction > 0 else F.lit(0)
    counts = counts.withColumn("quota", quota.cast("int")).withColumn("main_room", F.lit(per_flow) - F.col("quota"))
    counts = counts.withColumn("fill", F.greatest(F.lit(0), F.col("main_room") - F.col("n_main")))
    # a signature gives up to per_flow rows to the quota and as many to the fill, which goes on where the quota stopped
    turned = turns(other, ["flow"], "signature", shuffle_key, tie, 2 * max(1, per_flow))
    first = picks(turned, ["flow"], "signature", max(1, per_flow)).join(counts.select("flow", "quota"), "flow").where("pick <= quota")
    picked = first.withColumn("part", F.lit(0))
    taken = first.groupBy("flow", "signature").agg(F.max("_turn").alias("_taken"))
    taken = taken.select(F.col("flow").alias("_flow"), F.col("signature").alias("_signature"), "_taken")
    rest = turned.join(taken, (F.col("flow") == F.col("_flow")) & F.col("signature").eqNullSafe(F.col("_signature")), "left")
    rest = rest.withColumn("_turn", F.col("_turn") - F.coalesce("_taken", F.lit(0))).where("_turn > 0").drop("_flow", "_signature", "_taken")
    again = picks(rest, ["flow"], "signature", max(1, per_flow)).join(counts.select("flow", "fill"), "flow").where("pick <= fill").withColumn("part", F.lit(2))
    second = round_robin(main, ["flow"], "signature", shuffle_key, tie, max(1, per_flow)).join(counts.select("flow", "main_room"), "flow").where("pick <= main_room").withColumn("part", F.lit(1))
    columns = [*rows.columns, "part", "pick"]
    return picked.select(*columns).unionByName(second.select(*columns)).unionByName(again.select(*columns))


def sample_text(corpus: DataFrame, position: str) -> DataFrame:
    """The first chunk's text of each (drug, section), cut to 600 characters."""
    return corpus.groupBy(F.col("drug_name").alias("drug"), F.col("section_type").alias("section")).agg(F.substring(F.min_by("text", position), 1, 600).alias("sample_text"))


def template_question(drug: Column, section: Column, species: Column, sample: Column) -> Column:
    """A question from a template, in place of a language model."""
    return F.concat_ws("", F.lit("Q: "), drug, F.lit("/"), section, F.lit("/"), F.array_join(species, "+"))


def build_eval_set(corpus: DataFrame, flows: dict[str, str], per_flow: int, seed: int, other_fraction: float, position: str, phrase=template_question) -> DataFrame:
    """Labelled cases sampled from chunks; targets without any relevant chunk are left out."""
    table = F.create_map(*[F.lit(x) for f, s in flows.items() for x in (s, f)])
    rows = targets(corpus).withColumn("flow", F.try_element_at(table, F.col("section"))).where("flow IS NOT NULL")
    rows = rows.withColumn("signature", F.array_join("species", "+")).withColumn("bucket", text.species_bucket("species"))
    key = F.md5(F.concat(F.lit(str(seed)), F.col("flow"), F.col("drug")).cast("binary"))
    picked = sample_targets(rows, per_flow, other_fraction, key, ["drug"])
    picked = picked.withColumn("case_id", F.concat_ws("|", "flow", "drug", "signature"))
    truth = ground_truth(picked.select("case_id", "drug", "section", F.col("species").alias("want_species")), corpus)
    keys = truth.groupBy("case_id").agg(F.array_sort(F.collect_list("logical_key")).alias("relevant_logical_keys"))
    rows = picked.join(keys, "case_id").join(sample_text(corpus, position), ["drug", "section"])
    question = phrase(F.col("drug"), F.col("section"), F.col("species"), F.col("sample_text"))
    return rows.select("case_id", question.alias("query"), "flow", "drug", "section", "species", "relevant_logical_keys")

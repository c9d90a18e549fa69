"""Filtered similarity search for many requests at once, reranking and citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vademecum import vocabulary as V
from vademecum.functions import text, vectors
from vademecum.operators import names as N
from vademecum.operators.block_search import QUERY_ROWS, filtered_top_k
from vademecum.operators.block_search import matrix as _matrix
from vademecum.operators.ranges import numbered
from vademecum.sources.tables import rewritten


def metadata_filter(drug: Column, section: Column, species: Column) -> Column:
    """Whether a chunk (drug_name, section_type, species) meets a request's optional filters; species is membership."""
    return (
        (drug.isNull() | (F.col("drug_name") == drug))
        & (section.isNull() | (F.col("section_type") == section))
        & (species.isNull() | F.array_contains("species", species))
    )


def filtered_pairs(asked: DataFrame, corpus: DataFrame) -> DataFrame:
    """Every pair of a request (want_drug, want_section, want_species, each null for any) and a chunk that meets its
    filters. Requests that name the same filters join on just these, each species of a chunk being a key of its own, so
    every join has as many equal keys as filters; only requests without any filter meet all chunks, as a broadcast of
    checked size or, beyond it, in Spark's own nested loop."""
    wants = {"want_drug": "drug_name", "want_section": "section_type", "want_species": "_one"}
    each = corpus.select("*", F.explode(F.array_distinct("species")).alias("_one"))
    out = None
    for mask in range(8):
        own = [w for i, w in enumerate(wants) if mask >> i & 1]
        rows = asked.where(" AND ".join(f"{w} IS {'NOT ' if w in own else ''}NULL" for w in wants))
        side = each if "want_species" in own else corpus.withColumn("_one", F.lit(None).cast("string"))
        on = [F.col(w) == F.col(wants[w]) for w in own]
        part = (rows.join(side, on) if on else rows.join(side, F.lit(True))).drop("_one")
        out = part if out is None else out.unionByName(part)
    return out


def request_problem(query: Column, top_k: Column, section: Column) -> Column:
    """Why a request is rejected; null if it is valid."""
    return (
        F.when(query.isNull() | (text.strip(query) == ""), "query must not be blank")
        .when(top_k.isNull() | (top_k < 1) | (top_k > V.MAX_TOP_K), "top_k out of range")
        .when(section.isNotNull() & ~section.isin(V.SECTION_TYPES), "unknown section")
    )


def scored(queries: DataFrame, corpus: DataFrame, on: Column | None = None) -> DataFrame:
    """score of every (query_vector, vector) pair that meets ``on``: an equi-join where ``on`` has equalities."""
    pairs = queries.join(corpus, on) if on is not None else queries.crossJoin(corpus)
    return pairs.withColumn("score", vectors.dot(F.col("query_vector"), F.col("vector")))


def ranked(pairs: DataFrame, by: list[str], most: int | Column | None = None, digits: int | None = None) -> DataFrame:
    """Adds rank within ``by``: best score first, then logical_key; only ranks up to ``most``."""
    score = F.round("score", digits) if digits else F.col("score")
    order = Window.partitionBy(*by).orderBy(score.desc(), "logical_key")
    rows = pairs.withColumn("rank", F.row_number().over(order))
    return rows if most is None else rows.where(F.col("rank") <= most)


def block_top_k(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query_id, logical_key, score and rank of the k best rows per query, without filters."""
    asked, rows = queries.select("query_id", "query_vector"), corpus.select("logical_key", "vector")
    return filtered_top_k(asked, rows, k, digits)


def block_scores(queries: DataFrame, corpus: DataFrame, digits: int = 6) -> DataFrame:
    """query_id, logical_key and score of every pair: products of blocks in place of a join of rows."""

    def pairs(ids, asked, keys, vectors):
        names = pa.array(keys, pa.string())
        for start in range(0, len(ids), PAIR_QUERIES):
            score = np.round(asked[start : start + PAIR_QUERIES] @ vectors.T, digits)
            row, column = np.divmod(np.arange(score.size), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(ids[start + row]), names.take(pa.array(column)), pa.array(score.ravel())], ["query_id", "logical_key", "score"])

    return _met(queries, corpus, pairs, "query_id bigint, logical_key string, score double")


def full_ranking(queries: DataFrame, corpus: DataFrame, digits: int = 6, own: str | None = None) -> DataFrame:
    """query_id, logical_key, score and rank of every pair: a query's ranking is cut into ranges of its scores, however long
    it is. ``own`` is a column of ``queries`` with a key that doesn't count for its query."""
    scores = block_scores(queries, corpus, digits)
    if own:
        mine = queries.select("query_id", F.col(own).alias("logical_key")).where("logical_key IS NOT NULL")
        scores = scores.join(mine, ["query_id", "logical_key"], "left_anti")
    return numbered(scores, ["query_id"], [F.col("score").desc(), F.col("logical_key")], "rank").withColumn("rank", F.col("rank").cast("int"))


def pair_scores(queries: DataFrame, corpus: DataFrame, pairs: DataFrame, digits: int = 6) -> DataFrame:
    """query_id, logical_key and score of given pairs, each once: joins by id and by key."""
    rows = pairs.select("query_id", "logical_key").join(queries.select("query_id", "query_vector"), "query_id").join(corpus.select("logical_key", "vector"), "logical_key")
    score = F.round(vectors.dot(F.col("query_vector"), F.col("vector")), digits)
    return rows.groupBy("query_id", "logical_key").agg(F.max(score).alias("score"))


def block_ranks(queries: DataFrame, corpus: DataFrame, relevant: DataFrame, digits: int = 6, own: str | None = None) -> DataFrame:
    """query_id, logical_key and rank of every relevant pair. ``own`` is a column of ``queries`` with a key that doesn't
    count for its query.

    Relevant pairs go to every block as rows, behind their query's vector. A block sorts its scores once per query and
    finds the place of each pair by binary search; the places add up over the blocks. A query with more pairs than a
    block has rows would send more rows than it has scores: such queries are ranked by ranges of their scores instead.
    """
    pairs = relevant.select("query_id", "logical_key").distinct()
    crowded = rewritten(pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CORPUS_ROWS).select("query_id"), "crowded")
    if crowded.isEmpty():
        return _places(queries, corpus, pair_scores(queries, corpus, pairs, digits), digits, own)
    few = pairs.join(crowded, "query_id", "left_anti")
    out = _places(queries, corpus, pair_scores(queries, corpus, few, digits), digits, own)
    ranking = full_ranking(queries.join(crowded, "query_id", "left_semi"), corpus, digits, own)
    return out.unionByName(ranking.select("query_id", "logical_key", "rank").join(pairs, ["query_id", "logical_key"], "left_semi"))


def first_ranks(queries: DataFrame, corpus: DataFrame, relevant: DataFrame, digits: int = 6, own: str | None = None) -> DataFrame:
    """query_id and the rank of its first relevant key: in every block the rows that beat its best relevant pair."""
    scores = pair_scores(queries, corpus, relevant.select("query_id", "logical_key").distinct(), digits)
    best = scores.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("logical_key").alias("k"))).alias("b"))
    best = best.select("query_id", F.col("b.k").alias("logical_key"), (-F.col("b.s")).alias("score"))
    return _places(queries, corpus, best, digits, own).select("query_id", "rank")


class _Block:
    """Rows of the corpus by key, and the order of their scores for one query at a time."""

    def __init__(self, keys: list[str], held: list[np.ndarray], digits: int) -> None:
        order = np.argsort(names := np.array(keys, object), kind="stable")
        self.keys, self.vectors, self.digits, self.size = names[order], np.concatenate(held)[order], digits, len(keys) + 1

    def ask(self, vector: np.ndarray, own: str | None) -> None:
        score = np.round(self.vectors @ vector, self.digits)
        self.levels, level = np.unique(-score, return_inverse=True)
        self.order = level * self.size + np.arange(len(score))  # by score, then by key
        kept = np.ones(len(score), bool)
        if own is not None:
            kept[np.searchsorted(self.keys, own, "left") : np.searchsorted(self.keys, own, "right")] = False
        self.order[~kept] = np.iinfo(np.int64).max
        self.sorted = np.sort(self.order)

    def before(self, keys: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How many rows come before each (key, score), the key's own row left out."""
        level = np.searchsorted(self.levels, -scores)
        known = level < len(self.levels)
        known[known] = self.levels[level[known]] == -scores[known]
        at = np.searchsorted(self.keys, keys)
        place = level * self.size + np.where(known, at, 0)
        count = np.searchsorted(self.sorted, place)
        mine = at < len(self.keys)
        mine[mine] = self.keys[at[mine]] == keys[mine]
        count[mine] -= self.order[at[mine]] < place[mine]
        return count


def _places(queries: DataFrame, corpus: DataFrame, wanted: DataFrame, digits: int, own: str | None) -> DataFrame:
    """query_id, logical_key and rank of wanted pairs (query_id, logical_key, score).

    Corpus rows go to hashed blocks, vectors of queries with wanted pairs and the pairs to every block, in one exchange. In
    a task the rows of a block come first, then each query before its pairs.
    """
    blocks = max(1, -(-corpus.count() // CORPUS_ROWS))
    none = lambda kind: F.lit(None).cast(kind)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")
    as_doubles = lambda c: F.col(c).cast("array<double>").alias("_vector")
    place = F.pmod(F.xxhash64("logical_key", "vector"), F.lit(blocks)).cast("int").alias("_block")
    row = lambda block, kind, id_, mark, *rest: (block, F.lit(kind).alias("_kind"), id_.cast("bigint").alias("_id"), F.lit(mark).alias("_mark"), *rest)
    held = corpus.select(*row(place, 0, F.lit(0), 0, F.col("logical_key").alias("_key"), as_doubles("vector"), none("double").alias("_score")))
    asked = queries.join(wanted.select("query_id").distinct(), "query_id", "left_semi")
    mine = F.col(own) if own else none("string")
    asked = asked.select(*row(every, 1, F.col("query_id"), 0, mine.alias("_key"), as_doubles("query_vector"), none("double").alias("_score")))
    pairs = wanted.select(*row(every, 1, F.col("query_id"), 1, F.col("logical_key").alias("_key"), none("array<double>").alias("_vector"), F.col("score").alias("_score")))
    order = ["_block", "_kind", "_id", "_mark"]
    rows = held.unionByName(asked).unionByName(pairs).repartition("_block").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, held, block = None, [], [], None
        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy() for i in range(4)])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                (own_block, kind, id_, mark), rows = marks[:, start].tolist(), batch.slice(start, end - start)
                if own_block != at:
                    at, keys, held, block = own_block, [], [], None
                if kind == 0:
                    keys += rows.column(4).to_pylist()
                    held.append(_matrix(rows.column(5)))
                    continue
                if not held:
                    continue
                block = block or _Block(keys, held, digits)
                if mark == 0:
                    block.ask(_matrix(rows.column(5))[0], rows.column(4)[0].as_py())
                else:
                    count = block.before(np.array(rows.column(4).to_pylist(), object), rows.column(6).to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(end - start, id_)), rows.column(4), pa.array(count.astype(np.int64))], ["query_id", "logical_key", "before"])

    counted = rows.mapInArrow(run, "query_id bigint, logical_key string, before bigint")
    return counted.groupBy("query_id", "logical_key").agg((F.sum("before") + 1).cast("int").alias("rank"))


#: Rows of a block of the corpus, about, and queries whose pairs make one Arrow batch.
CORPUS_ROWS, PAIR_QUERIES = 8192, 8


def _met(queries: DataFrame, corpus: DataFrame, function, schema: str) -> DataFrame:
    """``function`` (ids, query vectors, keys, vectors) over every query batch and block.

    Corpus rows go to hashed blocks and queries to every block in one exchange; within a task the rows of a block come
    before its queries, so that one block and one batch of queries are held.
    """
    blocks = max(1, -(-corpus.count() // CORPUS_ROWS))
    place = F.pmod(F.xxhash64("logical_key", "vector"), F.lit(blocks)).cast("int").alias("_block")
    as_doubles = lambda c: F.col(c).cast("array<double>").alias("_vector")
    left = corpus.select(place, F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_id"), F.col("logical_key").alias("_key"), as_doubles("vector"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")
    right = queries.select(every, F.lit(1).alias("_kind"), F.col("query_id").cast("bigint").alias("_id"), F.lit(None).cast("string").alias("_key"), as_doubles("query_vector"))
    rows = left.unionByName(right).repartition("_block").sortWithinPartitions("_block", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, held, block = None, [], [], None
        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy() for i in range(2)])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                (own, kind), rows = marks[:, start].tolist(), batch.slice(start, end - start)
                if own != at:
                    at, keys, held, block = own, [], [], None
                if kind == 0:
                    keys += rows.column(3).to_pylist()
                    held.append(_matrix(rows.column(4)))
                elif held:
                    block = block or (np.array(keys, object), np.concatenate(held))
                    for first in range(0, rows.num_rows, QUERY_ROWS):
                        part = rows.slice(first, QUERY_ROWS)
                        yield from function(part.column(2).to_numpy(), _matrix(part.column(4)), *block)

    return rows.mapInArrow(run, schema)


def rerank(hits: DataFrame, by: list[str], most: int | Column) -> DataFrame:
    """Orders candidates (rank, rerank_score) anew: best rerank_score first, the first rank on ties."""
    order = Window.partitionBy(*by).orderBy(F.col("rerank_score").desc(), "rank")
    return hits.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= most)


def shared_words(query: Column, passage: Column) -> Column:
    """How many different words both texts have: a stand-in for a pair scorer."""
    words = lambda c: F.split(F.lower(c), "[^a-z0-9]+")
    return F.size(F.array_intersect(words(query), words(passage))).cast("double")


def three_digits(score: Column) -> Column:
    """A score with three digits, rounded from its exact value. Java's formats round its shortest decimal form instead:
    half of the scores of four digits that end in 5 come out one too high."""

    @F.pandas_udf("string")
    def shown(scores: pd.Series) -> pd.Series:
        return pd.Series([None if null else "%.3f" % x for x, null in zip(scores, scores.isna(), strict=True)], dtype=object)

    return F.when(F.isnan(score), "nan").otherwise(shown(score))


def citation(hits: DataFrame) -> DataFrame:
    """Adds citation: score, drug, section and page; and snippet: the first 200 characters."""
    line = F.format_string("[%s] %s / %s / p.%d", three_digits(F.col("score")), F.col("drug_name"), F.col("section_type"), F.col("book_page"))
    return hits.withColumn("citation", line).withColumn("snippet", F.substring("text", 1, 200))


def used_filters(drug: Column, section: Column, species: Column) -> Column:
    """The filters of a request that are set, as a map."""
    all_ = F.create_map(F.lit("drug"), drug, F.lit("section"), section, F.lit("species"), species)
    return F.map_filter(all_, lambda _, v: v.isNotNull())


def section_order(key: Column) -> list[Column]:
    """Sort columns of logical keys: all but the ordinal, then the ordinal as a number."""
    tail = F.substring_index(key, "|", -1)
    return [key.substr(F.lit(1), F.length(key) - F.length(tail) - 1), tail.try_cast("int")]


def retrieve(requests: DataFrame, corpus: DataFrame, name_rows: DataFrame, rescore: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, empty, rejects) of requests (request_id, query, query_vector, drug, section, species, top_k).

    Names are resolved first; requests for unknown drugs are rejects with their reason. A request with a drug is joined
    by drug, the others search the corpus in blocks, with their filters as masks. With ``rescore`` (of query and text), the best MAX_TOP_K
    rows are ordered anew before the cut. ``resolved_from`` keeps the request's name if it was a near
    match.
    """
    checked = requests.withColumn("problem", request_problem(F.col("query"), F.col("top_k"), F.col("section")))
    rejects = checked.where("problem IS NOT NULL").select("request_id", "problem")
    valid = N.resolve(checked.where("problem IS NULL"), name_rows, "drug")
    unknown = valid.where("drug IS NOT NULL AND canonical IS NULL").select("request_id", F.lit("unknown drug").alias("problem"))
    valid = valid.where("drug IS NULL OR canonical IS NOT NULL").withColumn("want_species", text.requested_species("species"))
    valid = valid.withColumn("resolved_from", F.when(~F.col("exact"), F.col("drug")))
    asked = valid.select("request_id", "query", "query_vector", F.col("canonical").alias("want_drug"), F.col("section").alias("want_section"), "want_species", "resolved_from", "top_k")
    rest = metadata_filter(F.lit(None), F.col("want_section"), F.col("want_species"))
    by_drug = scored(asked.where("want_drug IS NOT NULL"), corpus, (F.col("want_drug") == F.col("drug_name")) & rest)
    by_drug = ranked(by_drug, ["request_id"], V.MAX_TOP_K)
    found = filtered_top_k(asked.where("want_drug IS NULL").withColumnRenamed("request_id", "query_id"), corpus, V.MAX_TOP_K, 12)
    found = found.withColumnRenamed("query_id", "request_id")
    others = asked.join(found, "request_id").join(corpus, "logical_key")
    hits = by_drug.unionByName(others.select(*by_drug.columns)).where(F.col("rank") <= F.col("top_k"))
    if rescore is not None:
        candidates = by_drug.unionByName(others.select(*by_drug.columns)).where(F.col("rank") <= F.greatest("top_k", F.lit(V.MAX_TOP_K)))
        hits = rerank(candidates.withColumn("rerank_score", rescore(F.col("query"), F.col("text"))), ["request_id"], F.col("top_k")).drop("rank", "rerank_score").withColumnRenamed("new_rank", "rank")
    filters = used_filters(F.col("want_drug"), F.col("want_section"), F.col("want_species"))
    empty = asked.join(hits.select("request_id").distinct(), "request_id", "left_anti").select("request_id", "query", filters.alias("filters"))
    return hits, empty, rejects.unionByName(unknown)

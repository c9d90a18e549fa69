"""Whitening, the filter audit and source mixes against plain versions, on awkward tables and on the supplied ones."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest

from tests.compare import assert_same, connect
from vademecum.llm import filter_audit, mixing, queries, whitening

GAP = re.compile(r"[\x20\x09-\x0D]+")
LONG = " ".join(f"Word{i % 777} x{i}" for i in range(30_000))
DOCS = "doc_id long, text string, source string, n_chars long, words string, fails string, part string, digest string, size string, key string, n string"
TEXTS = ["", "   ", "one two", "A B C D E F", "cost # 5", "the same " * 40, " ".join(f"w{i}" for i in range(60)), LONG, "été 日本 " * 30, "A&B |x|", None]
DOC_ROWS = [(i, TEXTS[i % len(TEXTS)], ["b", "a", None, "", "ä", "B"][i * 7 % 6], i, "x", "x", "x", "x", "x", "x", "x") for i in range(90)]
DOC_ROWS += [(None, "the same " * 40, "a", *"12345678"), (None, None, None, *"12345678"), (5, TEXTS[5], "b", *"12345678"), (5, TEXTS[5], "b", *"12345678"), (-3, "cost # 5", "a", *"12345678"), (300, "one two", "z", *"12345678"), (301, "three", "z", *"12345678"), (302, "", "y", *"12345678")]
DOC_ROWS = [(*r[:3], int(r[3]), *r[4:]) for r in DOC_ROWS]
LABEL_ROWS = [(i, i % 2, (i // 2) % 2) for i in range(0, 90, 3)] + [(0, None, 1), (7, 1, None), (7, 0, 0), (None, 1, 1)]


def words_of(text):
    return [w for w in GAP.split(text or "") if w]


def test_audit_equals_plain_filters(spark):
    docs = spark.createDataFrame(DOC_ROWS, DOCS)
    labels = spark.createDataFrame(LABEL_ROWS, "doc_id long, quality int, toxic int")
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(filter_audit.patterns(docs, labels)).collect()}
    first = {}
    for i, text, *_ in DOC_ROWS:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = {i for i, q, _ in LABEL_ROWS if q == 1 and i is not None}, {i for i, _, t in LABEL_ROWS if t == 1 and i is not None}
    rows = []
    for i, text, source, *_ in DOC_ROWS:
        t, w = text or "", words_of(text)
        capitals = sum("A" <= c <= "Z" for c in t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * capitals > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first.get(t, i) < i}
        rows.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    wanted, shapley = {}, collections.Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                out = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[part, f] += len(out)
                wanted[part, "".join(order), step] = (len(left), len(out), sum(f in r[1] for r in own) - len(out), sum(r[1] == {f} for r in own), sum(r[2] for r in out), sum(r[3] for r in out), f)
    assert found == {k: (*v[:6], shapley[k[0], v[6]]) for k, v in wanted.items()}


def test_contraction_of_a_tensor():
    tensor = np.arange(64).reshape(2, 2, 2, 2, 2, 2)
    P, F, A = filter_audit.PASS, filter_audit.FAIL, filter_audit.ALL
    got = filter_audit.contracted(tensor, np.array([[A, A, A, A, A], [P, F, A, A, P], [F, F, F, F, F]]))
    assert got.tolist() == [[t.sum(), t[0, 1, :, :, 0].sum(), t[1, 1, 1, 1, 1]] for t in tensor]


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(filter_audit.patterns(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0
    some = spark.createDataFrame(DOC_ROWS[:1], DOCS)
    rows = filter_audit.audit(filter_audit.patterns(some, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect()
    assert len(rows) == 600 and {r["shapley"] for r in rows} == {0, 120}


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_source_mix"])
def test_queries_equal_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name])


def plain_targets(sizes):
    """Targets by rounds, as the task words them."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight, out, room = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, sum(sizes.values())
    open_ = set(order)
    while open_:
        level = room / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not above:
            return out | {s: weight[s] * level for s in open_}
        for s in above:
            out[s] = 3 * sizes[s]
        open_ -= above
        room -= sum(3 * sizes[s] for s in above)
    return out


def test_mix_equals_sorted_mix(spark):
    docs = spark.createDataFrame(DOC_ROWS, DOCS)
    rows = mixing.sized(docs)
    found = mixing.mixed(rows, mixing.plan(rows)).collect()
    again = mixing.sized(docs.orderBy(mixing.F.rand(3)).repartition(7))
    assert sorted(map(str, mixing.mixed(again, mixing.plan(again)).collect())) == sorted(map(str, found))
    sizes = collections.Counter()
    keyed = collections.defaultdict(lambda: collections.defaultdict(int))
    for i, text, source, *_ in DOC_ROWS:
        own = f"{'' if i is None else i}:{hashlib.md5((text or '').encode()).hexdigest()}"
        key = int(hashlib.md5(own.encode()).hexdigest()[:15], 16)
        sizes[source] += len(words_of(text))
        keyed[source][key] += len(words_of(text))
    targets = plain_targets(sizes)
    assert any(t == 3 * sizes[s] for s, t in targets.items() if sizes[s]) and any(t < 3 * sizes[s] for s, t in targets.items())
    copies = {}
    for source, target in targets.items():
        times = int(target // sizes[source]) if sizes[source] else 0
        budget, words = target - times * sizes[source], 0
        for key, size in sorted(keyed[source].items()):
            more = budget > 0 and words <= budget and (words + size <= budget or words + size - budget < budget - words)
            copies[source, key] = times + more
            words += size
    assert len(found) == len(DOC_ROWS)
    for r in found:
        assert (r["source_size"], r["copies"], r["taken"]) == (sizes[r["source"]], copies[r["source"], r["key"]], r["size"] * r["copies"])
        assert math.isclose(r["target"], targets[r["source"]], abs_tol=1e-9) and r["taken"] <= 3 * r["size"]


def test_mix_of_many_equal_keys_and_large_budgets(spark):
    rows = spark.createDataFrame([("a", k, 1) for k in [5] * 40 + [6] * 10 + [(1 << 60) - 1] * 5], "source string, key long, size long")
    for budget, most in [(1.0, 4), (19.0, 4), (20.0, 4), (21.0, 5), (44.0, 5), (45.5, 6), (52.4, 6), (52.6, (1 << 60) - 1)]:
        budgets = spark.createDataFrame([("a", budget), ("b", 4.0), (None, 1.0)], "source string, budget double")
        (found,) = mixing.thresholds(rows, budgets).collect()
        assert found["source"] == "a" and [k for k in (5, 6, (1 << 60) - 1) if k <= found["threshold"]] == [k for k in (5, 6, (1 << 60) - 1) if k <= most]


def test_thresholds_are_nested(spark):
    rows = mixing.sized(spark.createDataFrame(DOC_ROWS, DOCS)).where("source = 'a'")
    total = rows.agg(mixing.F.sum("size")).first()[0]
    cuts = [mixing.thresholds(rows, spark.createDataFrame([("a", total * x)], "source string, budget double")).first()["threshold"] for x in (0.1, 0.4, 0.7, 0.99)]
    assert cuts == sorted(cuts)


def test_mix_of_nothing(spark):
    for made in ([], [(1, None, None), (2, "", "a")]):
        rows = mixing.sized(spark.createDataFrame(made, "doc_id long, text string, source string"))
        assert [(r["target"], r["taken"]) for r in mixing.mixed(rows, mixing.plan(rows)).collect()] == [(0.0, 0)] * len(made)


def plain_whitening(vectors, components=4):
    """id, deviation and signless whitened values by numpy, from (id, vector)."""
    rows = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in rows:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        for k in range(min(components, len(e))):
            out.append((i, k + 1, n, deviation, float((np.array(x) - np.array([s / n for s in sums])) @ u[:, k] / math.sqrt(e[k])), e[k] / e.sum()))
    return out


def assert_whitened(found, wanted):
    def key(r):
        return (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))

    found, wanted = sorted((tuple(r) for r in found), key=key), sorted(wanted, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in wanted]
    for k in {r[1] for r in wanted}:
        a, b = (np.array([r[4] for r in rows if r[1] == k]) for rows in (found, wanted))
        a = a if abs(a - b).max() < abs(a + b).max() else -a
        assert abs(a - b).max() < 1e-8
    assert np.allclose([r[5] for r in found], [r[5] for r in wanted], rtol=1e-9)
    assert {r[6] for r in found} and max(r[6] for r in found) < 1e-9


def test_whitening_equals_numpy(spark, sf_dir):
    rows = queries.queries()["op11_block_whitening"](spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert_whitened(rows, plain_whitening([tuple(r) for r in table]))


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    made = [(i, [float(c) for c in rng.normal(size=6) * [5, 4, 3, 2, 1, 0.5]]) for i in range(1500)]
    made += [(None, made[0][1])] * 3 + [(7, made[1][1])] * 900
    made += [(9001, None), (9002, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (9003, [float("nan")] + [0.0] * 5), (9004, [float("inf")] + [0.0] * 5), (9005, []), (9006, [1.0])]
    usable = [(i, v) for i, v in made if i is None or i < 9000]
    table = spark.createDataFrame([(i, v, "x", "y", 1) for i, v in made], "vec_id long, embedding array<double>, x string, place string, n int")
    assert_whitened(whitening.whiten(table).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect(), plain_whitening(usable))


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], schema)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one, key=lambda r: (r["vec_id"], r["component"]))] == [(c, 1, 0, None, 0.0, 0.0) for _ in "12" for c in (1, 2)]
    flat = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.0]), (2, [-0.5, 0.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], None if r["whitened"] is None else round(abs(r["whitened"]), 9)) for r in flat) == [(1, 1, 1.0), (1, 2, None), (2, 1, 1.0), (2, 2, None)]


def test_whitening_beyond_64_bits_raises(spark):
    with pytest.raises(Exception, match="64 bits|overflow|OVERFLOW"):
        whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()

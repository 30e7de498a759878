import math
import random

import pytest
from pyspark.sql import functions as F

from vellumine.operators import evaluation as E
from vellumine.operators import faithfulness as V
from vellumine.operators import gold as G
from vellumine.operators import retrieval as R


def vectors(n, dims, seed):
    rng = random.Random(seed)
    return [(i, [rng.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_topk_with_ties_in_several_blocks(spark, metric, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 50)
    rows = vectors(230, 4, 1)
    corpus = spark.createDataFrame([*rows, (999, None)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(-i, v) for i, v in rows[:120]], "query_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in R.topk(queries, corpus, 7, metric).collect()}

    def score(a, b):
        return -sum(x * y for x, y in zip(a, b)) if metric == "ip" else sum((x - y) ** 2 for x, y in zip(a, b))

    for i, q in rows[:120]:
        want = sorted((round(score(q, v), 9), j) for j, v in rows)[:7]
        assert [got[-i, k] for k in range(7)] == [j for _, j in want]
    with pytest.raises(ValueError):
        R.topk(queries, corpus, 0)
    assert R.topk(queries, corpus.limit(0), 3, metric).count() == 0


def test_maxsim(spark):
    rng = random.Random(2)
    tokens = lambda key, n: [(i, t, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(n) for t in range(rng.randint(1, 4))]
    q, d = tokens("q", 5), tokens("d", 40)
    got = {(r.query_id, r.rank): r.vec_id for r in R.maxsim(spark.createDataFrame(q, "query_id long, tok int, v array<double>"), spark.createDataFrame(d, "vec_id long, tok int, v array<double>"), 6).collect()}
    for i in range(5):
        s = {}
        for j in range(40):
            s[j] = sum(max(sum(a * b for a, b in zip(x, y)) for k, _, y in d if k == j) for m, _, x in q if m == i)
        want = sorted(s, key=lambda j: (-round(s[j], 9), j))[:6]
        assert [got[i, k] for k in range(6)] == want


def test_metrics_of_repeats_and_uncovered_queries(spark):
    hits = spark.createDataFrame([("a", "x", 0), ("a", "x", 1), ("a", "z", 2), ("a", "y", 3), ("c", "x", 0)], "query_id string, item string, rank int")
    gold = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None), ("d", "q")], "query_id string, item string")
    m = {r.query_id: r for r in E.ranking_metrics(hits, gold, (3, 5)).collect()}
    assert m["a"].precision_3 == pytest.approx(2 / 3) and m["a"].precision_5 == pytest.approx(3 / 4)
    assert m["a"].recall_3 == 0.5 and m["a"].recall_5 == 1.0 and m["a"].mrr == 1.0
    assert m["a"].ndcg_5 == pytest.approx((1 + 1 / math.log2(5)) / (1 + 1 / math.log2(3)))
    assert m["b"].mrr is None and m["b"].recall_3 is None and m["d"].mrr == 0.0 and set(m) == {"a", "b", "d"}
    assert E.macro_average(E.ranking_metrics(hits, gold, (3,))).first().n == 2


@pytest.mark.parametrize("a,b,want", [((0, 10), (5, 15), True), ((0, 10), (10, 20), False), ((10, 20), (0, 10), False), ((0, 10), (2, 3), True), ((2, 3), (0, 10), True), ((0, 1), (0, 1), True)])
def test_half_open_overlap(spark, a, b, want):
    assert spark.range(1).select(E.overlap(F.lit(a[0]), F.lit(a[1]), F.lit(b[0]), F.lit(b[1])).alias("o")).first().o is want


def test_kappa(spark):
    df = lambda rows: spark.createDataFrame(rows, "annotator_label string, reviewer_label string")
    assert G.cohens_kappa(df([("s", "s"), ("c", "c")])).first().kappa == 1.0
    assert G.cohens_kappa(df([("s", "c"), ("c", "s")])).first().kappa < 0
    assert G.cohens_kappa(df([("s", "s")] * 3)).first().kappa == 1.0
    assert G.cohens_kappa(df([])).first().kappa is None


def test_four_way_verification(spark):
    claims = spark.createDataFrame([(1, "grants raise output", None), (2, "grants raise output", "x"), (3, "grants raise output", "d"), (4, "grants raise output", "e"), (5, "grants raise output", "n")], "id int, claim string, cited_source_id string")
    sources = spark.createDataFrame([("d", "Grants raise the output."), ("e", "Nothing of it."), ("n", None)], "source_id string, passage string")
    got = {r.id: r.label for r in V.verify(claims, sources).collect()}
    assert got == {1: "no_citation", 2: "fabricated_source", 3: "supported", 4: "not_supported", 5: "not_supported"}


def test_bootstrap_covers_the_mean(spark):
    r = E.bootstrap_ci(spark.range(200).select((F.col("id") % 2).cast("double").alias("v")), "v", 200).first()
    assert r.low < r.mean == 0.5 < r.high and r.high - r.low < 0.25

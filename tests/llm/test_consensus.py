import datetime as d
import random
from collections import Counter

import pytest

from vellumine.llm.consensus import agreement, consensus, latest_votes

LABELS = ["supports", "contradicts", "unrelated"]


def frame(spark, votes):
    return spark.createDataFrame(votes, "pair_id string, claim_id string, rater string, label string")


def simulated(n, seed):
    """Careful, middling, yes-saying, random and label-swapping raters."""
    rng = random.Random(seed)
    careful, middling = [f"c{i}" for i in range(8)], [f"m{i}" for i in range(4)]
    kinds = {**dict.fromkeys(careful, 0.92), **dict.fromkeys(middling, 0.78), "yes": "yes", "yes2": "yes", "dice": "dice", "swap": "swap"}
    truth, votes = {}, []
    for i in range(n):
        t = truth[f"q{i}"] = rng.choices(LABELS, (6, 2, 2))[0]
        for r in rng.sample(list(kinds), rng.randint(3, 7)):
            k = kinds[r]
            if k == "yes":
                v = "supports" if rng.random() < 0.93 else t
            elif k == "dice":
                v = rng.choice(LABELS)
            elif k == "swap":
                v = {"supports": "contradicts", "contradicts": "supports"}.get(t, t)
            else:
                v = t if rng.random() < k else rng.choice([x for x in LABELS if x != t])
            votes.append((f"q{i}", "c1", r, v))
    return truth, votes


def test_better_than_the_majority(spark):
    truth, votes = simulated(400, 4)
    items, raters = consensus(frame(spark, votes), ["pair_id", "claim_id"], LABELS, method="confusion")
    got = {r.pair_id: r.consensus_label for r in items.collect()}
    by = {}
    for q, _, _, v in votes:
        by.setdefault(q, Counter())[v] += 1
    majority = sum(c.most_common(1)[0][0] == truth[q] for q, c in by.items()) / len(truth)
    ours = sum(got[q] == t for q, t in truth.items()) / len(truth)
    assert ours > majority + 0.05 and ours > 0.88, (ours, majority)
    for method, better in (("label", 0.04), ("rater", 0.03)):
        items, raters = consensus(frame(spark, votes), ["pair_id", "claim_id"], LABELS, method=method)
        other = {r.pair_id: r.consensus_label for r in items.collect()}
        assert sum(other[q] == t for q, t in truth.items()) / len(truth) > majority + better
        reliability = {r.rater: r.reliability for r in raters.collect()}
        assert min(reliability[f"c{i}"] for i in range(8)) > max(reliability[r] for r in ("dice", "swap"))
    reliability = {r.rater: r.reliability for r in raters.collect()}
    assert min(reliability[f"c{i}"] for i in range(8)) > max(reliability[r] for r in ("dice", "swap"))


def test_latest_usable_vote(spark):
    t = d.datetime(2025, 1, 1)
    rows = [
        ("q", "Ann ", " Supports", t), ("q", "ann", "contradicts", t + d.timedelta(1)), ("q", "ANN", "?", t + d.timedelta(2)), ("q", "bob", "unrelated", None), ("q", "bob", "supports", t),
        ("q", None, "supports", t), ("q", "  ", "supports", t), ("q", "adversarial", "supports", t), ("q", "eve", "unrelated", t), ("q", "eve", "supports", t), ("q", "eve", "supports", t),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "pair_id string, rater string, label string, at timestamp_ntz, item string")
    got = {r.rater: r.label for r in latest_votes(df, ["pair_id"], "rater", "label", "at", LABELS, ("adversarial",)).collect()}
    assert got == {"ann": "contradicts", "bob": "supports", "eve": "supports"}


def test_ties_and_nothing(spark):
    items, raters = consensus(frame(spark, [("q", "c", "a", "unrelated"), ("q", "c", "b", "contradicts")]), ["pair_id", "claim_id"], LABELS)
    assert [r.n_raters for r in items.collect()] == [2] and raters.count() == 2
    items, raters = consensus(frame(spark, []), ["pair_id", "claim_id"], LABELS)
    assert items.count() == 0 and raters.count() == 0


def brute_alpha(votes):
    units = {}
    for q, c, _, v in votes:
        units.setdefault((q, c), []).append(v)
    units = [u for u in units.values() if len(u) > 1]
    n = sum(map(len, units))
    do = sum(sum(a != b for i, a in enumerate(u) for j, b in enumerate(u) if i != j) / (len(u) - 1) for u in units) / n
    m = Counter(v for u in units for v in u)
    de = sum(m[a] * m[b] for a in m for b in m if a != b) / (n * (n - 1))
    return 1 - do / de if de else 1.0


def test_alpha(spark):
    _, votes = simulated(60, 9)
    assert agreement(frame(spark, votes), ["pair_id", "claim_id"]).first().alpha == pytest.approx(brute_alpha(votes))
    assert agreement(frame(spark, [("q", "c", "a", "supports"), ("q", "c", "b", "supports")]), ["pair_id"]).first().alpha == 1.0
    assert agreement(frame(spark, []), ["pair_id"]).first().alpha is None


def test_many_raters_are_joined_under_salts(spark, monkeypatch):
    from vellumine.llm import consensus as module

    _, votes = simulated(120, 5)
    run = lambda: {r.pair_id: (r.consensus_label, round(r.confidence, 9)) for r in consensus(frame(spark, votes), ["pair_id", "claim_id"], LABELS)[0].collect()}
    want = run()
    monkeypatch.setattr(module, "BROADCAST_RATERS", 0)
    assert run() == want


def test_an_unfinished_result_is_an_error(spark, monkeypatch):
    from vellumine.llm import consensus as module

    _, votes = simulated(120, 5)
    monkeypatch.setattr(module, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        consensus(frame(spark, votes), ["pair_id", "claim_id"], LABELS)
    with pytest.raises(ValueError):
        consensus(frame(spark, votes), ["pair_id", "claim_id"], LABELS, method="?")

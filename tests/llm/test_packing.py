import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumine.llm.mixing import mix, shares_reached
from vellumine.llm.packing import best_fit, pack, window_shares
from vellumine.llm.tokens import Counter, TOKENIZER, TOKENIZER_DIR, _encoding, with_tokens


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_best_fit_never_overflows(sizes):
    bins = best_fit(sizes, 50)
    fill = {}
    for s, b in zip(sizes, bins):
        fill[b] = fill.get(b, 0) + s
    assert all(v <= 50 for v in fill.values())
    assert len(fill) <= 2 * sum(sizes) / 50 + 1


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, n_tokens int, container string")


def test_containers(spark):
    rng = random.Random(5)
    rows = [(i, "big" if i % 3 else rng.choice(["s1", "s2", None]), rng.randint(1, 300)) for i in range(3000)]
    rows += [(9001, "s1", 1250), (9002, "s2", 0), (9003, None, None), (9004, "s1", 500), (9004, "s1", 500), (None, "s2", 70)]
    limits = spark.createDataFrame([(1, 500), (2, 100), (3, 0)], "limit_id int, capacity_tokens int")
    out = pack(docs(spark, rows), limits).collect()
    total = sum(r[2] or 0 for r in rows)
    for limit, cap in ((1, 500), (2, 100)):
        mine = [r for r in out if r.limit_id == limit]
        fill = {}
        for r in mine:
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
        assert max(fill.values()) <= cap and sum(fill.values()) == total
        assert total / (len(fill) * cap) > 0.95
        parts = {}
        for r in mine:
            parts.setdefault(r.doc_id, []).append(r)
        assert {i for i, p in parts.items() if len(p) > 1} == {i for i, _, n in rows if (n or 0) > cap} | {9004}
    assert {r.limit_id for r in out} == {1, 2}
    assert pack(docs(spark, []), limits).count() == 0


def test_windows_keep_the_proportions(spark):
    rows = [(i, "a" if i % 2 else "b", 10) for i in range(4000)]
    limits = spark.createDataFrame([(1, 100)], "limit_id int, capacity_tokens int")
    shares = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "source string, share double")
    out = pack(docs(spark, rows), limits, shares, containers=16).collect()
    assert len(out) == 4000
    for w in range(12):  # 2,666 texts of a are served before the first source is used up
        here = [r.doc_id % 2 for r in out if r.window == w]
        assert len(here) == 160 and abs(sum(here) / len(here) - 0.75) < 0.02
    assert {r.doc_id % 2 for r in out if r.window == 24} == {0}  # what is left of b
    got = window_shares(pack(docs(spark, rows), limits, shares, containers=16), shares).filter("window = 3").collect()
    assert {(r.source, round(r.actual_share, 2), r.last_window) for r in got} == {("a", 0.75, 16), ("b", 0.25, 24)}


def test_deficits_carry_over_windows(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("abc"), rng.randint(1, 3000)) for i in range(2000)] + [(9000 + i, None, 40) for i in range(500)]
    limits = spark.createDataFrame([(1, 500)], "limit_id int, capacity_tokens int")
    shares = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2), ("d", 0.9)], "source string, share double")
    out = pack(docs(spark, rows), limits, shares, containers=64).collect()
    total, served = {}, {}
    for w in range(20):
        for r in (r for r in out if r.window == w and r.source):
            served[r.source] = served.get(r.source, 0) + r.n_tokens
        total = sum(served.values())
        for s, t in (("a", 0.5), ("b", 0.3), ("c", 0.2)):  # never further off than a part of a text, however many windows
            assert abs(served[s] - t * total) < 3 * 500
    assert sum(r.n_tokens for r in out) == sum(n for _, _, n in rows)
    names = {}
    for r in out:
        names[r.container] = names.get(r.container, 0) + r.n_tokens
    assert max(names.values()) <= 500


def test_empty_items_fill_no_window_beyond_its_bound(spark):
    rows = [(i, "a", 0) for i in range(5000)] + [(9000, "a", 7)]
    limits = spark.createDataFrame([(1, 10)], "limit_id int, capacity_tokens int")
    out = pack(docs(spark, rows), limits, containers=16).collect()
    assert len(out) == 5001 and max(sum(r.n_tokens for r in out if r.container == c) for c in {r.container for r in out}) <= 10


TARGETS = [("big", 0.5, 1), ("mid", 0.2, 2), ("small", 0.2, 4), ("absent", 0.1, 3)]


def mixture_rows(n, seed=6):
    rng = random.Random(seed)
    rows = [(i, rng.choices(["big", "mid", "small"], (20, 4, 1))[0], rng.randint(5, 80)) for i in range(n)]
    return rows + [(90000, None, 10), (90001, "other", 10), (90002, "mid", 0), (90003, "mid", None)]


def test_mixture(spark):
    rows = mixture_rows(4000)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed = mix(docs(spark, rows), targets, block_tokens=500)
    got = {r.source: r for r in shares_reached(mixed, docs(spark, rows), targets).collect()}
    for s, t in (("big", 0.5), ("mid", 0.2), ("small", 0.2)):
        assert abs(got[s].actual_share - t / 0.9) < 0.01
    assert got["absent"].n_tokens == 0 and got["absent"].shortfall_tokens > 0 and got["small"].most_repeats <= 4 and got["big"].most_repeats == 1
    uses = {}
    for r in mixed.collect():
        uses.setdefault((r.source, r.doc_id), []).append(r.epoch)
    assert all(len(e) == len(set(e)) for e in uses.values())
    first = [r for r in mixed.collect() if r.slot < 40]  # any stretch of slots is close to the targets
    assert abs(sum(r.n_tokens for r in first if r.source == "big") / sum(r.n_tokens for r in first) - 0.5 / 0.9) < 0.08
    assert mix(docs(spark, []), targets).count() == 0
    assert mix(docs(spark, rows), targets.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2000, 20_000])
def test_a_wanted_total_is_filled_and_shortfalls_are_told(spark, n):
    rows = mixture_rows(n)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    of = {s: sum(k or 0 for _, x, k in rows if x == s) for s in ("big", "mid", "small")}
    total = 2 * of["big"]  # big can give its part, mid and small all their repeats
    df = docs(spark, rows)
    mixed = mix(df, targets, total, block_tokens=500)
    got = {r.source: r for r in shares_reached(mixed, df, targets, total).collect()}
    for s, share, repeats in TARGETS[:3]:
        want = min(share * total, repeats * of[s])
        assert want <= got[s].n_tokens < want + 80
        assert got[s].shortfall_tokens == max(0, round(share * total) - got[s].n_tokens)
    assert got["absent"].shortfall_tokens == round(0.1 * total)
    slots = {}
    for r in mixed.collect():
        slots.setdefault(r.slot, set()).add(r.source)
    assert all(len(s) == 1 for s in slots.values())  # no two sources in one slot
    reached = {s: g.n_tokens for s, g in got.items()}
    half = [r for r in mixed.collect() if r.slot < max(slots) / 2]
    for s in of:
        assert abs(sum(r.n_tokens for r in half if r.source == s) / sum(r.n_tokens for r in half) - reached[s] / sum(reached.values())) < 0.04


def test_token_counts(spark):
    with open(f"{TOKENIZER_DIR}/{TOKENIZER}", "rb") as f:
        path = f.read()
    c = Counter(path)
    for t in ("Hello, world! It's 2024.", "日本語 text\n\n  spaces", "", None):
        assert c(t) == (len(_encoding(path).encode_ordinary(t)) if t else 0)
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "i int, text string")
    assert [r.n_tokens for r in with_tokens(df).orderBy("i").collect()] == [3, 0, 0]

import random

import pytest

from vellumine.llm import neardup
from vellumine.llm.neardup import Shingler, document_pairs, near_duplicates, signature, trees_needed


def brute(rows, size, threshold):
    s = Shingler(size)
    sets = {i: set(s(t).tolist()) for i, _, t in rows}
    groups = {i: g for i, g, _ in rows}
    ids = [i for i in sets if sets[i]]
    out = set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if groups[a] is not None and groups[b] is not None and groups[a] != groups[b]:
                common = len(sets[a] & sets[b])
                if common / len(sets[a] | sets[b]) >= threshold:
                    out.add((min(a, b), max(a, b)))
    return out


def corpus(seed, n=120, copies=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(800)]
    rows = []
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 4) if c else 0):
                text[rng.randrange(len(text))] = rng.choice(words)
            if c == 2 and rng.random() < 0.3:
                text.insert(rng.randrange(len(text)), "Extra, inserted")
            rows.append((f"d{i}_{c}", f"g{c % 3}", " ".join(text)))
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "chunk_id string, paper_id string, text string, n int, set_id string")
    pairs, members = near_duplicates(df, "chunk_id", "text", shingle=3, threshold=0.7, **kw)
    return {tuple(r) for r in document_pairs(pairs, members, df, "chunk_id", "paper_id").collect()}


def test_every_pair_and_no_other(spark):
    rows = corpus(1)
    rows += [("e1", "g0", None), ("e2", "g1", ""), ("e3", "g1", "two words"), ("n1", None, rows[0][2]), ("t1", "g5", rows[0][2].upper() + "!!"), ("t1", "g5", rows[0][2].upper() + "!!"), ("long", "g7", rows[5][2] * 200), ("long2", "g8", rows[5][2] * 200)]
    want = brute(rows, 3, 0.7)
    assert run(spark, rows) == want and len(want) > 100


def test_crowded_nodes_lose_nothing(spark):
    base = corpus(2, 1, 1)[0][2].split()
    rng = random.Random(3)
    rows = []
    for i in range(150):  # one tight cluster: every node is crowded
        t = list(base)
        t[rng.randrange(len(t))] = f"x{rng.randrange(40)}"
        rows.append((f"c{i:03}", f"g{i % 5}", " ".join(t)))
    for limit in (20, 60):  # nodes, and some of the lists that replace them, go over the limit
        assert run(spark, rows, node_limit=limit) == brute(rows, 3, 0.7)


def test_texts_with_much_in_common_that_are_no_duplicates(spark):
    rng = random.Random(11)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(90):  # two thirds are the same everywhere; pairs of neighbours share the rest as well
        own = random.Random(i // 2)
        rows.append((f"c{i:03}", f"g{i % 7}", " ".join(shared + [f"o{own.randrange(10**6)}" for _ in range(40)] + [f"x{rng.randrange(10**6)}"])))
    want = brute(rows, 3, 0.7)
    assert run(spark, rows, node_limit=10) == want and 30 < len(want) < 60


def test_each_pair_of_a_long_list_is_compared_once(spark):
    from pyspark.sql import functions as F

    lists = spark.range(70).select(F.lit(5).cast("long").alias("node"), F.col("id").cast("string").cast("binary").alias("set_id"), F.lit(9).alias("n"), F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"), F.lit(70).cast("long").alias("size"))
    once = F.when(F.col("diagonal_a"), F.col("own_a") == F.col("own_b")).otherwise(F.col("own_a") != F.col("own_b"))
    pairs = neardup._meet(neardup._in_cells(lists, 20), 0.7, once)
    assert pairs.count() == pairs.distinct().count() == 70 * 69 // 2


def test_prefixes_are_shortened_until_the_target(spark):
    df = spark.createDataFrame(corpus(12), "chunk_id string, paper_id string, text string")
    far = neardup.search(df, "chunk_id", "text", shingle=3, threshold=0.7, target=0.5)
    whole = neardup.search(df, "chunk_id", "text", shingle=3, threshold=0.7, target=1.0)
    floor = neardup.depth_for(0.7, 0.999)
    assert far.depth > whole.depth == floor and 0.5 <= far.recall <= whole.recall
    assert far.pairs.count() < whole.pairs.count()


def test_crowded_nodes_at_the_default_limit(spark):
    base = corpus(4, 1, 1)[0][2].split()
    rng = random.Random(5)
    rows = []
    for i in range(2300):  # variants of one template, far enough apart that few pairs are duplicates
        t = [f"v{rng.randrange(10**6)}" if rng.random() < 0.06 else w for w in base]
        rows.append((f"c{i:04}", f"g{i % 5}", " ".join(t)))
    got, want = run(spark, rows), brute(rows, 3, 0.7)
    assert len(want) > 10_000 and got <= want and len(got) / len(want) > 0.999


def test_empty_table(spark):
    assert run(spark, []) == set()


def test_the_recall_follows_from_depth_and_trees():
    d = neardup.depth_for(0.7, 0.999)
    n = trees_needed(0.7, d, 0.999)
    assert n * d <= neardup.LABELS and 1 - (1 - 0.7**d) ** n >= 0.999


def test_long_text_signature_is_that_of_its_set():
    s = Shingler(3)
    t = " ".join(f"w{i % 7001}" for i in range(30_000))
    assert (signature(s(t)) == signature(s(t + " " + t[:0]))).all()


def test_groups_are_the_connected_components(spark):
    rows = corpus(7, 60, 3)
    df = spark.createDataFrame([(*r, 1) for r in rows + [("copy", "g9", rows[0][2])]], "chunk_id string, paper_id string, text string, n int")
    pairs, members = near_duplicates(df, "chunk_id", "text", shingle=3, threshold=0.7)
    got = {r.id: r for r in neardup.groups(pairs, members).collect()}
    parent = {i: i for i in got}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute([(i, i, t) for i, _, t in rows] + [("copy", "copy", rows[0][2])], 3, 0.7):
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {i: r.class_id for i, r in got.items()} == {i: find(i) for i in got}
    assert got["copy"].n_copies >= 2 and neardup.groups(*near_duplicates(df.limit(0), "chunk_id", "text")).count() == 0

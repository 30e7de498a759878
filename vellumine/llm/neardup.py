"""Near-duplicate texts by a MinHash LSH forest with exact verification.

Texts become sets of hashed word shingles; equal sets are one class from then on. A tree of the forest
is a trie over the classes' label sequences, cut from their MinHash signatures: its rows are sorted by
their labels, so the classes that share a prefix stand together. Two classes that share ``floor``
labels in some tree meet; the longest prefix they share in any tree is kept with the pair. Matched
prefixes are then shortened, from the longest down: the pairs of each length are verified on their
full shingle sets, and the recall so far is estimated from them, as a pair of likeness ``s`` shares
``d`` labels in one of ``t`` trees with probability ``1 - (1 - s^d)^t``. When the estimate reaches
``target``, no shorter prefix is tried. ``floor`` is the length at which a pair at the threshold itself
meets with probability ``recall``, so the loop ends there at the latest.

A node of more than ``node_limit`` classes is not compared. Its classes meet in another way, which
misses none: of the shingles of each, rarest first, it lists so many that two sets that are alike
enough must share one of them, and classes on one list meet. Lists longer than the limit are compared
in cells of bounded size, each pair in one cell. What most classes share comes last in that order, so a
list is long only where its classes have most of their shingles in common.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.session import cut

WORD = re.compile(r"[^\W_]+")
LABELS = 128  # MinHash values of a signature, also the bits of the sketch
_SEED = np.random.default_rng(20240229)
_A = _SEED.integers(1, 2**63, LABELS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(0, 2**63, LABELS, dtype=np.uint64)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_WORDS_KEPT = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around by intention."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct hashes of runs of ``size`` successive words of the lower-cased text, sorted."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        n = len(words) - self.size + 1
        if n < 1:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > _WORDS_KEPT:
            known.clear()
        ids = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            ids.append(h)
        ids = np.array(ids, np.uint64)
        x = np.zeros(n, np.uint64)
        for k in range(self.size):
            x = mix(x * _M[0] + ids[k : k + n] + _M[1])
        return np.unique(x)


def signature(shingles: np.ndarray) -> np.ndarray:
    """``LABELS`` MinHash values of 32 bits; all-ones for an empty set."""
    if not len(shingles):
        return np.full(LABELS, 0xFFFFFFFF, np.uint32)
    out = np.full(LABELS, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 4096):  # long texts in bounded memory
        out = np.minimum(out, ((shingles[i : i + 4096, None] * _A + _B) >> np.uint64(32)).min(axis=0))
    return out.astype(np.uint32)


def trees_needed(threshold: float, depth: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def depth_for(threshold: float, recall: float) -> int:
    """The longest prefix for which the signature has labels enough for the recall."""
    return max(d for d in range(1, 9) if d == 1 or trees_needed(threshold, d, recall) * d <= LABELS)


def sketch(shingles: np.ndarray, sig: np.ndarray) -> tuple[bytes, int, int, bytes]:
    """Class id (128-bit hash of the whole set), two words of one bit per label, the signature's bytes."""
    words = np.packbits((sig & 1).astype(np.uint8)).view(">i8")
    return xxhash.xxh128_digest(shingles.tobytes()), int(words[0]), int(words[1]), sig.tobytes()


FURTHER = 4  # labels of a tree beyond its floor


def tree_labels(trees: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in the signature of each tree's first labels, disjoint over the trees, and of its further ones."""
    rng = np.random.default_rng(7)
    first = rng.permutation(LABELS)[: trees * floor].reshape(trees, floor)
    return first, np.array([rng.permutation(np.setdiff1d(np.arange(LABELS), row))[:FURTHER] for row in first])


_ROWS = "node long, further long, set_id binary, n int, s1 long, s2 long"


def _forest(sets: DataFrame, trees: int, floor: int) -> DataFrame:
    """Each class once per tree: under the node of its first labels, with its further ones (16 bits each, the first one highest)."""
    first, more = tree_labels(trees, floor)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.iloc[i : i + 1000]
                labels = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(len(part), LABELS).astype(np.uint64)
                node = np.broadcast_to(np.arange(trees, dtype=np.uint64), (len(part), trees))
                for k in range(floor):
                    node = mix(node * _M[0] + labels[:, first[:, k]] + _M[2])
                further = np.zeros_like(node)
                for k in range(FURTHER):
                    further = (further << np.uint64(16)) | (labels[:, more[:, k]] & np.uint64(0xFFFF))
                rows = part.loc[part.index.repeat(trees), ["set_id", "n", "s1", "s2"]]
                yield rows.assign(node=node.ravel().view(np.int64), further=further.ravel().view(np.int64))[["node", "further", "set_id", "n", "s1", "s2"]]

    return sets.select("set_id", "n", "s1", "s2", "sig").mapInPandas(run, _ROWS)


def least_equal_bits(threshold: float) -> int:
    """Sketch bits a pair at the threshold has equal, less four standard deviations: one pair in 30,000 has fewer."""
    p = (1 + threshold) / 2
    return math.floor(LABELS * p - 4 * math.sqrt(LABELS * p * (1 - p)))


def _shared_nodes(rows: DataFrame) -> DataFrame:
    """The rows in nodes of two or more, with the node's size. One sort by labels, as in a trie; most rows end here."""
    sized = rows.withColumn("size", F.count("*").over(Window.partitionBy("node")))
    return cut(sized.filter("size > 1"))


def _meet(rows: DataFrame, threshold: float, once: Column | None = None) -> DataFrame:
    """Likely pairs ``(set_id_a, set_id_b, shared)`` of classes that share a node; ``shared`` counts the further labels they share."""
    columns = [c for c in ("set_id", "n", "s1", "s2", "further", "own", "diagonal") if c in rows.columns]
    a, b = (rows.select(F.col("node").alias(f"node_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in "ab")
    unequal = F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b"))) + F.bit_count(F.col("s2_a").bitwiseXOR(F.col("s2_b")))
    size = (F.col("n_a") >= F.col("n_b") * threshold - 1e-6) & (F.col("n_b") >= F.col("n_a") * threshold - 1e-6)
    on = (F.col("node_a") == F.col("node_b")) & (F.col("set_id_a") < F.col("set_id_b")) & size & (unequal <= LABELS - least_equal_bits(threshold))
    met = a.join(b, on if once is None else on & once)
    apart = F.col("further_a").bitwiseXOR(F.col("further_b")) if "further" in columns else F.lit(0).cast("long")
    shared = sum((F.when(F.shiftrightunsigned(apart, 16 * k) == 0, 1).otherwise(0) for k in range(FURTHER)), F.lit(0))
    return met.select("set_id_a", "set_id_b", shared.alias("shared"))


def _in_cells(lists: DataFrame, limit: int) -> DataFrame:
    """Rows of long lists under cells, one for each pair of the list's blocks, so that no task gets a whole list."""
    n = F.ceil(F.col("size") / limit).cast("int")
    rows = lists.withColumn("own", F.pmod(F.xxhash64("set_id"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    cell = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(cell.alias("node"), "set_id", "n", "s1", "s2", "own", (F.col("own") == F.col("other")).alias("diagonal"))


def likeness_at_least(common: Column, n_a: Column, n_b: Column, threshold: float) -> Column:
    return common >= threshold * (n_a + n_b - common) - 1e-9


def classes(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(id, set_id, n, s1, s2, sig)``: the class of every document with at least ``shingle`` words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(shingle)
        for b in batches:
            out = []
            for i, text in zip(b["id"], b["text"]):
                s = shingles(text)
                if len(s):
                    out.append((i, len(s), *sketch(s, signature(s))))
            yield pd.DataFrame(out, columns=["id", "n", "set_id", "s1", "s2", "sig"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, n int, set_id binary, s1 long, s2 long, sig binary")


class Search(NamedTuple):
    """``pairs(set_id_a, set_id_b, likeness)``, ``members(id, set_id)``, the shortest prefix that was tried, the trees, and the estimated recall."""

    pairs: DataFrame
    members: DataFrame
    depth: int
    trees: int
    recall: float


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, recall: float = 0.999, target: float = 0.9999, node_limit: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes whose likeness reaches the threshold, and the classes' members; see ``search``."""
    found = search(docs, id_col, text_col, shingle, threshold, recall, target, node_limit)
    return found.pairs, found.members


def search(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, recall: float = 0.999, target: float = 0.9999, node_limit: int = 2000) -> Search:
    """Pairs of classes whose likeness reaches the threshold, and the classes' members.

    ``pairs(set_id_a, set_id_b, likeness)`` with a < b holds each pair of different classes once;
    ``members(id, set_id)`` holds each document that has a class. Documents of one class have the
    same shingles, likeness 1, and are not paired. Null and empty texts, and texts of fewer than
    ``shingle`` words, have no shingles and no class. Rows repeated with the same id and text count
    once; a null id is kept as an id. Other columns are ignored. No pair below the threshold is returned.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    every = cut(classes(base, "id", "text", shingle))
    members = every.select("id", "set_id").distinct()
    sets = every.groupBy("set_id").agg(*[F.first(c).alias(c) for c in ("n", "s1", "s2", "sig")], F.min("id").alias("id"))

    floor = depth_for(threshold, recall)
    trees = trees_needed(threshold, floor, recall)
    shared = _shared_nodes(_forest(sets, trees, floor))
    met = _meet(shared.filter(F.col("size") <= node_limit), threshold)
    crowded = shared.filter(F.col("size") > node_limit).select("set_id").distinct()
    if not crowded.isEmpty():
        rare = _rare_lists(_shingles_of(crowded, sets, base, shingle), crowded.join(every.groupBy("set_id").agg(*[F.first(c).alias(c) for c in ("n", "s1", "s2")]), "set_id"), threshold)
        lists = _shared_nodes(rare)
        short = _meet(lists.filter(F.col("size") <= node_limit), threshold)
        once = F.when(F.col("diagonal_a"), F.col("own_a") == F.col("own_b")).otherwise(F.col("own_a") != F.col("own_b"))
        long = _meet(_in_cells(lists.filter(F.col("size") > node_limit), node_limit), threshold, once)
        met = met.unionByName(short).unionByName(long)
    met = cut(met.groupBy("set_id_a", "set_id_b").agg(F.max("shared").alias("shared")))
    ends = met.select(F.explode(F.array("set_id_a", "set_id_b")).alias("set_id")).distinct()
    full = cut(_shingles_of(ends, sets, base, shingle))

    found, depth, reached = None, floor + FURTHER, 1.0
    for further in range(FURTHER, -1, -1):
        depth = floor + further
        here = cut(_verified(met.filter(F.col("shared") == further), full, threshold))
        found = here if found is None else found.unionByName(here)
        chance = 1 - F.pow(1 - F.pow(F.col("likeness"), F.lit(depth)), F.lit(trees))
        sums = found.agg(F.count("*").alias("n"), F.sum(1 / chance).alias("of")).first()
        reached = sums.n / sums.of if sums.n else 1.0
        if sums.n and reached >= target:
            break
    return Search(found, members, depth, trees, reached)


def _shingles_of(wanted: DataFrame, sets: DataFrame, base: DataFrame, shingle: int) -> DataFrame:
    """``(set_id, shingles)`` of the wanted classes, from the whole text of one document of each."""
    texts = wanted.join(sets.select("set_id", "id"), "set_id").join(base, base["id"].eqNullSafe(sets["id"])).select("set_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(shingle)
        for b in batches:
            found = [shingles(t) for t in b["text"]]
            keep = [xxhash.xxh128_digest(s.tobytes()) == i for s, i in zip(found, b["set_id"])]
            yield pd.DataFrame({"set_id": [i for i, k in zip(b["set_id"], keep) if k], "shingles": [s.view(np.int64) for s, k in zip(found, keep) if k]})

    return texts.mapInPandas(run, "set_id binary, shingles array<long>").groupBy("set_id").agg(F.first("shingles").alias("shingles"))


#: Shingles are ranked by how often those with the same hash to so many buckets occur: any fixed order
#: is right, and the table has this size whatever the corpus.
BUCKETS = 1 << 18


def _rare_lists(full: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """``(node, set_id, n, s1, s2)``: each class under its rarest shingles, so many that sets alike enough share one."""
    full = cut(full)
    bucket = F.pmod(F.col("x"), F.lit(BUCKETS)).cast("int").alias("bucket")
    counts = full.select(F.explode("shingles").alias("x")).groupBy(bucket).count().collect()  # BUCKETS rows at most
    table = np.zeros(BUCKETS, np.int64)
    for r in counts:
        table[r["bucket"]] = r["count"]
    table = full.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 100):
                part = b.iloc[i : i + 100]
                rare = []
                for s in part["shingles"]:
                    s = np.asarray(s, np.int64)
                    most = len(s) - math.ceil(threshold * len(s) - 1e-6) + 1
                    rare.append(s[np.lexsort((s, table.value[s % BUCKETS]))[:most]])
                rows = part.loc[part.index.repeat([len(r) for r in rare]), ["set_id", "n", "s1", "s2"]]
                yield rows.assign(node=np.concatenate(rare) if rare else [])[["node", "set_id", "n", "s1", "s2"]]

    return full.join(sketches, "set_id").mapInPandas(run, "node long, set_id binary, n int, s1 long, s2 long")


def _verified(pairs: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose shingle sets reach the threshold, with their likeness."""
    a, b = (full.select(F.col("set_id").alias(f"set_id_{x}"), F.col("shingles").alias(f"shingles_{x}")) for x in "ab")
    both = pairs.join(a, "set_id_a").join(b, "set_id_b")
    n_a, n_b, common = F.size("shingles_a"), F.size("shingles_b"), F.size(F.array_intersect("shingles_a", "shingles_b"))
    both = both.select("set_id_a", "set_id_b", n_a.alias("n_a"), n_b.alias("n_b"), common.alias("common"))
    both = both.filter(likeness_at_least(F.col("common"), F.col("n_a"), F.col("n_b"), threshold))
    return both.select("set_id_a", "set_id_b", (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("likeness"))


def document_pairs(pairs: DataFrame, members: DataFrame, docs: DataFrame, id_col: str, group_col: str) -> DataFrame:
    """``(id_a, id_b)``, a < b: the documents of different groups that are linked, copies expanded.

    A document with a null group is in no known group and is linked to none.
    """
    own = members.join(docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group")).filter("group is not null").distinct(), "id")
    same = members.groupBy("set_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("set_id").alias("set_id_a"), F.col("set_id").alias("set_id_b"))
    links = pairs.select("set_id_a", "set_id_b").union(same)
    a, b = (own.select(F.col("set_id").alias(f"set_id_{x}"), F.col("id").alias(f"id_{x}"), F.col("group").alias(f"group_{x}")) for x in "ab")
    out = links.join(a, "set_id_a").join(b, "set_id_b").filter("group_a <> group_b and id_a <> id_b")
    return out.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, class_id, n_copies, n_links)``: one row per document that has shingles.

    ``class_id`` names the connected group of the document's class: the least document id in it.
    ``n_copies`` counts the documents with the same shingles, ``n_links`` the other classes its class
    is linked to. Groups form by the alternation of large-star and small-star steps, which halves
    the depth of every group and never gathers one, until nothing changes; lineage is cut in every round.
    """
    ids = members.groupBy("set_id").agg(F.min("id").alias("v"), F.count("*").alias("n_copies"))
    a, b = (ids.select(F.col("set_id").alias(f"set_id_{x}"), F.col("v").alias(x)) for x in "ab")
    links = pairs.select("set_id_a", "set_id_b").join(a, "set_id_a").join(b, "set_id_b").select("a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("n_links"))
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).filter("u <> v").distinct()
        small = cut(small)
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            break
        edges = small
    root = edges.groupBy("u").agg(F.min("v").alias("root"))
    classes_ = ids.join(root, ids["v"] == root["u"], "left").join(degree, "v", "left")
    classes_ = classes_.select("set_id", F.coalesce("root", "v").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(classes_, "set_id").select("id", "class_id", "n_copies", "n_links")

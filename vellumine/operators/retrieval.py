"""Exact vector search, late interaction, reranking, and what is shown of the hits.

Vectors are scored block against block: both sides are packed into blocks of bounded size, a block
pair is one matrix product, and only a pair's own top k leave it. Nothing is broadcast and no
pair of single vectors is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.binding import let

BLOCK = 2048
METRICS = ("ip", "l2")


def _blocks(df: DataFrame, id_col: str, vector_col: str, prefix: str) -> DataFrame:
    n = max(1, -(-df.count() // BLOCK))
    keyed = df.select(F.pmod(F.xxhash64(id_col), F.lit(n)).alias("_b"), F.struct(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).alias("x"))
    return keyed.groupBy("_b").agg(F.collect_list("x").alias(prefix)).drop("_b")


def topk(
    queries: DataFrame, corpus: DataFrame, k: int, metric: str = "ip", query_id: str = "query_id", item_id: str = "vec_id", vector: str = "embedding", skip_self: bool = False
) -> DataFrame:
    """``(query_id, item_id, score, rank)``: the exact k best items of each query, rank from 0.

    ``ip`` ranks by inner product, highest first, ``l2`` by squared distance, lowest first; ties
    (to 9 digits) go to the lower id. Null vectors are in no result.
    """
    if metric not in METRICS or k < 1:
        raise ValueError(f"metric is one of {METRICS}, k at least 1")
    best = "desc" if metric == "ip" else "asc"
    pairs = _blocks(queries.filter(F.col(vector).isNotNull()), query_id, vector, "q").crossJoin(_blocks(corpus.filter(F.col(vector).isNotNull()), item_id, vector, "c"))  # blocks, not rows
    qk, ck = queries.schema[query_id].dataType.simpleString(), corpus.schema[item_id].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q, c in zip(b["q"], b["c"]):
                qi, ci = [x["id"] for x in q], np.array([x["id"] for x in c])
                qv, cv = np.array([x["v"] for x in q]), np.array([x["v"] for x in c])
                s = qv @ cv.T
                if metric == "l2":
                    s = (qv**2).sum(1)[:, None] + (cv**2).sum(1)[None, :] - 2 * s
                s = np.round(s, 9)
                out = []
                for i, row in enumerate(s):
                    order = np.lexsort((ci, -row if metric == "ip" else row))
                    if skip_self:
                        order = order[ci[order] != qi[i]]
                    out += [(qi[i], ci[j], row[j]) for j in order[:k]]
                yield pd.DataFrame(out, columns=[query_id, item_id, "score"])

    hits = pairs.mapInPandas(score, f"{query_id} {qk}, {item_id} {ck}, score double")
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc() if best == "desc" else F.col("score"), item_id)
    return hits.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)


# Fixed value: how many candidates are ranked again.
CANDIDATES = 75


def two_stage(queries: DataFrame, corpus: DataFrame, k: int, scorer: Callable[[DataFrame], Column], rerank: bool = True, **topk_args) -> DataFrame:
    """The top of 75 candidates, ranked again by a scorer's column (higher is better). More than 75 are never returned."""
    if not rerank:
        return topk(queries, corpus, min(k, CANDIDATES), **topk_args)
    first = topk(queries, corpus, CANDIDATES, **topk_args)
    scored = first.withColumn("score", scorer(first)).drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)


def maxsim(query_tokens: DataFrame, item_tokens: DataFrame, k: int) -> DataFrame:
    """Late interaction: for each query the items with the highest sum, over the query's tokens, of the
    best inner product with any of the item's tokens. ``query_tokens(query_id, tok, v)``, ``item_tokens(vec_id, tok, v)``;
    each side comes packed, one row with a token matrix per query and item."""
    q = query_tokens.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("tok", "v"))).alias("x"))
    d = item_tokens.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("tok", "v"))).alias("x"))
    nq, nd = max(1, -(-q.count() // 256)), max(1, -(-d.count() // BLOCK))
    q = q.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(nq))).agg(F.collect_list(F.struct(F.col("query_id").alias("id"), "x")).alias("q")).select("q")
    d = d.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(nd))).agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), "x")).alias("c")).select("c")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qs, cs in zip(b["q"], b["c"]):
                ci = np.array([c["id"] for c in cs])
                tokens = np.concatenate([[t["v"] for t in c["x"]] for c in cs])
                starts = np.cumsum([0] + [len(c["x"]) for c in cs[:-1]])
                for one in qs:
                    s = np.array([t["v"] for t in one["x"]]) @ tokens.T
                    total = np.round(np.maximum.reduceat(s, starts, axis=1).sum(0), 9)
                    top = np.lexsort((ci, -total))[:k]
                    yield pd.DataFrame({"query_id": one["id"], "vec_id": ci[top], "score": total[top]})

    hits = q.crossJoin(d).mapInPandas(score, "query_id long, vec_id long, score double")  # blocks, not rows
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)


def l2_normalise(v: Column) -> Column:
    """A vector of length 1; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return let(F.when(norm == 0, 1.0).otherwise(norm), lambda n: F.transform(v, lambda x: x / n))


def first_per_group(hits: DataFrame, group: str, by: str = "query_id") -> DataFrame:
    """Of each query's hits the best of every group."""
    w = Window.partitionBy(by, group).orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def prompt_block(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """``(query_id, prompt)``: a query's sources, numbered from 1; the hits are top k lists, so k bounds a group.

    ``hits(query_id, rank, paper_title, section_hierarchy, score, text)``.
    """
    # fixed values: the layout of a source in a prompt
    one = F.concat(
        F.lit("\n### Source "), (F.col("rank") + 1).cast("string"), F.lit(": "), F.substring_index("paper_title", "\n", 1), F.lit("\n**Section**: "), F.array_join("section_hierarchy", " > "),
        F.lit("\n**Relevance Score**: "), F.format_string("%.2f%%", F.col("score") * 100), F.lit("\n\n"), F.col("text"), F.lit("\n"),
    )
    gathered = hits.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", one.alias("block")))).alias("b"))
    return gathered.select(by, F.array_join(F.transform("b", lambda x: x["block"]), "\n---\n").alias("prompt"))


def citation_card(title: Column, text: Column) -> tuple[Column, Column]:
    return F.left(F.substring_index(title, "\n", 1), F.lit(100)), F.concat(F.left(text, F.lit(150)), F.lit("..."))


def neighbours(chunks: DataFrame, hits: DataFrame, window: int = 1) -> DataFrame:
    """The hits' chunks and those up to ``window`` places before and after, in the same paper and of the same type.

    The places are spelled out on the hits' side, so the join is an equi-join."""
    around = hits.select("hit_id", "paper_id", "chunk_type", F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index"))
    return around.join(chunks, ["paper_id", "chunk_type", "chunk_index"])


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A model-free stand-in for an encoder: signed word hashes summed into a unit vector."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        import xxhash

        def one(t: str | None) -> list[float] | None:
            if t is None:
                return None
            v = np.zeros(dims)
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                v[h % dims] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            return (v / (n or 1)).tolist()

        return texts.map(one)

    return embed(text)

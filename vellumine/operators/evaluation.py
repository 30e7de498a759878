"""Ranking metrics, gold resolution and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def ranking_metrics(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """``(query_id, n_gold, precision_k, recall_k, hit_k, ndcg_k for each k, mrr)``, one row per query of ``gold``.

    ``hits(query_id, item, rank)`` with ranks from 0, ``gold(query_id, item)``; a null gold item stands
    for a query without any, whose metrics are all null. Precision divides by the hits returned and
    counts repeated items; recall and nDCG count an item once, at its first rank.
    """
    g = gold.filter("item is not null").select("query_id", "item").distinct()
    n_gold = gold.groupBy("query_id").agg(F.countDistinct("item").alias("n_gold"))
    seen = hits.join(g.withColumn("_g", F.lit(True)), ["query_id", "item"], "left").withColumn("is_gold", F.coalesce("_g", F.lit(False)))
    seen = seen.withColumn("first", F.row_number().over(Window.partitionBy("query_id", "item").orderBy("rank")) == 1)
    aggs = []
    for k in ks:
        inside = F.col("rank") < k
        gain = F.when(inside & F.col("is_gold") & F.col("first"), 1.0 / F.log2(F.col("rank") + 2.0)).otherwise(0.0)
        aggs += [
            F.avg(F.when(inside, F.col("is_gold").cast("double"))).alias(f"precision_{k}"),
            F.countDistinct(F.when(inside & F.col("is_gold"), F.col("item"))).alias(f"_found_{k}"),
            F.max(F.when(inside, F.col("is_gold").cast("double"))).alias(f"hit_{k}"),
            F.sum(gain).alias(f"_dcg_{k}"),
        ]
    aggs.append(F.coalesce(1.0 / F.min(F.when(F.col("is_gold"), F.col("rank") + 1)), F.lit(0.0)).alias("mrr"))
    per = n_gold.join(seen.groupBy("query_id").agg(*aggs), "query_id", "left")
    known = F.col("n_gold") > 0
    out = [F.col("query_id"), F.col("n_gold")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest("n_gold", F.lit(1)), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
        zero = lambda c: F.when(known, F.coalesce(c, F.lit(0.0)))
        out += [
            zero(F.col(f"precision_{k}")).alias(f"precision_{k}"),
            zero(F.col(f"_found_{k}") / F.col("n_gold")).alias(f"recall_{k}"),
            zero(F.col(f"hit_{k}")).alias(f"hit_{k}"),
            zero(F.col(f"_dcg_{k}") / ideal).alias(f"ndcg_{k}"),
        ]
    return per.select(*out, F.when(known, F.coalesce("mrr", F.lit(0.0))).alias("mrr"))


def macro_average(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over the queries that have gold, and their number."""
    names = [c for c in per_query.columns if c.split("_")[0] in ("precision", "recall", "hit", "ndcg", "mrr")]
    return per_query.groupBy(*(by or [])).agg(F.count("mrr").alias("n"), *[F.avg(c).alias(c) for c in names])


def summary_row(results: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Per configuration ``n``, the hit rate at each k, precision and recall at the last, and MRR, with three decimals; null as an em dash."""
    shown = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.3f", c)), F.lit("—")).alias(c)
    return results.select("config", "n", *[shown(f"hit_{k}") for k in ks], shown(f"precision_{ks[-1]}"), shown(f"recall_{ks[-1]}"), shown("mrr"))


def evaluable(annotator: Column, difficulty: Column) -> Column:
    return ~annotator.eqNullSafe(F.lit("adversarial")) & ~difficulty.eqNullSafe(F.lit("unanswerable"))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two half-open intervals share a place."""
    return (a_start < b_end) & (b_start < a_end)


def resolve_spans(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(pair_id, chunk_type, chunk_id)``: the chunks that overlap a gold span of their paper. A null offset of a chunk counts as 0."""
    c = chunks.select("paper_id", "chunk_type", "chunk_id", F.coalesce("char_start", F.lit(0)).alias("c0"), F.coalesce("char_end", F.lit(0)).alias("c1"))
    # a paper may hold a third of the chunks: they are spread under salts, and the few spans repeated for each
    c = c.withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int"))
    spans = spans.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = overlap(F.col("c0"), F.col("c1"), F.col("char_start"), F.col("char_end"))
    return spans.join(c, ["paper_id", "_salt"]).filter(hit).select("pair_id", "chunk_type", "chunk_id").distinct()


def bootstrap_ci(df: DataFrame, value: str, n_boot: int = 1000, ci: float = 95.0, seed: int = 0) -> DataFrame:
    """``(mean, low, high)``: the mean and its percentile interval over resamples.

    Poisson bootstrap: each row's weight in a resample comes from a hash, so rows are never gathered
    and a resample is one group of a map-side aggregate.
    """
    rows = df.select(F.col(value).alias("v"), F.monotonically_increasing_id().alias("i")).filter("v is not null")
    boots = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    u = F.shiftrightunsigned(F.xxhash64("i", "b", F.lit(seed)), 11) / F.lit(float(1 << 53))
    weight, term, total = F.lit(0), 0.36787944117144233, 0.0
    for k in range(1, 9):
        total += term
        weight = F.when(u >= total, k).otherwise(weight) if k == 1 else F.when(u >= total, F.lit(k)).otherwise(weight)
        term /= k
    means = boots.withColumn("w", weight).groupBy("b").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"))
    tail = (100 - ci) / 200
    over = means.agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("p"))
    return rows.agg(F.avg("v").alias("mean")).crossJoin(over).select("mean", F.get("p", 0).alias("low"), F.get("p", 1).alias("high"))  # one row each

"""How good a chunking is: sizes, citations, coherence, boundaries, and one score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import citation_count, token_estimate
from vellumine.operators.retrieval import l2_normalise


def chunk_statistics(chunks: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Size statistics with an interpolated median and the population's deviation; zeros where there is nothing."""
    n, t = F.length(text), token_estimate(text)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return chunks.groupBy(*by).agg(
        F.count("*").alias("n_chunks"), zero(F.avg(n)).alias("mean_chars"), zero(F.median(n)).alias("median_chars"), zero(F.stddev_pop(n)).alias("std_chars"),
        F.coalesce(F.min(n), F.lit(0)).alias("min_chars"), F.coalesce(F.max(n), F.lit(0)).alias("max_chars"), zero(F.avg(t)).alias("mean_tokens"), zero(F.median(t)).alias("median_tokens"),
    )


def upper_median(chunks: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """The element in the middle of the sorted lengths, the upper one of two, from counts per length."""
    sizes = chunks.groupBy(*by, F.length(text).alias("len")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    place = sizes.withColumn("below", F.coalesce(F.sum("c").over(w.orderBy("len").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("c").over(w))
    mid = F.floor(F.col("n") / 2)
    return place.filter((F.col("below") <= mid) & (mid < F.col("below") + F.col("c"))).select(*by, F.col("n").alias("n_chunks"), F.col("len").alias("median_chars"))


def citation_integrity(chunks: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    rows = chunks.select(*by, citation_count(text).alias("n"), F.length(text).alias("len"))
    return rows.groupBy(*by).agg(
        F.sum("n").alias("total_citations"), F.count_if(F.col("n") > 0).alias("chunks_with_citations"), (F.count_if(F.col("n") > 0) / F.count("*")).alias("citation_coverage"),
        F.coalesce(F.avg(F.when(F.col("n") > 0, F.col("n") / F.col("len") * 1000)), F.lit(0.0)).alias("mean_citation_density"), F.count("*").alias("total_chunks"),
    )


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return dot / (norm(a) * norm(b))


def coherence(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """``(by, coherence)``: the mean cosine of a group's different vectors, 1 for fewer than two.

    The sum over all ordered pairs is the squared length of the sum of the unit vectors, so no pairs
    are formed: per group and dimension one sum, whatever the group's size.
    """
    unit = vectors.select(by, l2_normalise(F.col(vector).cast("array<double>")).alias("u"))
    per_dim = unit.select(by, F.posexplode("u").alias("d", "x")).groupBy(by, "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("own"), F.count("*").alias("n"))
    total = per_dim.groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("own").alias("own"), F.max("n").alias("n"))
    return total.select(by, F.when(F.col("n") < 2, 1.0).otherwise((F.col("all") - F.col("own")) / (F.col("n") * (F.col("n") - 1))).alias("coherence"))


def min_max(df: DataFrame, columns: list[str], inverted: tuple[str, ...] = ()) -> DataFrame:
    """Each column scaled to 0..1 over all rows, the inverted ones from the other side; a constant column stays."""
    every = Window.partitionBy()  # one row per strategy
    out = []
    for c in columns:
        lo, hi = F.min(c).over(every), F.max(c).over(every)
        x = (F.col(c) - lo) / (hi - lo)
        out.append(F.when(hi == lo, F.col(c).cast("double")).otherwise(1 - x if c in inverted else x).alias(c))
    return df.select(*[c for c in df.columns if c not in columns], *out)


def normalise_score(x: Column, lo: Column, hi: Column, invert: bool = False) -> Column:
    n = (x - lo) / F.nullif(hi - lo, F.lit(0.0))
    n = 1 - n if invert else n
    return F.when(hi == lo, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)))


def strategy_score(coherence: Column, boundary: Column, coverage: Column, std: Column, mean: Column) -> Column:
    """Points for coherence (15), clean boundaries (20), citations (20), even sizes (25) and a mean size in the useful range (20)."""
    # fixed values: the weights and the bounds of the ranges
    spread = F.when(std > 2000, 0.0).when(std > 1000, (2000 - std) / 1000 * 25).otherwise(25 - std / 1000 * 5)
    size = F.when(mean.between(1800, 2500), 20).when(mean.between(1500, 3000), 15).when(mean.between(1000, 4000), 10).otherwise(0)
    return F.coalesce(coherence * 15, F.lit(0.0)) + F.coalesce((1 - boundary) * 20, F.lit(0.0)) + F.coalesce(coverage, F.lit(0.0)) * 20 + spread + size

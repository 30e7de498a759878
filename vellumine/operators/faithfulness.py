"""Whether claims are backed by what they cite, and retrieval that is corrected when it is poor."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def containment(claim: Column, passage: Column) -> Column:
    """The share of a claim's different words found in a passage: a lexical stand-in for an entailment model."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(claim), words(passage))) / F.greatest(F.size(words(claim)), F.lit(1))


def verify(claims: DataFrame, sources: DataFrame, verifier: Callable[[Column, Column], Column] = containment, least: float = 0.5) -> DataFrame:
    """``claims`` with ``label``: no_citation, fabricated_source, not_supported or supported.

    ``claims(.., claim, cited_source_id)``, ``sources(source_id, passage)``; a source without a passage supports nothing.
    """
    known = sources.select(F.col("source_id").alias("_s"), "passage").withColumn("_known", F.lit(True))
    both = claims.join(known, F.col("cited_source_id") == F.col("_s"), "left")
    score = verifier(F.col("claim"), F.col("passage"))
    label = (
        F.when(F.col("cited_source_id").isNull(), "no_citation").when(F.col("_known").isNull(), "fabricated_source").when(F.col("passage").isNull(), "not_supported").when(score > least, "supported").otherwise("not_supported")
    )
    return both.withColumn("label", label).drop("_s", "_known", "passage")


LABELS = ("supported", "not_supported", "no_citation", "fabricated_source")


def ratios(verified: DataFrame, by: list[str]) -> DataFrame:
    share = lambda x: (F.count_if(F.col("label") == x) / F.count("*")).alias(f"{x}_ratio")
    return verified.groupBy(*by).agg(F.count("*").alias("total_claims"), *[share(x) for x in LABELS])


def corrective(
    queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], judge: Column, refine: Callable[[DataFrame], DataFrame], correct: float, ambiguous: float, max_retries: int = 2
) -> DataFrame:
    """``(query_id, quality, confidence, rounds)``: ambiguous queries are refined and retrieved again, at most ``max_retries`` times.

    ``retrieve`` adds a query's documents as columns, ``judge`` is its confidence, ``refine`` rewrites the
    query. The rounds are unrolled into one plan; a query leaves at its last round or when it is not ambiguous.
    """
    done, todo = [], queries
    for attempt in range(max_retries + 1):
        got = retrieve(todo).withColumn("confidence", judge)
        quality = F.when(F.col("confidence") >= correct, "correct").when(F.col("confidence") >= ambiguous, "ambiguous").otherwise("incorrect")
        got = got.withColumn("quality", quality).withColumn("rounds", F.lit(attempt + 1))
        last = attempt == max_retries
        done.append((got if last else got.filter("quality <> 'ambiguous'")).select("query_id", "quality", "confidence", "rounds"))
        if not last:
            todo = refine(got.filter("quality = 'ambiguous'"))
    return reduce(DataFrame.union, done)

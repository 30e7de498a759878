"""Validation, aggregation and agreement of gold pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabulary and the id formats of gold pairs.
DIFFICULTIES = ("single-hop", "multi-hop", "unanswerable")
CATEGORIES = ("policy_impact", "methodology", "comparison", "factual", "multi_hop")
STATUSES = ("pending", "approved", "rejected")
PAIR_ID, CLAIM_ID, PAPER_ID = r"^q[0-9]{3,}$", r"^c[0-9]{3,}$", r"^[0-9]{5}_[A-Za-z0-9]+$"


def _rule(failed: Column, message: Column | str) -> Column:
    return F.when(failed, F.lit(message) if isinstance(message, str) else message)


def pair_errors(pairs: DataFrame) -> DataFrame:
    """``(id, message)`` of every rule a pair breaks: one expression per rule, no pass per rule."""
    outside = lambda c, values: F.coalesce(~F.col(c).isin(*values), F.lit(True))
    claim_ids = F.transform("claims", lambda c: c["id"])
    n_claims = F.coalesce(F.size("claims"), F.lit(0))
    rules = [
        _rule(~F.coalesce(F.col("id").rlike(PAIR_ID), F.lit(False)), "id does not match"),
        _rule(F.coalesce(F.length("question"), F.lit(0)) < 1, "question is empty"),
        _rule(F.coalesce(F.length("gold_answer"), F.lit(0)) < 1, "gold_answer is empty"),
        _rule(outside("difficulty", DIFFICULTIES), "difficulty is unknown"),
        _rule(outside("category", CATEGORIES), "category is unknown"),
        _rule(outside("review_status", STATUSES), "review_status is unknown"),
        _rule(F.exists("claims", lambda c: ~F.coalesce(c["id"].rlike(CLAIM_ID), F.lit(False))), "claim id does not match"),
        _rule(F.size(F.array_distinct(claim_ids)) < F.size(claim_ids), "duplicate claim id"),
        _rule((F.col("difficulty") == "unanswerable") & (n_claims > 0), "unanswerable pair must have no claims"),
        _rule(F.col("difficulty").isin("single-hop", "multi-hop") & (n_claims == 0), "answerable pair must have a claim"),
        _rule(F.exists("claims", lambda c: F.exists(c["supporting_spans"], lambda s: s["char_end"] <= s["char_start"])), "char_end must be > char_start"),
        _rule(F.exists("claims", lambda c: F.exists(c["supporting_spans"], lambda s: s["char_start"] < 0)), "char_start must be >= 0"),
        _rule(F.exists("claims", lambda c: F.exists(c["supporting_spans"], lambda s: ~F.coalesce(s["paper_id"].rlike(PAPER_ID), F.lit(False)))), "paper_id does not match"),
    ]
    return pairs.select("id", F.explode(F.array_compact(F.array(*rules))).alias("message"))


def spans(pairs: DataFrame) -> DataFrame:
    s = pairs.select("id", F.explode("claims").alias("c")).select("id", F.col("c.id").alias("claim_id"), F.explode("c.supporting_spans").alias("s"))
    return s.select("id", "claim_id", "s.*")


def span_errors(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """``(id, claim_id, paper_id, char_start, message)``: spans whose document is missing, too short or says something else."""
    docs = documents.filter("paper_id is not null").select("paper_id", F.regexp_replace("text", r"\r\n?", "\n").alias("md"))
    checked = spans(pairs).filter("paper_id is not null and char_start is not null and char_end is not null and quote is not null").distinct().join(docs, "paper_id", "left")
    actual = F.col("md").substr(F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    message = F.when(F.col("md").isNull(), "document not found").when(F.col("char_end") > F.length("md"), "span out of bounds").when(actual != F.col("quote"), "quote mismatch")
    return checked.select("id", "claim_id", "paper_id", "char_start", message.alias("message")).filter("message is not null")


def label_pairs(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """``(annotator_label, reviewer_label)`` of the claims of the agreement subset that both labelled usably."""
    tidy = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    both = pairs.filter("iaa_subset").select(F.explode("claims").alias("c")).select(tidy(F.col("c.annotator_label")).alias("annotator_label"), tidy(F.col("c.reviewer_label")).alias("reviewer_label"))
    return both.filter(F.col("annotator_label").isin(*labels) & F.col("reviewer_label").isin(*labels))


def cohens_kappa(both: DataFrame) -> DataFrame:
    """One row ``(n, observed, expected, kappa)``; kappa is 1 where chance agreement is, null without labels."""
    table = both.groupBy("annotator_label", "reviewer_label").agg(F.count("*").alias("c"))
    total = table.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("annotator_label") == F.col("reviewer_label"), F.col("c")).otherwise(0)).alias("same"))
    side = lambda c, o: table.groupBy(F.col(c).alias("label")).agg(F.sum("c").alias(o))
    chance = side("annotator_label", "a").join(side("reviewer_label", "r"), "label").agg(F.coalesce(F.sum(F.col("a") * F.col("r")), F.lit(0)).alias("ar"))
    one = total.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("ar") / (F.col("n") * F.col("n"))
    return one.select("n", po.alias("observed"), pe.alias("expected"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def gate(kappa: DataFrame, target: float, strict: bool = False) -> DataFrame:
    """One row ``(n, kappa, verdict, exit_code)`` of one of ``cohens_kappa``: ``undefined`` without labels,
    ``pass`` from the target on, else ``below target``, which alone is an error and only if strict."""
    n = F.coalesce("n", F.lit(0))
    verdict = F.when(n == 0, "undefined").when(F.col("kappa") >= target, "pass").otherwise("below target")
    return kappa.select(n.alias("n"), "kappa", verdict.alias("verdict"), F.when(F.lit(strict) & (verdict == "below target"), 1).otherwise(0).alias("exit_code"))

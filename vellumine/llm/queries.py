"""Queries of the training-data operators (problems 2, 3, 4 and 6 to 9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.llm.consensus import agreement, consensus, latest_votes
from vellumine.llm.mixing import mix, shares_reached
from vellumine.llm.neardup import document_pairs, groups, near_duplicates, search
from vellumine.llm.packing import pack, window_shares
from vellumine.llm.pii import find_personal, redact
from vellumine.llm.scans import find_noise, paper_paragraphs, scan_units
from vellumine.llm.splitting import split_oversized
from vellumine.llm.tokens import with_tokens
from vellumine.plans.registry import Registry
from vellumine.session import cut
from vellumine.sources.tables import spread, table

llm = Registry()


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").filter("chunk_type = 'coarse'").select("chunk_id", "paper_id", "text")


@llm.query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = _coarse(spark, sf_dir)
    pairs, members = near_duplicates(coarse, "chunk_id", "text", shingle=3, threshold=0.7)
    return document_pairs(pairs, members, coarse, "chunk_id", "paper_id").toDF("chunk_id_a", "chunk_id_b")


@llm.query("p3_recall")
def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far prefixes were shortened, and the recall that is estimated from the pairs found."""
    found = search(_coarse(spark, sf_dir), "chunk_id", "text", shingle=3, threshold=0.7)
    return found.pairs.agg(F.count("*").alias("n_pairs")).select("n_pairs", F.lit(found.trees).alias("trees"), F.lit(found.depth).alias("depth"), F.lit(found.recall).alias("estimated_recall"))


@llm.query("p3_groups")
def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per coarse chunk: its group, its copies and its links."""
    return groups(*near_duplicates(_coarse(spark, sf_dir), "chunk_id", "text", shingle=3, threshold=0.7)).withColumnRenamed("id", "chunk_id")


@llm.query("p3_documents")
def p3_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over documents, on five words and at 0.8."""
    return groups(*near_duplicates(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


LABELS = ["supports", "contradicts", "unrelated"]
NOT_RATERS = ("adversarial",)


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "gold_pairs").select(F.col("id").alias("pair_id"), "annotator", "reviewer", "submitted_at", F.explode("claims").alias("c"))
    by = lambda who: F.struct(F.col(who).alias("rater"), F.col(f"c.{who}_label").alias("label"))
    both = claims.select("pair_id", F.col("c.id").alias("claim_id"), "submitted_at", F.inline(F.array(by("annotator"), by("reviewer"))))
    return latest_votes(both, ["pair_id", "claim_id"], "rater", "label", "submitted_at", LABELS, NOT_RATERS)


_VOTES_SQL = r"""
WITH claims AS (SELECT id AS pair_id, annotator, reviewer, submitted_at, unnest(claims) AS c FROM gold_pairs),
both_raters AS (
  SELECT pair_id, c.id AS claim_id, submitted_at, annotator AS rater, c.annotator_label AS label FROM claims
  UNION ALL SELECT pair_id, c.id, submitted_at, reviewer, c.reviewer_label FROM claims),
tidy AS (
  SELECT pair_id, claim_id, submitted_at, lower(regexp_replace(rater, '^\s+|\s+$', '', 'g')) AS rater, lower(regexp_replace(label, '^\s+|\s+$', '', 'g')) AS label
  FROM both_raters),
votes AS (
  SELECT pair_id, claim_id, rater, label FROM tidy
  WHERE label IN ('supports', 'contradicts', 'unrelated') AND rater <> '' AND rater <> 'adversarial'
  QUALIFY row_number() OVER (PARTITION BY pair_id, claim_id, rater
    ORDER BY submitted_at DESC NULLS LAST, list_position(['supports', 'contradicts', 'unrelated'], label)) = 1)
"""


@llm.query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = consensus(_votes(spark, sf_dir), ["pair_id", "claim_id"], LABELS)
    return items.filter("n_raters >= 3").select("pair_id", "claim_id", "consensus_label")


@llm.query("p4_raters")
def p4_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(_votes(spark, sf_dir), ["pair_id", "claim_id"], LABELS)[1]


@llm.query("p4_votes", _VOTES_SQL + "SELECT pair_id, claim_id, rater, label FROM votes")
def p4_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir)


@llm.query(
    "p4_agreement",
    _VOTES_SQL
    + """,
per AS (SELECT pair_id, claim_id, label, count(*) AS n FROM votes GROUP BY ALL),
units AS (SELECT pair_id, claim_id, sum(n) AS m, sum(n * n) AS nn FROM per GROUP BY ALL HAVING sum(n) > 1),
marg AS (SELECT sum(n * n) AS sq FROM (SELECT label, sum(n) AS n FROM per SEMI JOIN units USING (pair_id, claim_id) GROUP BY label)),
tot AS (SELECT count(*) AS n_items, sum(m) AS n_votes, sum((m * m - nn) / (m - 1)) AS off FROM units),
both_sides AS (SELECT n_items, n_votes, 1 - off / n_votes AS observed, (sq - n_votes) / (n_votes * (n_votes - 1)) AS expected FROM tot, marg)
SELECT n_items, n_votes::BIGINT AS n_votes, round(observed, 9) AS observed, round(expected, 9) AS expected,
  round(CASE WHEN expected >= 1 THEN 1.0 ELSE 1 - (1 - observed) / (1 - expected) END, 9) AS alpha FROM both_sides""",
)
def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agreement(_votes(spark, sf_dir), ["pair_id", "claim_id"])
    return out.select("n_items", "n_votes", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "alpha")])


LIMITS = {"coarse": (2500, 250), "fine": (450, 50)}  # characters of a chunk, and of the overlap between pieces


def _pieces(chunks: DataFrame) -> DataFrame:
    pick = lambda i: F.when(F.col("chunk_type") == "coarse", LIMITS["coarse"][i]).when(F.col("chunk_type") == "fine", LIMITS["fine"][i])
    return split_oversized(chunks, pick(0), pick(1))


@llm.query(
    "p6_found",
    r"""
SELECT DISTINCT chunk_id FROM chunks
WHERE length(regexp_replace(text, '\r\n?', chr(10), 'g')) > CASE chunk_type WHEN 'coarse' THEN 2500 WHEN 'fine' THEN 450 END""",
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(table(spark, sf_dir, "chunks")).filter("n_pieces > 1").select("chunk_id").distinct()


@llm.query("p6_pieces")
def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each chunk as it was first ingested."""
    chunks = table(spark, sf_dir, "chunks")
    first = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.col("ingested_at").asc_nulls_last(), F.xxhash64("text")))
    return _pieces(chunks.withColumn("_n", first).filter("_n = 1"))


ASKED = ("email", "phone", "id_number", "address", "name")


@llm.query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.filter(F.col("kind").isin(*ASKED)).select("doc_id", "kind", "char_start").distinct()


@llm.query("p9_redacted")
def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "redacted")


@llm.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = find_noise(scan_units(table(spark, sf_dir, "parsed_elements"), table(spark, sf_dir, "chunks")))
    kinds = [df.select("unit_id", F.lit(kind).alias("defect")) for kind, df in noise.items()]
    return reduce(DataFrame.union, kinds).distinct()


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(with_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"))


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mix_targets").select("source", F.col("target_share").alias("share"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sized(spark, sf_dir), table(spark, sf_dir, "pack_limits"), _shares(spark, sf_dir))


@llm.query("p2_paragraphs")
def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paper_paragraphs(table(spark, sf_dir, "parsed_elements"), table(spark, sf_dir, "chunks"))


@llm.query("p7_containers")
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


@llm.query("p7_fill")
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each limit: containers, tokens, and the share of the room that is used."""
    per = _packed(spark, sf_dir).groupBy("limit_id", "container").agg(F.sum("n_tokens").alias("n_tokens"))
    sums = per.groupBy("limit_id").agg(F.count("*").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return sums.join(table(spark, sf_dir, "pack_limits"), "limit_id").withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))


@llm.query("p7_windows")
def p7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each window holds of each target source, beside its target."""
    return window_shares(_packed(spark, sf_dir), _shares(spark, sf_dir))


def _target_tokens(sized: DataFrame, targets: DataFrame) -> int:
    """As much as the target sources hold: the total that is asked for."""
    wanted = targets.filter("target_share > 0").select("source").distinct()
    return sized.join(wanted, "source", "left_semi").agg(F.sum("n_tokens")).first()[0] or 0


@llm.query("p8_mixture")
def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of as many tokens as the target sources hold; a source that cannot give its part gives all its repeats."""
    sized, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mix(sized, targets, _target_tokens(sized, targets))


@llm.query("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    total = _target_tokens(sized, targets)
    return shares_reached(mix(sized, targets, total), sized, targets, total)


@llm.query("p8_exact_shares")
def p8_exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of the largest mixture in which no source with text falls short."""
    sized, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return shares_reached(mix(sized, targets), sized, targets)

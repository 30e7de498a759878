"""Queries of records on their way: validated, rebuilt, filtered, downloaded, priced, and reported."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.operators import evaluation as E
from vellumine.operators import records as R
from vellumine.plans.files import scratch
from vellumine.plans.registry import Registry
from vellumine.plans.retrieval import _GOLD, _hits, _topk_sql, _vectors
from vellumine.sources import files as S
from vellumine.sources.tables import table

pipeline = Registry()

_TYPE = "coalesce(json_type(j, '$.{0}'), 'NULL') NOT IN ('NULL', {1})"
_NUMBER = "'UBIGINT', 'BIGINT'"


@pipeline.query(
    "rejected_records",
    "WITH r AS (SELECT row_id, CASE WHEN json_valid(record) THEN record::JSON END AS j FROM raw_works), e AS (SELECT row_id, unnest(CASE WHEN coalesce(json_type(j), '?') <> 'OBJECT' THEN ['no object'] ELSE list_filter(["
    "CASE WHEN coalesce(json_type(j, '$.id'), 'NULL') <> 'VARCHAR' THEN 'id is missing' END, "
    + ", ".join(f"CASE WHEN {_TYPE.format(f, k)} THEN '{f} has a wrong type' END" for f, k in (("title", "'VARCHAR'"), ("publication_year", _NUMBER), ("cited_by_count", _NUMBER), ("doi", "'VARCHAR'"), ("is_retracted", "'BOOLEAN'")))
    + "], lambda x: x IS NOT NULL) END) AS error FROM r) SELECT row_id, error FROM e",
)
def rejected_records(spark, sf_dir):
    bad = R.validated(table(spark, sf_dir, "raw_works").select("row_id", "record"), R.record_errors(F.col("record")))[1]
    return bad.select("row_id", F.explode("errors").alias("error"))


@pipeline.query("works_by_filter", "SELECT id, lang, publication_year FROM flat_works WHERE lang IN ('en', 'de') AND is_oa AND publication_year <> 2015")
def works_by_filter(spark, sf_dir):
    """A filter string as a predicate that reaches the scan."""
    works = table(spark, sf_dir, "flat_works")
    return works.filter(R.filter_predicate(works, "lang: en|de, is_oa:true, nothing, publication_year:!2015")).select("id", "lang", "publication_year")


@pipeline.query(
    "rehydrated_works",
    """SELECT DISTINCT coalesce(id, openalex_url) AS id, title, coalesce(is_oa, false) AS is_oa, best_oa_pdf_url AS best_url, CASE WHEN best_oa_pdf_url IS NOT NULL THEN best_oa_source END AS best_source,
  primary_pdf_url AS primary_url, CASE WHEN primary_pdf_url IS NOT NULL AND primary_source IS NOT NULL THEN primary_source_type END AS primary_source_type, CASE WHEN primary_pdf_url IS NOT NULL THEN coalesce(is_oa, false) END AS primary_is_oa, coalesce(cited_by_count, 0) AS cited_by_count FROM flat_works""",
)
def rehydrated_works(spark, sf_dir):
    """Flat works to nested JSON and back."""
    flat = table(spark, sf_dir, "flat_works")
    w = flat.select(F.from_json(F.to_json(R.rehydrated(flat)), R.WORK).alias("w")).select("w.*")
    return w.select(
        "id", "title", "open_access.is_oa", F.col("best_oa_location.pdf_url").alias("best_url"), F.col("best_oa_location.source.display_name").alias("best_source"), F.col("primary_location.pdf_url").alias("primary_url"),
        F.col("primary_location.source.type").alias("primary_source_type"), F.col("primary_location.is_oa").alias("primary_is_oa"), "cited_by_count",
    ).distinct()


@pipeline.query("model_claims", "SELECT DISTINCT id, c.text AS claim FROM (SELECT id, unnest(claims) AS c FROM gold_pairs) WHERE c.text IS NOT NULL")
def model_claims(spark, sf_dir):
    """Claims as a model lists them, in a fenced JSON array, read back."""
    texts = F.to_json(F.transform("claims", lambda c: c["text"]))
    answer = F.concat(F.lit("```json\n"), texts, F.lit("\n```"))
    rows = table(spark, sf_dir, "gold_pairs").select("id", F.explode(R.fenced_array(answer)).alias("claim"))
    return rows.filter("claim is not null").distinct()


@pipeline.query(
    "verifier_gap",
    r"""WITH c AS (SELECT difficulty AS model, id, annotator, submitted_at, lower(regexp_replace(c.annotator_label, '^\s+|\s+$', '', 'g')) AS a, lower(regexp_replace(c.reviewer_label, '^\s+|\s+$', '', 'g')) AS r FROM (SELECT *, unnest(claims) AS c FROM gold_pairs)),
per AS (SELECT model, id, annotator, submitted_at, avg((a = 'supports')::INTEGER) AS one, avg((r = 'supports')::INTEGER) AS two, bool_or(a IS NULL OR r IS NULL) AS error FROM c GROUP BY ALL)
SELECT model, count(*) FILTER (WHERE NOT error) AS n, count(*) FILTER (WHERE error) AS n_errors, round(avg(one) FILTER (WHERE NOT error), 6) AS first, round(avg(two) FILTER (WHERE NOT error), 6) AS second, round(avg(one) FILTER (WHERE NOT error) - avg(two) FILTER (WHERE NOT error), 6) AS gap FROM per GROUP BY 1""",
)
def verifier_gap(spark, sf_dir):
    """Two verifiers of the same claims: mean share supported per answer, and the gap; answers that one did not judge whole are errors."""
    tidy = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    pairs = table(spark, sf_dir, "gold_pairs").select(F.col("difficulty").alias("model"), "id", "annotator", "submitted_at", F.explode("claims").alias("c"))
    pairs = pairs.withColumn("a", tidy(F.col("c.annotator_label"))).withColumn("r", tidy(F.col("c.reviewer_label")))
    share = lambda c: F.avg((F.col(c) == "supports").cast("int"))
    per = pairs.groupBy("model", "id", "annotator", "submitted_at").agg(share("a").alias("one"), share("r").alias("two"), F.bool_or(F.col("a").isNull() | F.col("r").isNull()).alias("error"))
    good = lambda c: F.avg(F.when(~F.col("error"), F.col(c)))
    return per.groupBy("model").agg(F.count_if(~F.col("error")).alias("n"), F.count_if("error").alias("n_errors"), F.round(good("one"), 6).alias("first"), F.round(good("two"), 6).alias("second"), F.round(good("one") - good("two"), 6).alias("gap"))


_URL = "coalesce(best_oa_pdf_url, primary_pdf_url)"
_OUTCOME = f"CASE WHEN {_URL} IS NULL THEN 'no_url' WHEN cited_by_count % 5 = 0 THEN 'skipped' WHEN {_URL} LIKE '%.pdf' THEN 'downloaded' ELSE 'failed' END"


def _outcomes(spark, sf_dir):
    """What a download run met: files of every fifth citation count are there, URLs that end in .pdf give one."""
    url = F.coalesce("best_oa_pdf_url", "primary_pdf_url")
    return table(spark, sf_dir, "flat_works").select("id", "loaded_at", R.download_outcome(url, F.coalesce(F.col("cited_by_count") % 5 == 0, F.lit(False)), url.endswith(".pdf")).alias("outcome"))


@pipeline.query("download_outcomes", f"SELECT id, {_OUTCOME} AS outcome FROM flat_works")
def download_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("id", "outcome")


@pipeline.query(
    "download_statistics",
    f"""WITH o AS (SELECT loaded_at, {_OUTCOME} AS s FROM flat_works), c AS (SELECT count(*) AS total_works, count(*) FILTER (WHERE s IN ('downloaded', 'failed')) AS pdfs_found, count(*) FILTER (WHERE s = 'downloaded') AS pdfs_downloaded, count(*) FILTER (WHERE s = 'skipped') AS pdfs_skipped, count(*) FILTER (WHERE s = 'failed') AS pdfs_failed, epoch_us(max(loaded_at)) - epoch_us(min(loaded_at)) AS us FROM o)
SELECT * EXCLUDE (us), round(CASE WHEN pdfs_found = 0 THEN 0 ELSE pdfs_downloaded / pdfs_found * 100 END, 6) AS success_rate, us / 1000000.0 AS duration_seconds FROM c""",
)
def download_statistics(spark, sf_dir):
    """The run's counters as JSON, read back."""
    at = scratch(spark)
    R.download_statistics(_outcomes(spark, sf_dir), "outcome", "loaded_at").write.json(f"{at}/stats")
    kinds = "total_works long, pdfs_found long, pdfs_downloaded long, pdfs_skipped long, pdfs_failed long, success_rate double, duration_seconds double"
    return spark.read.schema(kinds).json(f"{at}/stats").withColumn("success_rate", F.round("success_rate", 6))


@pipeline.query("cost_from_first", "WITH f AS (SELECT avg(length(text) // 4) AS m FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 100)) SELECT floor(m * n)::BIGINT AS n_tokens, round(floor(m * n) / 1000000.0 * 0.02, 9) AS cost FROM f, (SELECT count(*) AS n FROM documents)")
def cost_from_first(spark, sf_dir):
    """The first hundred texts are what the estimate is made of, by its definition."""
    out = R.cost_from_first(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", F.floor(F.length("text") / 4), 0.02)
    return out.withColumn("cost", F.round("cost", 9))


@pipeline.query("prefixed_texts", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'intfloat/multilingual-e5-large' ELSE 'BAAI/bge-m3' END AS model, CASE WHEN doc_id % 2 = 0 THEN 'query: ' || text ELSE text END AS as_query, CASE WHEN doc_id % 2 = 0 THEN 'passage: ' || text ELSE text END AS as_passage FROM documents")
def prefixed_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "intfloat/multilingual-e5-large").otherwise("BAAI/bge-m3").alias("model"))
    return docs.select("doc_id", "model", R.prefixed(F.col("text"), F.col("model"), False).alias("as_query"), R.prefixed(F.col("text"), F.col("model"), True).alias("as_passage"))


@pipeline.query(
    "unbuilt_indexes",
    "WITH plan AS (SELECT m.model, t.chunk_type FROM (SELECT DISTINCT lang AS model FROM documents WHERE lang IS NOT NULL) m, (VALUES ('coarse'), ('fine')) t(chunk_type)), parts AS (SELECT lang AS model, CASE WHEN doc_id % 2 = 0 THEN 'coarse' ELSE 'fine' END AS chunk_type, count(DISTINCT doc_id % 3 = 0) AS n FROM documents WHERE lang IS NOT NULL AND (lang <> 'fr' OR doc_id % 6 = 0) GROUP BY ALL) SELECT model, chunk_type FROM plan ANTI JOIN (SELECT * FROM parts WHERE n = 2) b USING (model, chunk_type)",
)
def unbuilt_indexes(spark, sf_dir):
    """The (model, type) pairs of a plan for which not both parts of an index are there."""
    docs = table(spark, sf_dir, "documents").filter("lang is not null").withColumnRenamed("lang", "model")
    plan = docs.select("model").distinct().withColumn("chunk_type", F.explode(F.array(F.lit("coarse"), F.lit("fine"))))
    there = docs.filter("model <> 'fr' or doc_id % 6 = 0").select("model", F.when(F.col("doc_id") % 2 == 0, "coarse").otherwise("fine").alias("chunk_type"), (F.col("doc_id") % 3 == 0).alias("part"))
    built = there.groupBy("model", "chunk_type").agg(F.countDistinct("part").alias("n")).filter("n = 2")
    return plan.join(built, ["model", "chunk_type"], "left_anti")


_PAPER_SQL = _GOLD.split(", gold AS")[0]


@pipeline.query(
    "metrics_paper_level",
    _PAPER_SQL
    + """, r AS (SELECT t.query_id, t.rank, q.label = c.label AS is_gold FROM top t JOIN embeddings q ON q.vec_id = t.query_id JOIN embeddings c ON c.vec_id = t.vec_id)
SELECT query_id, """
    + ", ".join(f"round(avg(is_gold::INTEGER) FILTER (WHERE rank < {k}), 6) AS precision_{k}, max(is_gold::INTEGER) FILTER (WHERE rank < {k})::DOUBLE AS recall_{k}" for k in (5, 10))
    + ", round(coalesce(1 / min(rank + 1) FILTER (WHERE is_gold), 0), 6) AS mrr FROM r GROUP BY query_id",
)
def metrics_paper_level(spark, sf_dir):
    """The same hits judged by what they belong to: several may be of one paper, each counts for precision, the first for recall."""
    corpus = _vectors(spark, sf_dir)[1].select("vec_id", F.col("label").alias("item"))
    hits = _hits(spark, sf_dir, 20).join(corpus, "vec_id").select("query_id", "item", "rank")
    gold = corpus.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    per = E.ranking_metrics(hits, gold, (5, 10))
    return per.select("query_id", *[F.round(c, 6).alias(c) for k in (5, 10) for c in (f"precision_{k}", f"recall_{k}")], F.round("mrr", 6).alias("mrr"))


_KS = (5, 10, 20)
_ROW = "count(mrr) AS n, " + ", ".join(f"printf('%.3f', avg(hit_{k})) AS hit_{k}" for k in _KS) + ", printf('%.3f', avg(precision_20)) AS precision_20, printf('%.3f', avg(recall_20)) AS recall_20, printf('%.3f', avg(mrr)) AS mrr"
_CONFIGS = ("ip", "l2", "none")


@pipeline.query("ablation_table", " UNION ALL ".join(f"SELECT * FROM ({_GOLD.replace(_topk_sql('ip', 20), _topk_sql(m, 20))} SELECT '{m}' AS config, {_ROW} FROM per)" for m in ("ip", "l2")))
def ablation_table(spark, sf_dir):
    """Each configuration's result as a file of its own; those that are there are read back into one comparison."""
    at = scratch(spark)
    corpus = _vectors(spark, sf_dir)[1]
    q = corpus.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    gold = q.join(corpus.select(F.col("vec_id").alias("item"), "label"), "label").filter("item <> query_id").select("query_id", "item")
    for m in ("ip", "l2"):
        per = E.ranking_metrics(_hits(spark, sf_dir, 20, m).withColumnRenamed("vec_id", "item"), gold, _KS)
        one = E.macro_average(per).select(F.lit(f"{m}.json").alias("name"), F.to_json(F.struct(F.lit(m).alias("config"), "n", *[f"hit_{k}" for k in _KS], "precision_20", "recall_20", "mrr")).alias("body"))
        S.write_named(one, at, F.col("name"), "body").agg(F.count("*")).collect()
    rows = S.read_results(spark, at, _CONFIGS, "config string, n long, " + ", ".join(f"hit_{k} double" for k in _KS) + ", precision_20 double, recall_20 double, mrr double")
    return E.summary_row(rows, _KS)


@pipeline.query("metrics_html", "SELECT coalesce(lang, '?') AS strategy, CASE WHEN avg(length(text)) IS NULL THEN 'N/A' ELSE printf('%.3f', avg(length(text))) END AS mean_size, printf('%.1f%%', avg((source IS NOT NULL)::INTEGER) * 100) AS coverage, CASE WHEN avg(nullif(n_chars, n_chars)) IS NULL THEN 'N/A' END AS nothing FROM documents GROUP BY 1")
def metrics_html(spark, sf_dir):
    """The cells of a table of metrics."""
    per = table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("?")).alias("strategy")).agg(F.avg(F.length("text")).alias("mean_size"), F.avg(F.col("source").isNotNull().cast("int")).alias("coverage"))
    return per.select("strategy", R.metric_cell(F.col("mean_size")).alias("mean_size"), R.metric_cell(F.col("coverage"), percent=True).alias("coverage"), R.metric_cell(F.lit(None).cast("double")).alias("nothing"))

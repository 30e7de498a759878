"""Queries over metadata, chunk quality, gold pairs, faithfulness and operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellumine.operators import faithfulness as V
from vellumine.operators import gold as G
from vellumine.operators import metadata as M
from vellumine.operators import quality as Q
from vellumine.plans.records import _LATEST
from vellumine.plans.registry import Registry
from vellumine.sources.tables import table

analysis = Registry()
_round = lambda df, *cols, n=6: df.select(*[F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---- metadata -------------------------------------------------------------------------------
def _place_sql(name: str, p: str) -> str:
    return f"""w->>'$.{name}.pdf_url' AS {p}_pdf_url, w->>'$.{name}.landing_page_url' AS {p}_landing_page, w->>'$.{name}.version' AS {p}_version, w->>'$.{name}.license' AS {p}_license,
  CASE WHEN json_type(w, '$.{name}.source') = 'OBJECT' THEN w->>'$.{name}.source.display_name' ELSE w->>'$.{name}.source' END AS {p}_source, w->>'$.{name}.source.type' AS {p}_source_type"""


_JOINED = "CASE WHEN len({0}) > 0 THEN array_to_string({0}, '|') END"
_FLAT_SQL = (
    _LATEST
    + f""", lists AS (SELECT p.openalex_id, p.w,
  list_transform(list_filter(p.l, lambda x: json_type(x) = 'OBJECT'), lambda x: {{'pdf': x->>'$.pdf_url', 'is_oa': coalesce((x->>'$.is_oa') = 'true', false)}}) AS loc,
  list_transform(list_filter(p.a, lambda x: json_type(x) = 'OBJECT'), lambda x: CASE WHEN json_type(x, '$.author') = 'OBJECT' THEN x->>'$.author.display_name' ELSE x->>'$.author' END) AS author,
  CASE json_type(w, '$.concepts') WHEN 'ARRAY' THEN list_filter(json_extract(w, '$.concepts[*]'), lambda x: json_type(x) = 'OBJECT') WHEN 'OBJECT' THEN [json_extract(w, '$.concepts')] ELSE [] END AS concept,
  CASE json_type(w, '$.keywords') WHEN 'ARRAY' THEN list_transform(json_extract(w, '$.keywords[*]'), lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN x->>'$.display_name' ELSE x->>'$' END) ELSE [] END AS keyword FROM parts p),
urls AS (SELECT *, list_filter([w->>'$.best_oa_location.pdf_url', w->>'$.primary_location.pdf_url'] || list_transform(loc, lambda x: x.pdf), lambda u: u IS NOT NULL AND u <> '') AS dup, list_filter(author, lambda x: x IS NOT NULL AND x <> '') AS names,
  list_filter(keyword, lambda x: x IS NOT NULL AND x <> '') AS kw FROM lists),
flat AS (SELECT *, list_filter(dup, lambda u, i: list_position(dup, u) = i) AS u FROM urls)
SELECT openalex_id, w->>'$.id' AS id, w->>'$.doi' AS doi, coalesce(nullif(w->>'$.title', ''), w->>'$.display_name') AS title, CAST(w->>'$.publication_year' AS INTEGER) AS publication_year, w->>'$.publication_date' AS publication_date,
  w->>'$.type' AS work_type, w->>'$.language' AS lang, coalesce(CAST(w->>'$.open_access.is_oa' AS BOOLEAN), false) AS is_oa, w->>'$.open_access.oa_status' AS oa_status,
  coalesce(CAST(w->>'$.open_access.any_repository_has_fulltext' AS BOOLEAN), false) AS any_repository_has_fulltext, {_place_sql("best_oa_location", "best_oa")}, {_place_sql("primary_location", "primary")},
  len(loc)::INTEGER AS num_locations, len(u)::INTEGER AS num_pdf_urls, len(list_filter(loc, lambda x: x.is_oa))::INTEGER AS num_oa_locations, {_JOINED.format("u")} AS all_pdf_urls, len(u) > 0 AS has_any_pdf,
  coalesce(nullif(w->>'$.best_oa_location.pdf_url', ''), nullif(w->>'$.primary_location.pdf_url', ''), list_filter(loc, lambda x: x.is_oa AND x.pdf IS NOT NULL AND x.pdf <> '')[1].pdf) AS best_pdf_url,
  string_split(w->>'$.primary_topic.id', '/')[-1] AS topic_id, w->>'$.primary_topic.display_name' AS topic_name, w->>'$.primary_topic.subfield.display_name' AS topic_subfield, w->>'$.primary_topic.field.display_name' AS topic_field,
  w->>'$.primary_topic.domain.display_name' AS topic_domain, len(author)::INTEGER AS num_authors, names[1] AS first_author, {_JOINED.format("names")} AS author_names,
  """
    + ", ".join(f"concept[{i}]->>'$.display_name' AS concept_{i}_name, CAST(concept[{i}]->>'$.score' AS DOUBLE) AS concept_{i}_score" for i in (1, 2, 3))
    + f""", {_JOINED.format("kw")} AS keywords, CAST(w->>'$.cited_by_count' AS INTEGER) AS cited_by_count, coalesce(CAST(w->>'$.is_retracted' AS BOOLEAN), false) AS is_retracted,
  coalesce(CAST(w->>'$.is_paratext' AS BOOLEAN), false) AS is_paratext FROM flat"""
)


@analysis.query("flatten_work", _FLAT_SQL)
def flatten_work(spark, sf_dir):
    return M.flatten_works(table(spark, sf_dir, "raw_works"))


@analysis.query(
    "summary_counts",
    """SELECT count(*) AS total_works, count(*) FILTER (WHERE has_any_pdf) AS works_with_pdf, count(*) FILTER (WHERE NOT has_any_pdf) AS works_without_pdf, count(best_oa_pdf_url) AS works_with_best_oa_pdf,
count(primary_pdf_url) AS works_with_primary_pdf, count(doi) AS with_doi, min(publication_year) AS min_year, max(publication_year) AS max_year, round(avg(publication_year), 6) AS mean_year, sum(cited_by_count)::BIGINT AS total_citations,
round(avg(cited_by_count), 6) AS mean_citations, median(cited_by_count) AS median_citations, max(cited_by_count) AS max_citations FROM flat_works""",
)
def summary_counts(spark, sf_dir):
    return _round(M.corpus_summary(table(spark, sf_dir, "flat_works")), "mean_year", "mean_citations")


for _col in ("oa_status", "best_oa_source_type", "work_type"):
    analysis.query(f"value_counts_{_col}", f"SELECT {_col} AS value, count(*) AS n FROM flat_works WHERE {_col} IS NOT NULL GROUP BY 1")(lambda spark, sf_dir, c=_col: M.value_counts(table(spark, sf_dir, "flat_works"), c))
analysis.query("value_counts_topk", "SELECT best_oa_source AS value, count(*) AS n FROM flat_works WHERE best_oa_source IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")(
    lambda spark, sf_dir: M.value_counts(table(spark, sf_dir, "flat_works"), "best_oa_source", 10)
)


@analysis.query("works_with_pdf", "SELECT id, openalex_id, all_pdf_urls FROM flat_works WHERE has_any_pdf")
def works_with_pdf(spark, sf_dir):
    return table(spark, sf_dir, "flat_works").filter("has_any_pdf").select("id", "openalex_id", "all_pdf_urls")


@analysis.query(
    "typed_columns",
    "SELECT id, TRY_CAST(publication_date AS DATE) AS publication_date, TRY_CAST(substring(openalex_id, 2) AS BIGINT) AS id_number, TRY_CAST(doi AS INTEGER) AS not_a_number, coalesce(is_retracted, false) AS is_retracted FROM flat_works",
)
def typed_columns(spark, sf_dir):
    """Numbers and dates coerced, what cannot be read null, null flags false."""
    w = table(spark, sf_dir, "flat_works")
    return w.select("id", F.try_to_date("publication_date", "yyyy-MM-dd").alias("publication_date"), F.substring("openalex_id", 2, 30).try_cast("long").alias("id_number"), F.col("doi").try_cast("int").alias("not_a_number"), F.coalesce("is_retracted", F.lit(False)).alias("is_retracted"))


@analysis.query("filter_map", "SELECT id, 'x' AS k, trim(v) AS v FROM (SELECT id, coalesce(doi, 'none') AS v FROM flat_works) UNION ALL SELECT id, 'type', coalesce(work_type, 'none') FROM flat_works")
def filter_map(spark, sf_dir):
    """A filter string of a work parsed to a map, one row per entry."""
    spec = F.concat(F.lit(" x : "), F.coalesce("doi", F.lit("none")), F.lit(" ,noise, type:"), F.coalesce("work_type", F.lit("none")))
    return table(spark, sf_dir, "flat_works").select("id", F.explode(M.parse_filters(spec)).alias("k", "v"))


@analysis.query("pdf_content_check", "SELECT id, coalesce(contains(lower(work_type), 'pdf') OR ends_with(lower(primary_pdf_url), '.pdf'), false) AS is_pdf FROM flat_works")
def pdf_content_check(spark, sf_dir):
    return table(spark, sf_dir, "flat_works").select("id", F.coalesce(F.lower("work_type").contains("pdf") | F.lower("primary_pdf_url").endswith(".pdf"), F.lit(False)).alias("is_pdf"))


# ---- chunk quality --------------------------------------------------------------------------
_BY = ["chunk_type"]


@analysis.query(
    "chunk_stats_interp",
    """SELECT chunk_type, count(*) AS n_chunks, round(avg(length(text)), 6) AS mean_chars, median(length(text)) AS median_chars, round(stddev_pop(length(text)), 6) AS std_chars, min(length(text))::INTEGER AS min_chars,
max(length(text))::INTEGER AS max_chars, round(avg(length(text) // 4), 6) AS mean_tokens, median(length(text) // 4) AS median_tokens FROM chunks GROUP BY 1""",
)
def chunk_stats_interp(spark, sf_dir):
    return _round(Q.chunk_statistics(table(spark, sf_dir, "chunks"), _BY), "mean_chars", "std_chars", "mean_tokens")


@analysis.query("chunk_stats_upper", "SELECT chunk_type, count(*) AS n_chunks, (list_sort(list(length(text)))[count(*) // 2 + 1])::INTEGER AS median_chars FROM chunks GROUP BY 1")
def chunk_stats_upper(spark, sf_dir):
    return Q.upper_median(table(spark, sf_dir, "chunks"), _BY)


_CITES = r"len(regexp_extract_all(text, '\$\^\{\d+\}\$')) + len(regexp_extract_all(text, '\[\d+\]')) + len(regexp_extract_all(text, '\(\d+\)'))"


@analysis.query(
    "citation_integrity",
    f"""SELECT chunk_type, sum(n)::BIGINT AS total_citations, count(*) FILTER (WHERE n > 0) AS chunks_with_citations, round(count(*) FILTER (WHERE n > 0) / count(*), 6) AS citation_coverage,
round(coalesce(avg(n / len * 1000) FILTER (WHERE n > 0), 0), 6) AS mean_citation_density, count(*) AS total_chunks FROM (SELECT chunk_type, {_CITES} AS n, length(text) AS len FROM chunks) GROUP BY 1""",
)
def citation_integrity(spark, sf_dir):
    return _round(Q.citation_integrity(table(spark, sf_dir, "chunks"), _BY), "citation_coverage", "mean_citation_density")


@analysis.query(
    "coherence",
    """WITH u AS (SELECT label, vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings)
SELECT a.label, round(coalesce(avg(list_inner_product(a.e, b.e)) FILTER (WHERE a.vec_id <> b.vec_id), 1.0), 6) AS coherence FROM u a JOIN u b ON a.label = b.label GROUP BY 1""",
)
def coherence(spark, sf_dir):
    """Vectors of a label standing for the sentences of a chunk."""
    return _round(Q.coherence(table(spark, sf_dir, "embeddings"), "label", "embedding"), "coherence")


@analysis.query(
    "boundary_pairs",
    """WITH p AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lead(vec_id) OVER w AS next_id, lead(embedding::DOUBLE[]) OVER w AS n FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label, vec_id, next_id, round(list_inner_product(e, n) / sqrt(list_inner_product(e, e) * list_inner_product(n, n)), 6) AS similarity FROM p WHERE next_id IS NOT NULL""",
)
def boundary_pairs(spark, sf_dir):
    """Each vector with the next one of its group, standing for chunks of a document."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = F.col("embedding").cast("array<double>")
    p = table(spark, sf_dir, "embeddings").select("label", "vec_id", e.alias("e"), F.lead("vec_id").over(w).alias("next_id"), F.lead(e).over(w).alias("n")).filter("next_id is not null")
    return p.select("label", "vec_id", "next_id", F.round(Q.cosine(F.col("e"), F.col("n")), 6).alias("similarity"))


_STRATEGIES = f"""s AS (SELECT coalesce(source, 'none') AS strategy, avg(length(text)) AS mean_size, stddev_pop(length(text)) AS std_size, count(*) FILTER (WHERE {_CITES} > 0) / count(*) AS coverage, 0.4::DOUBLE AS coherence,
  count(*) FILTER (WHERE lang = 'en') / count(*) AS boundary FROM documents GROUP BY 1)"""


def _strategies(spark, sf_dir):
    from vellumine.functions.text import citation_count

    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.coalesce("source", F.lit("none")).alias("strategy")).agg(
        F.avg(F.length("text")).alias("mean_size"), F.stddev_pop(F.length("text")).alias("std_size"), (F.count_if(citation_count("text") > 0) / F.count("*")).alias("coverage"),
        F.first(F.lit(0.4)).alias("coherence"), (F.count_if(F.col("lang") == "en") / F.count("*")).alias("boundary"),
    )


@analysis.query(
    "strategy_score",
    f"""WITH {_STRATEGIES}, p AS (SELECT strategy, coherence * 15 + (1 - boundary) * 20 + coverage * 20 + CASE WHEN std_size > 2000 THEN 0 WHEN std_size > 1000 THEN (2000 - std_size) / 1000 * 25 ELSE 25 - std_size / 1000 * 5 END
+ CASE WHEN mean_size BETWEEN 1800 AND 2500 THEN 20 WHEN mean_size BETWEEN 1500 AND 3000 THEN 15 WHEN mean_size BETWEEN 1000 AND 4000 THEN 10 ELSE 0 END AS score FROM s)
SELECT strategy, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, strategy) = 1 AS best FROM p""",
)
def strategy_score(spark, sf_dir):
    s = _strategies(spark, sf_dir).select("strategy", Q.strategy_score(F.col("coherence"), F.col("boundary"), F.col("coverage"), F.col("std_size"), F.col("mean_size")).alias("score"))
    first = F.row_number().over(Window.partitionBy().orderBy(F.round("score", 9).desc(), "strategy")) == 1  # one row per strategy
    return _round(s.withColumn("best", first), "score")


@analysis.query(
    "minmax_matrix",
    f"WITH {_STRATEGIES} SELECT strategy, "
    + ", ".join(f"round(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN {c} ELSE {e} END, 6) AS {c}" for c, e in (
        ("mean_size", "(mean_size - min(mean_size) OVER ()) / (max(mean_size) OVER () - min(mean_size) OVER ())"),
        ("std_size", "1 - (std_size - min(std_size) OVER ()) / (max(std_size) OVER () - min(std_size) OVER ())"),
        ("coverage", "(coverage - min(coverage) OVER ()) / (max(coverage) OVER () - min(coverage) OVER ())"),
        ("coherence", "coherence"),
        ("boundary", "1 - (boundary - min(boundary) OVER ()) / (max(boundary) OVER () - min(boundary) OVER ())"),
    ))
    + " FROM s",
)
def minmax_matrix(spark, sf_dir):
    cols = ["mean_size", "std_size", "coverage", "coherence", "boundary"]
    return _round(Q.min_max(_strategies(spark, sf_dir), cols, ("std_size", "boundary")), *cols)


@analysis.query("normalised_scores", "SELECT doc_id, round(greatest(0, least(1, 1 - (n_chars - 100) / 900)), 6) AS inverted, 0.5::DOUBLE AS degenerate FROM documents")
def normalised_scores(spark, sf_dir):
    n = F.col("n_chars").cast("double")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(Q.normalise_score(n, F.lit(100.0), F.lit(1000.0), True), 6).alias("inverted"), Q.normalise_score(n, F.lit(1.0), F.lit(1.0)).alias("degenerate"))


@analysis.query("rounded_metrics", "SELECT label, nullif(round(avg(embedding[1]), 1), 0) AS score FROM embeddings GROUP BY 1")
def rounded_metrics(spark, sf_dir):
    """Rounded metrics, where a rounded zero counts as missing."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.nullif(F.round(F.avg(F.get("embedding", 0).cast("double")), 1), F.lit(0.0)).alias("score"))


@analysis.query("box_statistics", "SELECT chunk_type, quantile_cont(length(text), 0.25) AS q1, quantile_cont(length(text), 0.5) AS q2, quantile_cont(length(text), 0.75) AS q3 FROM chunks GROUP BY 1 UNION ALL SELECT 'all', quantile_cont(length(text), 0.25), quantile_cont(length(text), 0.5), quantile_cont(length(text), 0.75) FROM chunks")
def box_statistics(spark, sf_dir):
    n = F.length("text")
    stats = [F.percentile(n, q).alias(f"q{i}") for i, q in enumerate((0.25, 0.5, 0.75), 1)]
    c = table(spark, sf_dir, "chunks")
    return c.groupBy("chunk_type").agg(*stats).unionByName(c.agg(*stats).withColumn("chunk_type", F.lit("all")))


@analysis.query("size_histogram", "SELECT chunk_type, least(length(text) // 250, 20)::INTEGER AS bin, count(*) AS n FROM chunks GROUP BY ALL")
def size_histogram(spark, sf_dir):
    return table(spark, sf_dir, "chunks").groupBy("chunk_type", F.least(F.floor(F.length("text") / 250), F.lit(20)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


# ---- gold pairs -----------------------------------------------------------------------------
_LABELS = ("supports", "contradicts", "unrelated")


@analysis.query(
    "gold_validate_fast",
    r"""WITH f AS (SELECT id, unnest(list_filter([
  CASE WHEN NOT coalesce(regexp_matches(id, '^q[0-9]{3,}$'), false) THEN 'id does not match' END,
  CASE WHEN coalesce(length(question), 0) < 1 THEN 'question is empty' END,
  CASE WHEN coalesce(length(gold_answer), 0) < 1 THEN 'gold_answer is empty' END,
  CASE WHEN coalesce(difficulty NOT IN ('single-hop', 'multi-hop', 'unanswerable'), true) THEN 'difficulty is unknown' END,
  CASE WHEN coalesce(category NOT IN ('policy_impact', 'methodology', 'comparison', 'factual', 'multi_hop'), true) THEN 'category is unknown' END,
  CASE WHEN coalesce(review_status NOT IN ('pending', 'approved', 'rejected'), true) THEN 'review_status is unknown' END,
  CASE WHEN len(list_filter(claims, lambda c: NOT coalesce(regexp_matches(c.id, '^c[0-9]{3,}$'), false))) > 0 THEN 'claim id does not match' END,
  CASE WHEN len(list_distinct(list_transform(claims, lambda c: c.id))) < len(claims) THEN 'duplicate claim id' END,
  CASE WHEN difficulty = 'unanswerable' AND len(claims) > 0 THEN 'unanswerable pair must have no claims' END,
  CASE WHEN difficulty IN ('single-hop', 'multi-hop') AND coalesce(len(claims), 0) = 0 THEN 'answerable pair must have a claim' END,
  CASE WHEN len(list_filter(claims, lambda c: len(list_filter(c.supporting_spans, lambda s: s.char_end <= s.char_start)) > 0)) > 0 THEN 'char_end must be > char_start' END,
  CASE WHEN len(list_filter(claims, lambda c: len(list_filter(c.supporting_spans, lambda s: s.char_start < 0)) > 0)) > 0 THEN 'char_start must be >= 0' END,
  CASE WHEN len(list_filter(claims, lambda c: len(list_filter(c.supporting_spans, lambda s: NOT coalesce(regexp_matches(s.paper_id, '^[0-9]{5}_[A-Za-z0-9]+$'), false))) > 0)) > 0 THEN 'paper_id does not match' END
], lambda x: x IS NOT NULL)) AS message FROM (SELECT * FROM gold_pairs UNION ALL SELECT * REPLACE ('x' || id AS id, '' AS question, 'odd' AS category, 'unanswerable' AS difficulty) FROM gold_pairs))
SELECT id, message FROM f""",
)
def gold_validate_fast(spark, sf_dir):
    """The pairs, and a spoiled copy of each, so that the rules have something to report."""
    p = table(spark, sf_dir, "gold_pairs")
    spoiled = p.withColumn("id", F.concat(F.lit("x"), "id")).withColumn("question", F.lit("")).withColumn("category", F.lit("odd")).withColumn("difficulty", F.lit("unanswerable"))
    return G.pair_errors(p.unionByName(spoiled))


@analysis.query(
    "gold_validate_strict",
    r"""WITH s AS (SELECT DISTINCT id, claim_id, x.paper_id, x.char_start, x.char_end, x.quote FROM (SELECT id, c.id AS claim_id, unnest(c.supporting_spans) AS x FROM (SELECT id, unnest(claims) AS c FROM gold_pairs))),
j AS (SELECT s.*, regexp_replace(d.text, '\r\n?', chr(10), 'g') AS md FROM s LEFT JOIN (SELECT paper_id, replace(text, 'Interviews', 'Talks') AS text FROM documents WHERE lang <> 'de') d ON d.paper_id = s.paper_id WHERE s.quote IS NOT NULL AND s.char_start IS NOT NULL AND s.char_end IS NOT NULL AND s.paper_id IS NOT NULL)
SELECT id, claim_id, paper_id, char_start, CASE WHEN md IS NULL THEN 'document not found' WHEN char_end > length(md) THEN 'span out of bounds' WHEN substring(md, char_start + 1, char_end - char_start) <> quote THEN 'quote mismatch' END AS message
FROM j WHERE message IS NOT NULL""",
)
def gold_validate_strict(spark, sf_dir):
    """Against spoiled documents, as the true ones break no rule."""
    docs = table(spark, sf_dir, "documents").filter("lang <> 'de'").select("paper_id", F.replace("text", F.lit("Interviews"), F.lit("Talks")).alias("text"))
    return G.span_errors(table(spark, sf_dir, "gold_pairs"), docs)


@analysis.query("duplicate_ids", "SELECT id, count(*) - 1 AS errors FROM gold_pairs GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return table(spark, sf_dir, "gold_pairs").groupBy("id").agg((F.count("*") - 1).alias("errors")).filter("errors > 0")


@analysis.query("cross_file_ids", "SELECT id, count(DISTINCT member_file) AS n_files FROM gold_pairs GROUP BY 1 HAVING count(DISTINCT member_file) > 1")
def cross_file_ids(spark, sf_dir):
    return table(spark, sf_dir, "gold_pairs").groupBy("id").agg(F.countDistinct("member_file").alias("n_files")).filter("n_files > 1")


_PAIRS_SQL = r"""WITH b AS (SELECT lower(regexp_replace(c.annotator_label, '^\s+|\s+$', '', 'g')) AS a, lower(regexp_replace(c.reviewer_label, '^\s+|\s+$', '', 'g')) AS r FROM (SELECT unnest(claims) AS c FROM gold_pairs WHERE iaa_subset)),
ok AS (SELECT a, r FROM b WHERE a IN ('supports', 'contradicts', 'unrelated') AND r IN ('supports', 'contradicts', 'unrelated'))"""


@analysis.query(
    "kappa",
    _PAIRS_SQL
    + """, t AS (SELECT count(*) AS n, avg((a = r)::INTEGER) AS po FROM ok), e AS (SELECT sum(x.c * y.c) AS ar FROM (SELECT a AS l, count(*) AS c FROM ok GROUP BY 1) x JOIN (SELECT r AS l, count(*) AS c FROM ok GROUP BY 1) y USING (l))
SELECT n, round(po, 6) AS observed, round(ar / (n * n), 6) AS expected, round(CASE WHEN ar = n * n THEN 1.0 ELSE (po - ar / (n * n)) / (1 - ar / (n * n)) END, 6) AS kappa FROM t, e""",
)
def kappa(spark, sf_dir):
    return _round(G.cohens_kappa(G.label_pairs(table(spark, sf_dir, "gold_pairs"), _LABELS)), "observed", "expected", "kappa")


@analysis.query("label_histogram", _PAIRS_SQL + ", x AS (SELECT 'annotator' AS rater, a AS label FROM ok UNION ALL SELECT 'reviewer', r FROM ok) SELECT d.rater, d.label, count(x.label) AS n FROM (SELECT * FROM (VALUES ('annotator'), ('reviewer')) r(rater), (VALUES ('supports'), ('contradicts'), ('unrelated'), ('other')) l(label)) d LEFT JOIN x USING (rater, label) GROUP BY ALL")
def label_histogram(spark, sf_dir):
    """Counts per rater side and label, zeros included."""
    both = G.label_pairs(table(spark, sf_dir, "gold_pairs"), _LABELS)
    long = both.select(F.inline(F.array(F.struct(F.lit("annotator").alias("rater"), F.col("annotator_label").alias("label")), F.struct(F.lit("reviewer").alias("rater"), F.col("reviewer_label").alias("label")))))
    every = spark.createDataFrame([(r, x) for r in ("annotator", "reviewer") for x in (*_LABELS, "other")], "rater string, label string")
    return every.join(long.groupBy("rater", "label").agg(F.count("*").alias("c")), ["rater", "label"], "left").select("rater", "label", F.coalesce("c", F.lit(0)).alias("n"))


@analysis.query("degenerate_labels", _PAIRS_SQL + " SELECT (SELECT count(DISTINCT l) FROM (SELECT a AS l FROM ok UNION ALL SELECT r FROM ok)) AS n_labels, (SELECT count(DISTINCT l) FROM (SELECT a AS l FROM ok UNION ALL SELECT r FROM ok)) <= 1 AS degenerate")
def degenerate_labels(spark, sf_dir):
    both = G.label_pairs(table(spark, sf_dir, "gold_pairs"), _LABELS)
    n = F.countDistinct("label")
    return both.select(F.col("annotator_label").alias("label")).union(both.select("reviewer_label")).agg(n.alias("n_labels"), (n <= 1).alias("degenerate"))


@analysis.query("report_grouping_sets", "SELECT annotator, difficulty, category, count(*) AS n FROM gold_pairs GROUP BY GROUPING SETS ((annotator), (difficulty), (category))")
def report_grouping_sets(spark, sf_dir):
    g = table(spark, sf_dir, "gold_pairs")
    return g.groupingSets([[F.col("annotator")], [F.col("difficulty")], [F.col("category")]], "annotator", "difficulty", "category").agg(F.count("*").alias("n"))


@analysis.query("sorted_pairs", "SELECT id, member_file, row_number() OVER (PARTITION BY id ORDER BY coalesce(member_file, ''), submitted_at, coalesce(annotator, '')) AS pass FROM (SELECT DISTINCT id, member_file, submitted_at, annotator FROM gold_pairs)")
def sorted_pairs(spark, sf_dir):
    one = table(spark, sf_dir, "gold_pairs").select("id", "member_file", "submitted_at", "annotator").distinct()
    w = Window.partitionBy("id").orderBy(F.coalesce("member_file", F.lit("")), "submitted_at", F.coalesce("annotator", F.lit("")))
    return one.select("id", "member_file", F.row_number().over(w).cast("long").alias("pass"))


@analysis.query("bag_equality", "SELECT (SELECT count(*) FROM (SELECT id, question FROM gold_pairs EXCEPT ALL SELECT id, question FROM gold_pairs WHERE id IS NOT NULL)) + (SELECT count(*) FROM (SELECT id, question FROM gold_pairs WHERE difficulty <> 'multi-hop' EXCEPT ALL SELECT id, question FROM gold_pairs)) AS differences")
def bag_equality(spark, sf_dir):
    a = table(spark, sf_dir, "gold_pairs").select("id", "question")
    b = table(spark, sf_dir, "gold_pairs").filter("difficulty <> 'multi-hop'").select("id", "question")
    both = a.exceptAll(a.filter("id is not null")).unionByName(b.exceptAll(a))
    return both.agg(F.count("*").alias("differences"))


@analysis.query("evaluable_pairs", "SELECT DISTINCT id FROM gold_pairs WHERE annotator IS DISTINCT FROM 'adversarial' AND difficulty IS DISTINCT FROM 'unanswerable'")
def evaluable_pairs(spark, sf_dir):
    from vellumine.operators.evaluation import evaluable

    return table(spark, sf_dir, "gold_pairs").filter(evaluable(F.col("annotator"), F.col("difficulty"))).select("id").distinct()


@analysis.query("answerable_pairs", "SELECT DISTINCT id FROM gold_pairs WHERE len(claims) > 0 AND len(claims[1].supporting_spans) > 0 AND difficulty <> 'unanswerable'")
def answerable_pairs(spark, sf_dir):
    return table(spark, sf_dir, "gold_pairs").filter((F.size("claims") > 0) & (F.size(F.get("claims", 0)["supporting_spans"]) > 0) & (F.col("difficulty") != "unanswerable")).select("id").distinct()


@analysis.query("error_lines", "SELECT id, '::error file=' || coalesce(member_file, '?') || '::' || id || ' has ' || coalesce(len(claims), 0) || ' claims' AS line FROM gold_pairs")
def error_lines(spark, sf_dir):
    return table(spark, sf_dir, "gold_pairs").select("id", F.format_string("::error file=%s::%s has %d claims", F.coalesce("member_file", F.lit("?")), "id", F.coalesce(F.size("claims"), F.lit(0))).alias("line"))


@analysis.query("span_allowlist", "SELECT DISTINCT s.paper_id FROM (SELECT unnest(c.supporting_spans) AS s FROM (SELECT unnest(claims) AS c FROM gold_pairs)) WHERE s.paper_id NOT IN (SELECT DISTINCT paper_id FROM parsed_elements WHERE paper_id IS NOT NULL)")
def span_allowlist(spark, sf_dir):
    """Cited papers that are not among the allowed ones."""
    allowed = table(spark, sf_dir, "parsed_elements").select("paper_id").distinct()
    return G.spans(table(spark, sf_dir, "gold_pairs")).select("paper_id").distinct().join(allowed, "paper_id", "left_anti")


# ---- faithfulness ---------------------------------------------------------------------------
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"
_VERIFIED = f"""WITH c AS (SELECT DISTINCT id, c.id AS claim_id, c.text AS claim, difficulty AS model, CASE WHEN len(c.supporting_spans) = 0 OR id LIKE '%3' THEN NULL WHEN id LIKE '%4' THEN 'made_up' ELSE c.supporting_spans[1].paper_id END AS src
  FROM (SELECT id, difficulty, unnest(claims) AS c FROM gold_pairs)),
d AS (SELECT paper_id, text AS passage FROM documents WHERE paper_id IS NOT NULL),
v AS (SELECT c.*, CASE WHEN src IS NULL THEN 'no_citation' WHEN d.paper_id IS NULL THEN 'fabricated_source' WHEN passage IS NULL THEN 'not_supported'
  WHEN len(list_intersect({_WORDS.format("claim")}, {_WORDS.format("passage")})) / greatest(len({_WORDS.format("claim")}), 1) > 0.5 THEN 'supported' ELSE 'not_supported' END AS label FROM c LEFT JOIN d ON d.paper_id = c.src)"""


def _verified(spark, sf_dir):
    c = table(spark, sf_dir, "gold_pairs").select("id", "difficulty", F.explode("claims").alias("c"))
    source = F.when((F.size("c.supporting_spans") == 0) | F.col("id").endswith("3"), F.lit(None)).when(F.col("id").endswith("4"), "made_up").otherwise(F.get("c.supporting_spans", 0)["paper_id"])
    claims = c.select("id", F.col("c.id").alias("claim_id"), F.col("c.text").alias("claim"), F.col("difficulty").alias("model"), source.alias("cited_source_id")).distinct()
    sources = table(spark, sf_dir, "documents").filter("paper_id is not null").select(F.col("paper_id").alias("source_id"), F.col("text").alias("passage"))
    return V.verify(claims, sources)


@analysis.query("verify_labels", _VERIFIED + " SELECT id, claim_id, claim, label FROM v")
def verify_labels(spark, sf_dir):
    return _verified(spark, sf_dir).select("id", "claim_id", "claim", "label")


_RATIOS = ", ".join(f"round(count(*) FILTER (WHERE label = '{x}') / count(*), 6) AS {x}_ratio" for x in V.LABELS)


@analysis.query("faithfulness_ratios", _VERIFIED + f" SELECT id, count(*) AS total_claims, {_RATIOS} FROM v GROUP BY 1")
def faithfulness_ratios(spark, sf_dir):
    return _round(V.ratios(_verified(spark, sf_dir), ["id"]), *[f"{x}_ratio" for x in V.LABELS])


@analysis.query("per_model_gap", _VERIFIED + " SELECT model, round(avg(s), 6) AS strict, round(avg(l), 6) AS lenient, round(avg(l) - avg(s), 6) AS gap FROM (SELECT model, id, avg((label = 'supported')::INTEGER) AS s, avg((label <> 'fabricated_source')::INTEGER) AS l FROM v GROUP BY ALL) GROUP BY 1")
def per_model_gap(spark, sf_dir):
    """Two verifiers' mean scores per model and what lies between them."""
    per = _verified(spark, sf_dir).groupBy("model", "id").agg(F.avg((F.col("label") == "supported").cast("int")).alias("s"), F.avg((F.col("label") != "fabricated_source").cast("int")).alias("l"))
    out = per.groupBy("model").agg(F.avg("s").alias("strict"), F.avg("l").alias("lenient"), (F.avg("l") - F.avg("s")).alias("gap"))
    return _round(out, "strict", "lenient", "gap")


@analysis.query(
    "corrective_rounds",
    """WITH r1 AS (SELECT vec_id AS query_id, abs(embedding[1])::DOUBLE AS c FROM embeddings), q AS (SELECT query_id, c, abs(c * 1.5) AS c2, abs(c * 2.25) AS c3 FROM r1)
SELECT query_id, CASE WHEN c >= 0.2 OR c < 0.05 THEN 1 WHEN c2 >= 0.2 OR c2 < 0.05 THEN 2 ELSE 3 END AS rounds, CASE WHEN c >= 0.2 THEN 'correct' WHEN c < 0.05 THEN 'incorrect' WHEN c2 >= 0.2 OR c3 >= 0.2 THEN 'correct' ELSE 'ambiguous' END AS quality FROM q""",
)
def corrective_rounds(spark, sf_dir):
    """The size of a vector's first component stands for a judge; refining raises it by half."""
    q = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.abs(F.get("embedding", 0).cast("double")).alias("c"))
    out = V.corrective(q, lambda df: df, F.col("c"), lambda df: df.select("query_id", (F.col("c") * 1.5).alias("c")), 0.2, 0.05)
    return out.select("query_id", "rounds", "quality")


# ---- operations -----------------------------------------------------------------------------
@analysis.query("unprocessed_anti_join", "SELECT DISTINCT paper_id FROM documents WHERE paper_id IS NOT NULL AND paper_id NOT IN (SELECT paper_id FROM chunks WHERE paper_id IS NOT NULL AND chunk_type = 'coarse')")
def unprocessed_anti_join(spark, sf_dir):
    done = table(spark, sf_dir, "chunks").filter("chunk_type = 'coarse'").select("paper_id").distinct()
    return table(spark, sf_dir, "documents").filter("paper_id is not null").select("paper_id").distinct().join(done, "paper_id", "left_anti")


@analysis.query("round_robin_shard", "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 7)::INTEGER AS worker FROM documents")
def round_robin_shard(spark, sf_dir):
    from vellumine.functions.numbering import with_row_number

    rows = with_row_number(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "n")
    return rows.select("doc_id", (F.col("n") % 7).cast("int").alias("worker"))


@analysis.query(
    "hourly_activity",
    "WITH m AS (SELECT max(ts) AS t FROM events) SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events, m WHERE ts > t - INTERVAL 24 HOUR GROUP BY 1 ORDER BY 1 DESC LIMIT 12",
)
def hourly_activity(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    newest = e.agg(F.max("ts").alias("t"))
    day = e.crossJoin(F.broadcast(newest)).filter("ts > t - interval 24 hours")  # newest is one row
    return day.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n")).orderBy(F.desc("hour")).limit(12)


@analysis.query("hourly_rate", "WITH m AS (SELECT max(ts) AS t FROM events), h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events, m WHERE ts > t - INTERVAL 24 HOUR GROUP BY 1 ORDER BY 1 DESC LIMIT 3) SELECT round(avg(n), 6) AS per_hour, round(1000 / avg(n), 6) AS hours_for_1000 FROM h")
def hourly_rate(spark, sf_dir):
    h = hourly_activity(spark, sf_dir).orderBy(F.desc("hour")).limit(3)
    return h.agg(F.round(F.avg("n"), 6).alias("per_hour"), F.round(1000 / F.avg("n"), 6).alias("hours_for_1000"))


@analysis.query("newest_per_user", "SELECT user_id, max(ts) AS newest, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def newest_per_user(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("newest"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@analysis.query("subtotal_rollup", "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping(source) + grouping(lang) AS level FROM documents GROUP BY ROLLUP (source, lang)")
def subtotal_rollup(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), (F.grouping("source").cast("long") + F.grouping("lang")).alias("level"))


@analysis.query("batch_totals", "SELECT count(*) AS papers, count(*) FILTER (WHERE n_coarse = 0) AS failed, sum(n_coarse)::BIGINT AS coarse, sum(n_fine)::BIGINT AS fine FROM (SELECT paper_id, count(*) FILTER (WHERE chunk_type = 'coarse') AS n_coarse, count(*) FILTER (WHERE chunk_type = 'fine') AS n_fine FROM chunks GROUP BY 1)")
def batch_totals(spark, sf_dir):
    per = table(spark, sf_dir, "chunks").groupBy("paper_id").agg(F.count_if(F.col("chunk_type") == "coarse").alias("c"), F.count_if(F.col("chunk_type") == "fine").alias("f"))
    return per.agg(F.count("*").alias("papers"), F.count_if(F.col("c") == 0).alias("failed"), F.sum("c").alias("coarse"), F.sum("f").alias("fine"))


@analysis.query("download_states", "SELECT CASE WHEN all_pdf_urls IS NULL OR trim(all_pdf_urls) = '' THEN 'no_url' WHEN has_any_pdf THEN 'found' ELSE 'failed' END AS state, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM flat_works GROUP BY 1")
def download_states(spark, sf_dir):
    w = table(spark, sf_dir, "flat_works")
    state = F.when(F.col("all_pdf_urls").isNull() | (F.trim("all_pdf_urls") == ""), "no_url").when(F.col("has_any_pdf"), "found").otherwise("failed")
    counts = w.groupBy(state.alias("state")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # one row per state


_PRICES = {"text-small": 0.02, "text-large": 0.13}


@analysis.query("token_cost_estimate", "SELECT coalesce(lang, '?') AS lang, sum(length(text) // 4)::BIGINT AS n_tokens, round(sum(length(text) // 4) / 1000000.0 * CASE coalesce(lang, '?') WHEN 'en' THEN 0.02 WHEN 'de' THEN 0.13 ELSE 0.10 END, 9) AS cost FROM documents GROUP BY 1")
def token_cost_estimate(spark, sf_dir):
    """Estimated tokens and their price per million, with a default for what has none."""
    from vellumine.functions.text import token_estimate

    prices = F.create_map(F.lit("en"), F.lit(0.02), F.lit("de"), F.lit(0.13))
    rows = table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.sum(token_estimate("text")).alias("n_tokens"))
    return rows.withColumn("cost", F.round(F.col("n_tokens") / 1e6 * F.coalesce(F.try_element_at(prices, F.col("lang")), F.lit(0.10)), 9))


@analysis.query("config_matrix", "SELECT e || '_' || g || CASE WHEN r THEN '_rerank' ELSE '_flat' END AS config, CASE WHEN e = 'a' THEN g ELSE e || '_' || g END AS index_name FROM (VALUES ('a'), ('b'), ('c'), ('d')) x(e), (VALUES ('coarse'), ('fine')) y(g), (VALUES (true), (false)) z(r)")
def config_matrix(spark, sf_dir):
    e, g, r = F.array(*map(F.lit, "abcd")), F.array(F.lit("coarse"), F.lit("fine")), F.array(F.lit(True), F.lit(False))
    m = spark.range(1).select(F.explode(e).alias("e")).select("e", F.explode(g).alias("g")).select("e", "g", F.explode(r).alias("r"))
    return m.select(F.concat("e", F.lit("_"), "g", F.when(F.col("r"), "_rerank").otherwise("_flat")).alias("config"), F.when(F.col("e") == "a", F.col("g")).otherwise(F.concat_ws("_", "e", "g")).alias("index_name"))


@analysis.query("offset_slice", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50 OFFSET 20")
def offset_slice(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").offset(20).limit(50)


@analysis.query("hash_sample", "SELECT doc_id FROM documents ORDER BY md5('7' || doc_id), doc_id LIMIT 20")
def hash_sample(spark, sf_dir):
    """A repeatable sample without replacement."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("7"), F.col("doc_id").cast("string"))), "doc_id").limit(20)


@analysis.query("paper_ids", "SELECT DISTINCT regexp_extract(chunk_id, '^(.*)_(coarse|fine)_[0-9]+$', 1) AS paper_id FROM chunks")
def paper_ids(spark, sf_dir):
    return table(spark, sf_dir, "chunks").select(F.regexp_extract("chunk_id", r"^(.*)_(coarse|fine)_[0-9]+$", 1).alias("paper_id")).distinct()


@analysis.query("document_metadata", "SELECT d.paper_id, d.doc_id, w.title, w.publication_year FROM documents d JOIN (SELECT DISTINCT openalex_id, title, publication_year FROM flat_works) w ON w.openalex_id = string_split(d.paper_id, '_')[2]")
def document_metadata(spark, sf_dir):
    works = table(spark, sf_dir, "flat_works").select("openalex_id", "title", "publication_year").distinct()
    docs = table(spark, sf_dir, "documents").filter("paper_id is not null").withColumn("openalex_id", F.get(F.split("paper_id", "_"), 1))
    return docs.join(works, "openalex_id").select("paper_id", "doc_id", "title", "publication_year")


@analysis.query("progress_eta", "SELECT event_id, n, (total - n) * (epoch_us(ts) - epoch_us(t0)) // n AS eta_us FROM (SELECT event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total, min(ts) OVER (PARTITION BY user_id) AS t0 FROM events)")
def progress_eta(spark, sf_dir):
    """For each event of a user the time the user's other events will take at the pace so far."""
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.row_number().over(w.orderBy("ts", "event_id")).alias("n"), F.count("*").over(w).alias("total"), F.min("ts").over(w).alias("t0"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return e.select("event_id", F.col("n").cast("long").alias("n"), F.expr("(total - n)").alias("left"), (micros("ts") - micros("t0")).alias("us")).select("event_id", "n", F.expr("left * us div n").alias("eta_us"))


@analysis.query("formatted_metrics", "SELECT label, coalesce(printf('%.3f', CASE WHEN label % 2 = 0 THEN round(avg(embedding[1]), 5) END), '—') AS cell FROM embeddings GROUP BY 1")
def formatted_metrics(spark, sf_dir):
    m = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.avg(F.get("embedding", 0).cast("double")), 5).alias("m"))
    return m.select("label", F.coalesce(F.when(F.col("label") % 2 == 0, F.format_string("%.3f", "m")), F.lit("—")).alias("cell"))

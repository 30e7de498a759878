"""Queries over nested and packed records (problems 1 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators.nested import child_paths, nested_to_flat
from vellumine.operators.packed import split_packed
from vellumine.plans.registry import Registry
from vellumine.sources.tables import table

records = Registry()

_LATEST = """
WITH parsed AS (
  SELECT openalex_id, harvested_at, loaded_at, row_id, CASE WHEN json_valid(record) THEN record::JSON END AS j
  FROM raw_works WHERE openalex_id IS NOT NULL),
unwrapped AS (
  SELECT openalex_id, harvested_at, loaded_at, row_id,
    CASE WHEN json_extract_string(j, '$.id') IS NOT NULL THEN j
         WHEN json_type(j, '$.results') = 'OBJECT' THEN json_extract(j, '$.results')
         WHEN json_type(j, '$.results[0]') = 'OBJECT' THEN json_extract(j, '$.results[0]')
         WHEN json_type(j, '$.work') = 'OBJECT' THEN json_extract(j, '$.work')
         WHEN json_type(j, '$.work[0]') = 'OBJECT' THEN json_extract(j, '$.work[0]')
         ELSE j END AS w
  FROM parsed WHERE json_type(j) = 'OBJECT'),
latest AS (
  SELECT openalex_id, w FROM unwrapped
  QUALIFY row_number() OVER (PARTITION BY openalex_id ORDER BY harvested_at DESC NULLS LAST, loaded_at DESC NULLS LAST, row_id DESC) = 1),
raw_parts AS (
  SELECT openalex_id, w,
    CASE WHEN json_type(w, '$.locations') = 'VARCHAR' THEN json_extract_string(w, '$.locations')::JSON ELSE json_extract(w, '$.locations') END AS l,
    CASE WHEN json_type(w, '$.authorships') = 'VARCHAR' THEN json_extract_string(w, '$.authorships')::JSON ELSE json_extract(w, '$.authorships') END AS a
  FROM latest),
parts AS (
  SELECT openalex_id, w,
    CASE json_type(l) WHEN 'ARRAY' THEN json_extract(l, '$[*]') WHEN 'OBJECT' THEN [l] ELSE [] END AS l,
    CASE json_type(a) WHEN 'ARRAY' THEN json_extract(a, '$[*]') WHEN 'OBJECT' THEN [a] ELSE [] END AS a
  FROM raw_parts),
loc AS (
  SELECT openalex_id, i - 1 AS i, v FROM (SELECT openalex_id, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM parts) WHERE json_type(v) = 'OBJECT'),
aut AS (
  SELECT openalex_id, i - 1 AS i, v FROM (SELECT openalex_id, unnest(a) AS v, generate_subscripts(a, 1) AS i FROM parts) WHERE json_type(v) = 'OBJECT'),
inst_parts AS (
  SELECT openalex_id, i, CASE json_type(v, '$.institutions') WHEN 'ARRAY' THEN json_extract(v, '$.institutions[*]')
                              WHEN 'OBJECT' THEN [json_extract(v, '$.institutions')] ELSE [] END AS t FROM aut),
ins AS (
  SELECT openalex_id, i, j - 1 AS j, v FROM (SELECT openalex_id, i, unnest(t) AS v, generate_subscripts(t, 1) AS j FROM inst_parts)
  WHERE coalesce(json_type(v), 'NULL') <> 'NULL')
"""


@records.query(
    "p1_found",
    _LATEST
    + """
SELECT openalex_id, 'location' AS child_kind, i::VARCHAR AS child_path FROM loc
UNION ALL SELECT openalex_id, 'source', i::VARCHAR FROM loc WHERE coalesce(json_type(v, '$.source'), 'NULL') <> 'NULL'
UNION ALL SELECT openalex_id, 'authorship', i::VARCHAR FROM aut
UNION ALL SELECT openalex_id, 'institution', i || '.' || j FROM ins""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return child_paths(table(spark, sf_dir, "raw_works"))


def _flat(name: str):
    return lambda spark, sf_dir: nested_to_flat(table(spark, sf_dir, "raw_works"))[name]


records.query(
    "p1_location",
    _LATEST
    + """
SELECT openalex_id, i::INTEGER AS location_index, v->>'$.pdf_url' AS pdf_url, v->>'$.landing_page_url' AS landing_page_url,
  CAST(v->>'$.is_oa' AS BOOLEAN) AS is_oa, v->>'$.license' AS license, v->>'$.version' AS version FROM loc""",
)(_flat("location"))

records.query(
    "p1_source",
    _LATEST
    + """
SELECT openalex_id, i::INTEGER AS location_index, v->>'$.source.id' AS source_id,
  CASE WHEN json_type(v, '$.source') = 'OBJECT' THEN v->>'$.source.display_name' ELSE v->>'$.source' END AS display_name,
  v->>'$.source.type' AS source_type, v->>'$.source.issn_l' AS issn_l, v->>'$.source.host_organization' AS host_organization
FROM loc WHERE coalesce(json_type(v, '$.source'), 'NULL') <> 'NULL'""",
)(_flat("source"))

records.query(
    "p1_authorship",
    _LATEST
    + """
SELECT openalex_id, i::INTEGER AS authorship_index,
  CASE WHEN json_type(v, '$.author') = 'OBJECT' THEN v->>'$.author.display_name' ELSE v->>'$.author' END AS author,
  v->>'$.author.id' AS author_id, v->>'$.author.orcid' AS orcid, v->>'$.author_position' AS author_position,
  v->>'$.raw_affiliation_string' AS raw_affiliation FROM aut""",
)(_flat("authorship"))

records.query(
    "p1_institution",
    _LATEST
    + """
SELECT openalex_id, i::INTEGER AS authorship_index, j::INTEGER AS institution_index, v->>'$.id' AS institution_id,
  CASE WHEN json_type(v) = 'OBJECT' THEN v->>'$.display_name' ELSE v->>'$' END AS display_name, v->>'$.country_code' AS country_code FROM ins""",
)(_flat("institution"))

records.query(
    "p1_work",
    _LATEST
    + """
SELECT openalex_id, w->>'$.doi' AS doi, coalesce(w->>'$.title', w->>'$.display_name') AS title, CAST(w->>'$.publication_year' AS INTEGER) AS publication_year,
  w->>'$.type' AS work_type, w->>'$.language' AS lang, w->>'$.primary_topic.display_name' AS topic, CAST(w->>'$.cited_by_count' AS INTEGER) AS cited_by_count
FROM latest""",
)(_flat("work"))


@records.query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_packed(table(spark, sf_dir, "flat_works"), "openalex_id", ["author_names", "all_pdf_urls"]).drop("dialect").distinct()


@records.query("p5_dialects")
def p5_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_packed(table(spark, sf_dir, "flat_works"), "openalex_id", ["author_names", "all_pdf_urls"])
    return rows.groupBy("field_name", "dialect").agg(F.count("*").alias("n_values"), F.countDistinct("openalex_id").alias("n_fields"))

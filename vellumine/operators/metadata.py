"""Nested works to the wide flat row, and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.operators.nested import as_array, is_object, latest_readable, plain_or


def _t(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _var(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _flag(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False))


def _place(w: Column, name: str, prefix: str) -> list[Column]:
    source = _var(w, f"$.{name}.source")
    return [
        _t(w, f"$.{name}.pdf_url").alias(f"{prefix}_pdf_url"),
        _t(w, f"$.{name}.landing_page_url").alias(f"{prefix}_landing_page"),
        _t(w, f"$.{name}.version").alias(f"{prefix}_version"),
        _t(w, f"$.{name}.license").alias(f"{prefix}_license"),
        F.when(source.isNotNull() & ~F.is_variant_null(source), plain_or(source, "$.display_name")).alias(f"{prefix}_source"),
        _t(w, f"$.{name}.source.type").alias(f"{prefix}_source_type"),
    ]


def flatten_works(works: DataFrame, key: str = "openalex_id", record: str = "record") -> DataFrame:
    """One wide row per work: lists joined by ``|``, PDF URLs in the order best, primary, others, the
    first three concepts, null flags as false. Empty lists give null."""
    base = latest_readable(works, key, record)
    w = F.col("work")
    base = base.select(key, w, as_array(_var(w, "$.locations")).alias("_l"), as_array(_var(w, "$.authorships")).alias("_a"), as_array(_var(w, "$.concepts")).alias("_c"), as_array(_var(w, "$.keywords")).alias("_k"))
    loc = F.transform(F.filter("_l", is_object), lambda v: F.struct(_t(v, "$.pdf_url").alias("pdf"), _flag(v, "$.is_oa").alias("is_oa")))
    author = F.transform(F.filter("_a", is_object), lambda v: plain_or(_var(v, "$.author"), "$.display_name"))
    concept = F.transform(F.filter("_c", is_object), lambda v: F.struct(_t(v, "$.display_name").alias("name"), F.try_variant_get(v, "$.score", "double").alias("score")))
    keyword = F.transform("_k", lambda v: plain_or(v, "$.display_name"))
    base = base.select(key, "work", loc.alias("loc"), author.alias("author"), concept.alias("concept"), keyword.alias("keyword"))

    real = lambda u: u.isNotNull() & (u != "")
    best, primary = _t(w, "$.best_oa_location.pdf_url"), _t(w, "$.primary_location.pdf_url")
    urls = F.array_distinct(F.filter(F.concat(F.array(best, primary), F.transform("loc", lambda x: x["pdf"])), real))
    names = F.filter("author", real)
    joined = lambda a: F.when(F.size(a) > 0, F.array_join(a, "|"))
    oa = F.get(F.filter("loc", lambda x: x["is_oa"] & real(x["pdf"])), 0)["pdf"]
    topic = F.element_at(F.split(_t(w, "$.primary_topic.id"), "/"), -1)
    concepts = [c for i in range(3) for c in (F.get("concept", i)["name"].alias(f"concept_{i + 1}_name"), F.get("concept", i)["score"].alias(f"concept_{i + 1}_score"))]
    return base.select(
        F.col(key), _t(w, "$.id").alias("id"), _t(w, "$.doi").alias("doi"), F.coalesce(F.nullif(_t(w, "$.title"), F.lit("")), _t(w, "$.display_name")).alias("title"),
        F.try_variant_get(w, "$.publication_year", "int").alias("publication_year"), _t(w, "$.publication_date").alias("publication_date"), _t(w, "$.type").alias("work_type"), _t(w, "$.language").alias("lang"),
        _flag(w, "$.open_access.is_oa").alias("is_oa"), _t(w, "$.open_access.oa_status").alias("oa_status"), _flag(w, "$.open_access.any_repository_has_fulltext").alias("any_repository_has_fulltext"),
        *_place(w, "best_oa_location", "best_oa"), *_place(w, "primary_location", "primary"),
        F.size("loc").alias("num_locations"), F.size(urls).alias("num_pdf_urls"), F.size(F.filter("loc", lambda x: x["is_oa"])).alias("num_oa_locations"), joined(urls).alias("all_pdf_urls"), (F.size(urls) > 0).alias("has_any_pdf"),
        F.coalesce(F.nullif(best, F.lit("")), F.nullif(primary, F.lit("")), oa).alias("best_pdf_url"),
        topic.alias("topic_id"), _t(w, "$.primary_topic.display_name").alias("topic_name"), _t(w, "$.primary_topic.subfield.display_name").alias("topic_subfield"), _t(w, "$.primary_topic.field.display_name").alias("topic_field"), _t(w, "$.primary_topic.domain.display_name").alias("topic_domain"),
        F.size("author").alias("num_authors"), F.get(names, 0).alias("first_author"), joined(names).alias("author_names"), *concepts, joined(F.filter("keyword", real)).alias("keywords"),
        F.try_variant_get(w, "$.cited_by_count", "int").alias("cited_by_count"), _flag(w, "$.is_retracted").alias("is_retracted"), _flag(w, "$.is_paratext").alias("is_paratext"),
    )


def corpus_summary(works: DataFrame) -> DataFrame:
    """One row of counts over flat works."""
    n = lambda c: F.count(c)
    return works.agg(
        F.count("*").alias("total_works"), F.count_if("has_any_pdf").alias("works_with_pdf"), F.count_if(~F.col("has_any_pdf")).alias("works_without_pdf"), n("best_oa_pdf_url").alias("works_with_best_oa_pdf"), n("primary_pdf_url").alias("works_with_primary_pdf"),
        n("doi").alias("with_doi"), F.min("publication_year").alias("min_year"), F.max("publication_year").alias("max_year"), F.avg("publication_year").alias("mean_year"),
        F.sum("cited_by_count").alias("total_citations"), F.avg("cited_by_count").alias("mean_citations"), F.median("cited_by_count").alias("median_citations"), F.max("cited_by_count").alias("max_citations"),
    )


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """``(value, n)`` of the non-null values, most frequent first; ties by value."""
    out = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), "value").limit(top)


def parse_filters(c: Column) -> Column:
    """``k:v,k:v`` as a map; parts without a colon are dropped, only the first colon separates, both sides are trimmed; of a repeated key the last counts."""
    parts = F.filter(F.split(c, ","), lambda p: p.contains(":"))
    entries = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["key"] == e["key"]))
    return F.map_from_entries(last)

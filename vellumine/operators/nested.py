"""Nested work records to related flat tables.

A record is parsed once into a variant. Parts whose shape varies (an array, a single object in
its place, or either of them as JSON text) become arrays of variants; nested ``transform`` calls
then attach the ancestors' keys and indices, ``flatten`` joins the arrays of one level, and one
``inline`` per target table emits its rows. No level needs a shuffle: the only exchange is the
choice of each work's latest readable version, and that is limited map-side before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where a record may be wrapped: an object under this key, or the first object of a list under it.
WRAPPERS = ("work", "results")


def parse_work(parsed: Column) -> Column:
    """The work object in a parsed record, unwrapped where it lies under one of ``WRAPPERS``.

    Null where the record holds no object: null, blank or cut-off text parses to null, and valid
    JSON that is no object (``null``, a number, an array) is no work.
    """
    best = F.when(is_object(parsed), parsed)
    for name in WRAPPERS:
        inner, first = F.try_variant_get(parsed, f"$.{name}", "variant"), F.try_variant_get(parsed, f"$.{name}[0]", "variant")
        best = F.when(is_object(inner), inner).when(is_object(first), first).otherwise(best)
    return F.when(F.try_variant_get(parsed, "$.id", "string").isNotNull(), parsed).otherwise(best)


def is_object(v: Column) -> Column:
    """Whether a variant is an object. (The cast fails on all else and, unlike ``schema_of_variant``,
    does not walk the whole tree.)"""
    return F.try_variant_get(v, "$", "struct<id:variant>").isNotNull()


def as_array(v: Column) -> Column:
    """A variant as ``array<variant>``: arrays as they are, an object as its only element, JSON text
    of either parsed first. Anything else (null, numbers, plain text) is an empty array."""
    text = F.try_parse_json(F.try_variant_get(v, "$", "string"))
    return F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"),
        F.when(is_object(v), F.array(v)),
        F.try_variant_get(text, "$", "array<variant>"),
        F.when(is_object(text), F.array(text)),
        F.array().cast("array<variant>"),
    )


def plain_or(v: Column, path: str) -> Column:
    """A field of an object, or the value itself where a plain text stands for the object."""
    return F.when(is_object(v), F.try_variant_get(v, path, "string")).otherwise(F.try_variant_get(v, "$", "string"))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def latest_readable(
    works: DataFrame, key: str = "openalex_id", record: str = "record", order: tuple[str, ...] = ("harvested_at", "loaded_at", "row_id")
) -> DataFrame:
    """``(key, work)``: for each key the readable record that is last in ``order``.

    Rows with a null key are left out, as they belong to no work. Nulls in ``order`` come first,
    so any dated version beats an undated one; full ties are broken by a hash of the record. The
    window keeps one row per key in every map task before the shuffle, so a key with a third of
    the rows sends one row per task.
    """
    order = tuple(c for c in order if c in works.columns)
    rows = works.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.try_parse_json(record).alias("_v"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.xxhash64(record).alias("_h")
    )
    # unreadable rows are ranked last and dropped after the window: a filter here would be pushed below the parse and parse twice
    last = Window.partitionBy("_key").orderBy(is_object(F.col("_v")).desc(), *[F.col(f"_o{i}").desc_nulls_last() for i in range(len(order))], "_h")
    rows = rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select(F.col("_key").alias(key), parse_work(F.col("_v")).alias("work"))
    return rows.filter(F.col("work").isNotNull())


def _levels(df: DataFrame, key: str, attributes: bool = True) -> DataFrame:
    """One array column per target table, each element with the key and the indices of its ancestors.
    Without ``attributes`` only these, for callers that need the places alone."""
    own = lambda *fields: fields if attributes else ()
    work = df.withColumnRenamed("work", "_w")
    work = work.select(key, "_w", as_array(_field(F.col("_w"), "$.locations")).alias("_l"), as_array(_field(F.col("_w"), "$.authorships")).alias("_a"))
    real = lambda v: v.isNotNull() & ~F.is_variant_null(v)

    locations = F.transform(
        "_l",
        lambda v, i: F.when(
            is_object(v),
            F.struct(
                F.col(key).alias(key),
                i.cast("int").alias("location_index"),
                *own(
                    _text(v, "$.pdf_url").alias("pdf_url"),
                    _text(v, "$.landing_page_url").alias("landing_page_url"),
                    F.try_variant_get(v, "$.is_oa", "boolean").alias("is_oa"),
                    _text(v, "$.license").alias("license"),
                    _text(v, "$.version").alias("version"),
                ),
                _field(v, "$.source").alias("_source"),
            ),
        ),
    )
    authorships = F.transform(
        "_a",
        lambda v, i: F.when(
            is_object(v),
            F.struct(
                F.col(key).alias(key),
                i.cast("int").alias("authorship_index"),
                *own(
                    plain_or(_field(v, "$.author"), "$.display_name").alias("author"),
                    _text(v, "$.author.id").alias("author_id"),
                    _text(v, "$.author.orcid").alias("orcid"),
                    _text(v, "$.author_position").alias("author_position"),
                    _text(v, "$.raw_affiliation_string").alias("raw_affiliation"),
                ),
                as_array(_field(v, "$.institutions")).alias("_institutions"),
            ),
        ),
    )
    work = work.select(key, "_w", F.filter(locations, lambda x: x.isNotNull()).alias("location"), F.filter(authorships, lambda x: x.isNotNull()).alias("authorship"))
    source = F.transform(
        F.filter("location", lambda x: real(x["_source"])),
        lambda x: F.struct(
            x[key].alias(key),
            x["location_index"].alias("location_index"),
            *own(
                _text(x["_source"], "$.id").alias("source_id"),
                plain_or(x["_source"], "$.display_name").alias("display_name"),
                _text(x["_source"], "$.type").alias("source_type"),
                _text(x["_source"], "$.issn_l").alias("issn_l"),
                _text(x["_source"], "$.host_organization").alias("host_organization"),
            ),
        ),
    )
    institution = F.flatten(
        F.transform(
            "authorship",
            lambda x: F.filter(
                F.transform(
                    x["_institutions"],
                    lambda v, j: F.when(
                        real(v),
                        F.struct(
                            x[key].alias(key),
                            x["authorship_index"].alias("authorship_index"),
                            j.cast("int").alias("institution_index"),
                            *own(
                                _text(v, "$.id").alias("institution_id"),
                                plain_or(v, "$.display_name").alias("display_name"),
                                _text(v, "$.country_code").alias("country_code"),
                            ),
                        ),
                    ),
                ),
                lambda y: y.isNotNull(),
            ),
        )
    )
    return work.select(key, "_w", "location", source.alias("source"), "authorship", institution.alias("institution"))


def nested_to_flat(works: DataFrame, key: str = "openalex_id", record: str = "record") -> dict[str, DataFrame]:
    """The tables ``work``, ``location``, ``source``, ``authorship`` and ``institution``.

    Every child row holds the work's key and the 0-based index of each ancestor: a location and its
    source share ``location_index``, an institution has its authorship's index and its own. Null
    elements count for the index and give no row. An empty input gives five empty tables; extra
    columns of the input are ignored whatever their names.
    """
    base = _levels(latest_readable(works, key, record), key)
    work = base.select(
        key,
        _text(F.col("_w"), "$.doi").alias("doi"),
        F.coalesce(_text(F.col("_w"), "$.title"), _text(F.col("_w"), "$.display_name")).alias("title"),
        F.try_variant_get("_w", "$.publication_year", "int").alias("publication_year"),
        _text(F.col("_w"), "$.type").alias("work_type"),
        _text(F.col("_w"), "$.language").alias("lang"),
        _text(F.col("_w"), "$.primary_topic.display_name").alias("topic"),
        F.try_variant_get("_w", "$.cited_by_count", "int").alias("cited_by_count"),
    )
    return {
        "work": work,
        "location": base.select(F.inline("location")).drop("_source"),
        "source": base.select(F.inline("source")),
        "authorship": base.select(F.inline("authorship")).drop("_institutions"),
        "institution": base.select(F.inline("institution")),
    }


def child_paths(works: DataFrame, key: str = "openalex_id", record: str = "record") -> DataFrame:
    """``(key, child_kind, child_path)`` of every object of the four child tables, in one pass."""
    base = _levels(latest_readable(works, key, record), key, attributes=False)
    at = lambda kind, path: F.struct(F.lit(kind).alias("child_kind"), path.alias("child_path"))
    paths = F.concat(
        F.transform("location", lambda x: at("location", x["location_index"].cast("string"))),
        F.transform("source", lambda x: at("source", x["location_index"].cast("string"))),
        F.transform("authorship", lambda x: at("authorship", x["authorship_index"].cast("string"))),
        F.transform("institution", lambda x: at("institution", F.concat_ws(".", x["authorship_index"].cast("string"), x["institution_index"].cast("string")))),
    )
    return base.select(key, F.inline(paths))

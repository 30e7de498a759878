"""Records checked, rebuilt and selected: what stands between a harvest and its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a field of a work may be, beside null or missing.
WORK_FIELDS = {"title": ("STRING",), "publication_year": ("BIGINT",), "cited_by_count": ("BIGINT",), "doi": ("STRING",), "is_retracted": ("BOOLEAN",)}


def record_errors(record: Column, fields: dict[str, tuple[str, ...]] = WORK_FIELDS) -> Column:
    """Every rule that a JSON record breaks, an empty array for a sound one; null and unreadable records break the first."""
    whole = F.try_variant_get(F.try_parse_json(record), "$", "map<string,variant>")
    kind = lambda v: F.schema_of_variant(v)
    at = lambda f: F.try_element_at(whole, F.lit(f))
    rules = [F.when(F.coalesce(kind(at("id")) != "STRING", F.lit(True)), "id is missing")]
    for f, kinds in fields.items():
        rules.append(F.when(~F.coalesce(kind(at(f)), F.lit("VOID")).isin("VOID", *kinds), f"{f} has a wrong type"))
    return F.when(whole.isNull(), F.array(F.lit("no object"))).otherwise(F.array_compact(F.array(*rules)))


def validated(rows: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """``(sound rows, rejected rows with their errors)``: one check per row, no row is lost."""
    checked = rows.withColumn("errors", errors)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def filter_predicate(df: DataFrame, text: str) -> Column:
    """``k:v,k:v`` as one predicate on the columns, each value cast to its column's type so that the scan can apply it.

    ``|`` separates alternatives, a leading ``!`` negates. An unknown key is an error; parts without a colon are dropped.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    out = F.lit(True)
    for part in text.split(","):
        if ":" not in part:
            continue
        key, _, value = (x.strip() for x in part.partition(":"))
        if key not in kinds:
            raise ValueError(f"no column {key}")
        negated = value.startswith("!")
        one = F.col(key).isin(*[F.lit(v).cast(kinds[key]) for v in value.lstrip("!").split("|")])
        out = out & (~one if negated else one)
    return out


_SOURCE = "struct<display_name: string, type: string>"
_PLACE = f"struct<is_oa: boolean, pdf_url: string, source: {_SOURCE}>"
WORK = f"struct<id: string, doi: string, title: string, publication_year: int, type: string, open_access: struct<is_oa: boolean, oa_status: string, any_repository_has_fulltext: boolean>, best_oa_location: {_PLACE}, primary_location: {_PLACE}, cited_by_count: int, is_retracted: boolean, is_paratext: boolean, language: string>"


def rehydrated(flat: DataFrame) -> Column:
    """The nested work of a flat row: from ``full_json`` where the row has a readable one, else from the flat columns.

    A location is there where it has a PDF, its source where that has a name; null flags are false, a null count is 0.
    """
    no = lambda c: F.coalesce(c, F.lit(False))

    def place(prefix: str, is_oa: Column) -> Column:
        source = F.when(F.col(f"{prefix}_source").isNotNull(), F.struct(F.col(f"{prefix}_source").alias("display_name"), F.col(f"{prefix}_source_type").alias("type")))
        return F.when(F.col(f"{prefix}_pdf_url").isNotNull(), F.struct(is_oa.alias("is_oa"), F.col(f"{prefix}_pdf_url").alias("pdf_url"), source.alias("source")))

    rebuilt = F.struct(
        F.coalesce("id", "openalex_url").alias("id"), "doi", "title", "publication_year", F.col("work_type").alias("type"),
        F.struct(no("is_oa").alias("is_oa"), "oa_status", no("any_repository_has_fulltext").alias("any_repository_has_fulltext")).alias("open_access"),
        place("best_oa", F.lit(True)).alias("best_oa_location"), place("primary", no("is_oa")).alias("primary_location"),
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), no("is_retracted").alias("is_retracted"), no("is_paratext").alias("is_paratext"), F.col("lang").alias("language"),
    ).cast(WORK)
    if "full_json" not in flat.columns:
        return rebuilt
    read = F.from_json("full_json", WORK)
    return F.when(read["id"].isNotNull(), read).otherwise(rebuilt)


def fenced_array(answer: Column) -> Column:
    """The texts of a JSON array that a model answered, with or without a code fence around it; null where there is none."""
    bare = F.regexp_replace(F.regexp_replace(answer, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    return F.from_json(bare, "array<string>")


def download_outcome(url: Column, exists: Column, fetched: Column) -> Column:
    """``no_url``, ``skipped`` where the file is there, else ``downloaded`` or ``failed``."""
    return F.when(url.isNull(), "no_url").when(exists, "skipped").when(fetched, "downloaded").otherwise("failed")


def download_statistics(outcomes: DataFrame, outcome: str, at: str) -> DataFrame:
    """One row of counters; what is tried counts as found, the rate is of those, 0 where nothing was found."""
    n = lambda *x: F.count_if(F.col(outcome).isin(*x))
    found = n("downloaded", "failed")
    seconds = F.unix_micros(F.max(F.col(at).cast("timestamp"))) - F.unix_micros(F.min(F.col(at).cast("timestamp")))
    return outcomes.agg(
        F.count("*").alias("total_works"), found.alias("pdfs_found"), n("downloaded").alias("pdfs_downloaded"), n("skipped").alias("pdfs_skipped"), n("failed").alias("pdfs_failed"),
        F.when(found == 0, 0.0).otherwise(n("downloaded") / found * 100).alias("success_rate"), (F.coalesce(seconds, F.lit(0)) / 1e6).alias("duration_seconds"),
    )


def cost_from_first(texts: DataFrame, order: str, tokens: Column, price_per_million: float, first: int = 100) -> DataFrame:
    """One row ``(n_tokens, cost)``: the mean of the first texts, carried on to all of them and cut to a whole number."""
    head = texts.orderBy(order).limit(first).agg(F.avg(tokens).alias("mean"))
    both = texts.agg(F.count("*").alias("n")).crossJoin(head)  # one row each
    n = F.floor(F.coalesce("mean", F.lit(0.0)) * F.col("n")).cast("long")
    return both.select(n.alias("n_tokens"), (n / 1e6 * price_per_million).alias("cost"))


# What E5 models were trained with; other models take texts as they are.
PREFIXES = {"e5": ("query: ", "passage: ")}


def prefixed(text: Column, model: Column, passage: bool) -> Column:
    """A text as its model wants it: with the prefix of the model's family for queries or passages."""
    out = text
    for family, pair in PREFIXES.items():
        out = F.when(F.lower(model).contains(family), F.concat(F.lit(pair[passage]), text)).otherwise(out)
    return out


def metric_cell(value: Column, percent: bool = False) -> Column:
    """A value in a table of metrics: three decimals, or a percentage with one; ``N/A`` for null."""
    shown = F.format_string("%.1f%%", value * 100) if percent else F.format_string("%.3f", value)
    return F.when(value.isNull(), "N/A").otherwise(shown)


def html_table(rows: DataFrame, columns: list[str]) -> str:
    """A small result, one row per configuration, as an HTML table; texts are escaped."""
    import html

    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape('' if c is None else str(c))}</{tag}>" for c in cells) + "</tr>"
    return "<table>\n" + "\n".join([line("th", columns), *(line("td", r) for r in rows.select(*columns).collect())]) + "\n</table>"

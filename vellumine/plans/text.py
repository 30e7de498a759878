"""Queries over string functions and layout elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.functions import text as T
from vellumine.plans.registry import Registry
from vellumine.sources.tables import table

text = Registry()


def _select(name: str, source: str, columns, sql: str):
    """A projection of a table, checked against the same projection in SQL."""
    text.query(name, sql)(lambda spark, sf_dir: table(spark, sf_dir, source).select(*columns()))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

_select("fn_strip", "chunks", lambda: ["chunk_id", T.strip("text").alias("stripped")], f"SELECT chunk_id, {_STRIP.format('text')} AS stripped FROM chunks")
_select("fn_normalise_lf", "chunks", lambda: ["chunk_id", T.normalise_lf("text").alias("lf")], r"SELECT chunk_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS lf FROM chunks")
_select("fn_word_count", "documents", lambda: ["doc_id", T.word_count("text").alias("n_words")], r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INTEGER AS n_words FROM documents")
_select("fn_truncate", "flat_works", lambda: ["id", T.truncate("title").alias("short_title")], "SELECT id, CASE WHEN length(title) > 60 THEN left(title, 57) || '...' ELSE title END AS short_title FROM flat_works")
_select("fn_citation_count", "chunks", lambda: ["chunk_id", T.citation_count("text").alias("n_citations")],
    r"SELECT chunk_id, (len(regexp_extract_all(text, '\$\^\{\d+\}\$')) + len(regexp_extract_all(text, '\[\d+\]')) + len(regexp_extract_all(text, '\(\d+\)')))::INTEGER AS n_citations FROM chunks")
_select("fn_token_estimate", "documents", lambda: ["doc_id", T.token_estimate("text").alias("n_tokens")], "SELECT doc_id, (length(text) // 4)::INTEGER AS n_tokens FROM documents")

_SAFE = r"""coalesce(nullif(left(trim(regexp_replace(regexp_replace({0}, '[<>:"/\\|?*]', '_', 'g'), '[_\s]+', '_', 'g'), ' _'), {1}), ''), 'untitled')"""
_select("fn_safe_filename", "flat_works", lambda: ["id", T.safe_filename("title", 40).alias("filename")], f"SELECT id, {_SAFE.format('title', 40)} AS filename FROM flat_works")
_select("fn_pdf_filename", "flat_works", lambda: ["id", T.pdf_filename("num_locations", "openalex_id", "title", 60).alias("filename")],
    "SELECT id, p || " + _SAFE.format("coalesce(nullif(title, ''), 'untitled')", "60 - length(p) - 4") + " || '.pdf' AS filename FROM (SELECT *, printf('%05d_%s_', num_locations, openalex_id) AS p FROM flat_works)")
_select("fn_human_bytes", "documents", lambda: ["doc_id", T.human_bytes(F.col("n_chars") * F.col("n_chars")).alias("size")],
    "SELECT doc_id, CASE " + " ".join(f"WHEN n < {1024.0 ** (i + 1)} THEN printf('%.2f {u}', n / {1024.0 ** i})" for i, u in enumerate(("B", "KB", "MB", "GB", "TB"))) + " END AS size FROM (SELECT doc_id, (n_chars * n_chars)::DOUBLE AS n FROM documents)")
_select("fn_human_duration", "documents", lambda: ["doc_id", T.human_duration(F.col("n_chars") / 4).alias("duration")],
    """SELECT doc_id, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%dm %ds', floor(s / 60)::INTEGER, floor(s % 60)::INTEGER)
ELSE printf('%dh %dm %ds', floor(s / 3600)::INTEGER, (floor(s / 60)::INTEGER % 60), floor(s % 60)::INTEGER) END AS duration FROM (SELECT doc_id, n_chars / 4 AS s FROM documents)""")  # fmt: skip
_select("fn_human_age", "documents", lambda: ["doc_id", T.human_age(F.col("n_chars") * 31).alias("age")],
    """SELECT doc_id, CASE WHEN s < 60 THEN printf('%d seconds', s) WHEN s < 3600 THEN printf('%d minutes', s // 60)
WHEN s < 86400 THEN printf('%d hours %d minutes', s // 3600, s % 3600 // 60) ELSE printf('%d days %d hours', s // 86400, s % 86400 // 3600) END AS age
FROM (SELECT doc_id, n_chars * 31 AS s FROM documents)""")  # fmt: skip
_select("fn_document_id", "flat_works", lambda: ["id", T.document_id("primary_pdf_url").alias("document_id"), T.output_key("primary_pdf_url", "processed/").alias("output_key")],
    """SELECT id, d AS document_id, 'processed/' || d || '/document.md' AS output_key FROM (SELECT id, array_to_string(string_split(replace(string_split(primary_pdf_url, '/')[-1], '.pdf', ''), '_')[1:2], '_') AS d
FROM flat_works WHERE primary_pdf_url IS NOT NULL) UNION ALL SELECT id, NULL, NULL FROM flat_works WHERE primary_pdf_url IS NULL""")  # fmt: skip
_select("fn_short_id", "flat_works", lambda: ["id", T.short_id("openalex_url").alias("short_id")], "SELECT id, string_split(openalex_url, '/')[-1] AS short_id FROM flat_works")
_select("fn_normalise_doi", "flat_works", lambda: ["id", T.normalise_doi(F.concat(F.lit(" DOI: "), F.regexp_replace("doi", "doi.example", "DOI.org"), F.lit("?a=1#x"))).alias("doi_id"), T.normalise_doi("doi").alias("doi_raw")],
    r"""SELECT id, CASE WHEN doi IS NULL THEN '' ELSE trim(regexp_replace(doi, '^https?://[^/]+/', ''), '/') END AS doi_id, coalesce(trim(doi, '/'), '') AS doi_raw FROM flat_works""")  # fmt: skip
_select("fn_valid_url", "flat_works", lambda: ["id", T.valid_url("primary_pdf_url").alias("url"), T.valid_url("doi").alias("doi_url"), T.valid_url("work_type").alias("no_url")],
    "SELECT id, CASE WHEN regexp_matches(primary_pdf_url, '^https?://') OR primary_pdf_url = '' THEN primary_pdf_url END AS url, CASE WHEN regexp_matches(doi, '^https?://') THEN doi END AS doi_url, NULL::VARCHAR AS no_url FROM flat_works")
_select("fn_tables_of_html", "parsed_elements", lambda: ["element_id", T.tables_of_html("text").alias("tables")],
    "SELECT element_id, array_to_string(list_transform(regexp_extract_all(text, '(?s)<table.*?>.*?</table>'), lambda t: regexp_replace(t, '<table[^>]*>', '<table>', 'g')), chr(10)) AS tables FROM parsed_elements")


@text.query(
    "fn_sentences",
    r"""SELECT doc_id, (i - 1)::INTEGER AS pos, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM
(SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents))""",
)
def fn_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence"))


@text.query(
    "claim_sentences",
    r"""SELECT doc_id, s AS claim FROM (SELECT doc_id, regexp_replace(unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))), '^\s+|\s+$', '', 'g') AS s FROM documents) WHERE length(s) > 15""",
)
def claim_sentences(spark, sf_dir):
    """Answers cut into claims without a model: sentences of more than 15 characters."""
    claims = F.filter(F.transform(T.sentences("text"), lambda s: T.strip(s)), lambda s: F.length(s) > 15)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(claims).alias("claim"))


_MACROS_SQL = "replace({}, '\\upmu', '\\mu')"
for _a, _b in T.MACROS:
    _MACROS_SQL = f"replace({_MACROS_SQL}, '{_a}', '{_b}')"

_select("fn_macros", "parsed_elements", lambda: ["element_id", T.macros("text").alias("replaced")], f"SELECT element_id, {_MACROS_SQL.format('text')} AS replaced FROM parsed_elements")

_REJOIN = r"""array_to_string(list_transform(range(1, len({l}) + 1), lambda i: CASE WHEN i = len({l}) THEN {l}[i] WHEN {l}[i] = '' THEN chr(10) WHEN {l}[i + 1] = '' THEN {l}[i] || chr(10)
  WHEN regexp_matches({l}[i], '[一-鿿]$') AND regexp_matches({l}[i + 1], '^[一-鿿]') THEN {l}[i] ELSE {l}[i] || ' ' END), '')"""
_LINES = "list_transform(string_split(replace(" + _STRIP + ", '-' || chr(10), ''), chr(10)), lambda s: " + _STRIP.format("s") + ")"
_select("fn_rejoin_lines", "parsed_elements", lambda: ["element_id", T.rejoin_lines("text").alias("joined")],
    f"SELECT element_id, {_REJOIN.format(l='l')} AS joined FROM (SELECT element_id, {_LINES.format('text')} AS l FROM parsed_elements)")

_ELEMENTS = f"""
WITH one AS (SELECT DISTINCT element_id, paper_id, page_number, reading_order, label, {_STRIP.format('text')} AS t FROM parsed_elements),
lines AS (SELECT *, {_LINES.format(_MACROS_SQL.format("CASE WHEN regexp_matches(coalesce(label, ''), '^sec_[0-5]$') THEN CASE WHEN regexp_matches(t, '[一-鿿]') THEN replace(t, chr(10), '') ELSE replace(t, chr(10), ' ') END ELSE t END"))} AS l FROM one),
plain AS (SELECT *, {_REJOIN.format(l='l')} AS p FROM lines),
rendered AS (SELECT element_id, paper_id, page_number, reading_order, CASE WHEN t = '' THEN NULL
  WHEN regexp_matches(label, '^sec_[0-5]$') THEN CASE label WHEN 'sec_0' THEN '#' WHEN 'sec_1' THEN '##' ELSE '###' END || ' ' || p || chr(10) || chr(10)
  WHEN label = 'fig' THEN CASE WHEN starts_with(t, '![') THEN t || chr(10) || chr(10) ELSE '![Figure ' || reading_order || '](' || CASE WHEN starts_with(t, 'data:image/') OR (contains(t, ';') AND contains(t, ',')) THEN t ELSE 'data:image/png;base64,' || t END || ')' || chr(10) || chr(10) END
  WHEN label = 'tab' THEN array_to_string(list_transform(regexp_extract_all(t, '(?s)<table.*?>.*?</table>'), lambda x: regexp_replace(x, '<table[^>]*>', '<table>', 'g')), chr(10)) || chr(10) || chr(10) || chr(10)
  WHEN label = 'equ' THEN '$$' || {_MACROS_SQL.format("rtrim(trim(t, '$'), chr(92) || ' ')")} || '$$' || chr(10) || chr(10)
  WHEN label = 'list' THEN '- ' || t || chr(10)
  WHEN label = 'code' THEN '```bash' || chr(10) || t || chr(10) || '```' || chr(10) || chr(10)
  ELSE p || chr(10) || chr(10) END AS md FROM plain)
"""


def _rendered(spark, sf_dir):
    one = table(spark, sf_dir, "parsed_elements").select("element_id", "paper_id", "page_number", "reading_order", "label", T.strip("text").alias("t")).distinct()
    return one.select("element_id", "paper_id", "page_number", "reading_order", T.element_markdown("label", "t", "reading_order").alias("md"))


@text.query("element_markdown", _ELEMENTS + "SELECT element_id, md FROM rendered")
def element_markdown(spark, sf_dir):
    return _rendered(spark, sf_dir).select("element_id", "md")


@text.query("page_markdown", _ELEMENTS + "SELECT paper_id, page_number, string_agg(md, '' ORDER BY reading_order, element_id) AS md FROM rendered GROUP BY ALL HAVING string_agg(md, '') IS NOT NULL")
def page_markdown(spark, sf_dir):
    """Elements of a page in reading order, blank ones left out; a page bounds what one task gathers."""
    parts = F.array_sort(F.collect_list(F.struct("reading_order", "element_id", "md")))
    pages = _rendered(spark, sf_dir).filter("md is not null").groupBy("paper_id", "page_number").agg(parts.alias("p"))
    return pages.select("paper_id", "page_number", F.array_join(F.transform("p", lambda x: x["md"]), "").alias("md"))


@text.query("elements_in_order", "SELECT paper_id, page_number, reading_order, element_id, row_number() OVER (PARTITION BY paper_id, page_number ORDER BY reading_order, element_id) - 1 AS pos FROM (SELECT DISTINCT paper_id, page_number, reading_order, element_id FROM parsed_elements)")
def elements_in_order(spark, sf_dir):
    one = table(spark, sf_dir, "parsed_elements").select("paper_id", "page_number", "reading_order", "element_id").distinct()
    from pyspark.sql import Window

    w = Window.partitionBy("paper_id", "page_number").orderBy("reading_order", "element_id")
    return one.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))


_LAYOUT = "concat('[', bbox.x1, ',', bbox.y1, ',', bbox.x2, ',', bbox.y2, '.5][', label, '][PAIR_SEP] [0.5,1,2,3]tail[RELATION_SEP][', bbox.x1, ',1,2,3][x][meta]')"


@text.query(
    "layout_parse",
    rf"""
WITH s AS (SELECT element_id, unnest(string_split(replace({_LAYOUT}, '[RELATION_SEP]', '[PAIR_SEP]'), '[PAIR_SEP]')) AS seg, generate_subscripts(string_split(replace({_LAYOUT}, '[RELATION_SEP]', '[PAIR_SEP]'), '[PAIR_SEP]'), 1) AS pos
  FROM (SELECT DISTINCT element_id, bbox, label FROM parsed_elements WHERE bbox IS NOT NULL AND label IS NOT NULL))
SELECT element_id, (pos - 1)::INTEGER AS pos, trim(regexp_extract(seg, '\]\[([^\]]+)\]', 1)) AS label,
  regexp_extract(seg, '\[(\d*\.?\d+),(\d*\.?\d+),(\d*\.?\d+),(\d*\.?\d+)\]', 1)::DOUBLE AS x1, regexp_extract(seg, '\[(\d*\.?\d+),(\d*\.?\d+),(\d*\.?\d+),(\d*\.?\d+)\]', 4)::DOUBLE AS y2
FROM s WHERE regexp_matches(seg, '\[(\d*\.?\d+),(\d*\.?\d+),(\d*\.?\d+),(\d*\.?\d+)\]') AND regexp_matches(seg, '\]\[([^\]]+)\]')""",
)
def layout_parse(spark, sf_dir):
    """A layout string parsed back to boxes and labels; segments without either are dropped."""
    from vellumine.operators.layout import parse_layout

    b = lambda k: F.col(f"bbox.{k}").cast("string")
    one = table(spark, sf_dir, "parsed_elements").filter("bbox is not null and label is not null").select("element_id", "bbox", "label").distinct()
    comma = F.lit(",")
    s = F.concat(F.lit("["), b("x1"), comma, b("y1"), comma, b("x2"), comma, b("y2"), F.lit(".5]["), "label", F.lit("][PAIR_SEP] [0.5,1,2,3]tail[RELATION_SEP]["), b("x1"), F.lit(",1,2,3][x][meta]"))
    return parse_layout(one.select("element_id", s.alias("layout")), "layout").select("element_id", "pos", "label", "x1", "y2")


@text.query("box_geometry", "SELECT DISTINCT element_id, bbox.x2 - bbox.x1 AS width, bbox.y2 - bbox.y1 AS height, (bbox.x2 - bbox.x1)::BIGINT * (bbox.y2 - bbox.y1) AS area FROM parsed_elements WHERE bbox IS NOT NULL")
def box_geometry(spark, sf_dir):
    w, h = F.col("bbox.x2") - F.col("bbox.x1"), F.col("bbox.y2") - F.col("bbox.y1")
    return table(spark, sf_dir, "parsed_elements").filter("bbox is not null").select("element_id", w.alias("width"), h.alias("height"), (w.cast("long") * h).alias("area")).distinct()


@text.query(
    "box_to_original",
    """
WITH o AS (SELECT DISTINCT element_id, greatest(0, bbox.x1 - 98) AS x1, greatest(0, bbox.y1 - 8) AS y1, least(700, bbox.x2 - 98) AS x2, least(880, bbox.y2 - 8) AS y2 FROM parsed_elements WHERE bbox IS NOT NULL)
SELECT element_id, x1, y1, CASE WHEN x2 <= x1 THEN least(x1 + 1, 700) ELSE x2 END AS x2, CASE WHEN y2 <= y1 THEN least(y1 + 1, 880) ELSE y2 END AS y2 FROM o""",
)
def box_to_original(spark, sf_dir):
    """Boxes of an 896 x 896 padded image mapped to its 700 x 880 original."""
    from vellumine.operators.layout import to_original

    boxes = table(spark, sf_dir, "parsed_elements").filter("bbox is not null").select("element_id", "bbox").distinct()
    return boxes.select("element_id", F.inline(F.array(to_original(F.col("bbox"), F.lit(896), F.lit(896), F.lit(700), F.lit(880)))))


@text.query(
    "document_title",
    f"""SELECT paper_id, coalesce(arg_min({_STRIP.format('text')}, (page_number * 10000 + reading_order, element_id)) FILTER (WHERE page_number = 1 AND starts_with(label, 'sec_0')), paper_id, 'Unknown Title') AS title FROM parsed_elements GROUP BY paper_id""",
)
def document_title(spark, sf_dir):
    """The first title-like element of page 1, else the paper's id."""
    first = F.min_by(T.strip("text"), F.when((F.col("page_number") == 1) & F.col("label").startswith("sec_0"), F.struct("page_number", "reading_order", "element_id")))
    return table(spark, sf_dir, "parsed_elements").groupBy("paper_id").agg(F.coalesce(first, F.col("paper_id"), F.lit("Unknown Title")).alias("title"))

"""Queries that cut documents into chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.operators import chunking as K
from vellumine.plans.registry import Registry
from vellumine.sources.tables import spread, table

chunking = Registry()


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CLEAN = r"regexp_replace(regexp_replace(text, '\n---+\n', chr(10) || chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"


def _sections_sql(text: str) -> str:
    return rf"""
docs AS (SELECT doc_id, {text} AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM docs),
offs AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS off FROM lines),
heads AS (SELECT doc_id, line_no, off, length(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 1))::INTEGER AS level, regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 2) AS heading,
  row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS section FROM offs WHERE regexp_matches(line, '^(#{{1,6}})\s+(.+)$')),
above AS (SELECT i.doc_id, i.section, list(j.heading ORDER BY j.section) AS hierarchy FROM heads i JOIN heads j ON i.doc_id = j.doc_id AND j.section <= i.section
  WHERE NOT EXISTS (SELECT 1 FROM heads k WHERE k.doc_id = i.doc_id AND k.section > j.section AND k.section <= i.section AND k.level <= j.level) GROUP BY ALL),
spans AS (SELECT doc_id, section, off AS a, lead(off) OVER (PARTITION BY doc_id ORDER BY section) - 1 AS b FROM heads),
sections AS (SELECT d.doc_id, coalesce(s.section, 0)::INTEGER AS section, coalesce(a.hierarchy, ['Document']) AS hierarchy, coalesce(s.a, 0)::INTEGER AS char_start,
  coalesce(s.b, length(d.text))::INTEGER AS char_end, substring(d.text, coalesce(s.a, 0) + 1, coalesce(s.b, length(d.text)) - coalesce(s.a, 0)) AS text
  FROM docs d LEFT JOIN spans s ON d.doc_id = s.doc_id LEFT JOIN above a ON a.doc_id = s.doc_id AND a.section = s.section)"""


def _pack_sql(source: str, keys: str, limit: int, shortcut: bool, name: str) -> str:
    """Greedy packing as a recursion over numbered paragraphs."""
    k = [x.strip() for x in keys.split(",")]
    on = " AND ".join(f"p.{x} = r.{x}" for x in k)
    return rf"""
{name}_para AS (SELECT {keys}, p, row_number() OVER (PARTITION BY {keys} ORDER BY i) AS i FROM
  (SELECT {keys}, {_STRIP.format("unnest(regexp_split_to_array(text, '\\n\\n+'))")} AS p, generate_subscripts(regexp_split_to_array(text, '\n\n+'), 1) AS i FROM {source} {f"WHERE length(text) > {limit}" if shortcut else ""}) WHERE p <> ''),
{name}_rec AS (SELECT {keys}, i, p, 0 AS grp, length(p) AS len FROM {name}_para WHERE i = 1
  UNION ALL SELECT {", ".join(f"p.{x}" for x in k)}, p.i, p.p, CASE WHEN r.len + length(p.p) + 2 > {limit} THEN r.grp + 1 ELSE r.grp END,
    CASE WHEN r.len + length(p.p) + 2 > {limit} THEN length(p.p) ELSE r.len + length(p.p) + 2 END FROM {name}_rec r JOIN {name}_para p ON {on} AND p.i = r.i + 1),
{name} AS (SELECT {keys}, grp AS pos, string_agg(p, chr(10) || chr(10) ORDER BY i) AS raw FROM {name}_rec GROUP BY {keys}, grp
  {f"UNION ALL SELECT {keys}, 0, text FROM {source} WHERE length(text) <= {limit}" if shortcut else ""})"""


def _overlap(raw: str, prev: str, pct: float) -> str:
    n = f"floor(length({prev}) * {pct}::DOUBLE)::INTEGER"
    return rf"CASE WHEN {prev} IS NULL THEN {raw} ELSE regexp_replace(CASE WHEN {n} = 0 THEN {prev} ELSE right({prev}, {n}) END, '^\s+', '') || chr(10) || chr(10) || {raw} END"


_COARSE = f"""WITH RECURSIVE {_sections_sql(_CLEAN)},
{_pack_sql("sections", "doc_id, section", 2500, True, "packed")},
num AS (SELECT *, row_number() OVER w - 1 AS chunk_index, lag(raw) OVER w AS prev, count(*) OVER (PARTITION BY doc_id) AS total FROM packed WINDOW w AS (PARTITION BY doc_id ORDER BY section, pos)),
coarse AS (SELECT n.doc_id, n.chunk_index::INTEGER AS chunk_index, n.total::INTEGER AS total_chunks, {_overlap("n.raw", "n.prev", 0.1)} AS text, s.hierarchy AS section_hierarchy, s.char_start
  FROM num n JOIN sections s USING (doc_id, section))"""
_OUT = "doc_id, chunk_index, total_chunks, text, section_hierarchy, char_start, (char_start + length(text))::INTEGER AS char_end, overlap_with_previous"


@chunking.query("headings", rf"WITH {_sections_sql('text')} SELECT doc_id, line_no::INTEGER AS line_no, off AS \"offset\", level, heading FROM heads".replace('\\"', '"'))
def headings(spark, sf_dir):
    return K.headings(_docs(spark, sf_dir))


@chunking.query("section_split", f"WITH {_sections_sql('text')} SELECT doc_id, section, hierarchy, text, char_start, char_end FROM sections")
def section_split(spark, sf_dir):
    return K.sections(_docs(spark, sf_dir))


@chunking.query("clean_markdown", f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents")
def clean_markdown(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", K.clean_markdown(F.col("text")).alias("cleaned"))


@chunking.query("paragraph_pack", f"WITH RECURSIVE {_pack_sql('documents', 'doc_id', 600, True, 'packed')} SELECT doc_id, pos::INTEGER AS pos, raw AS chunk FROM packed")
def paragraph_pack(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(K.split_at_paragraphs(F.col("text"), 600)).alias("pos", "chunk"))


@chunking.query("chunk_coarse", _COARSE + f" SELECT {_OUT.replace('overlap_with_previous', 'chunk_index > 0 AS overlap_with_previous')} FROM coarse")
def chunk_coarse(spark, sf_dir):
    return K.coarse_chunks(_docs(spark, sf_dir))


@chunking.query(
    "chunk_fine",
    _COARSE
    + f""", {_pack_sql("coarse", "doc_id, chunk_index", 450, False, "fpacked")},
fnum AS (SELECT *, lag(raw) OVER (PARTITION BY doc_id, chunk_index ORDER BY pos) AS prev, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, pos) - 1 AS fi, count(*) OVER (PARTITION BY doc_id) AS total FROM fpacked),
fine AS (SELECT f.doc_id, f.fi::INTEGER AS chunk_index, f.total::INTEGER AS total_chunks, {_overlap("f.raw", "f.prev", 0.2)} AS text, c.section_hierarchy, c.char_start, f.pos > 0 AS overlap_with_previous
  FROM fnum f JOIN coarse c ON c.doc_id = f.doc_id AND c.chunk_index = f.chunk_index)
SELECT {_OUT} FROM fine""",
)
def chunk_fine(spark, sf_dir):
    return K.fine_chunks(_docs(spark, sf_dir))


_ROWS = r"doc_id, chunk_index, text, length(text)::INTEGER AS length, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INTEGER AS word_count"


@chunking.query(
    "chunk_fixed",
    f"""WITH c AS (SELECT doc_id, unnest(list_transform(range(0, greatest(length(text), 1), 924), lambda i: substring(text, i + 1, 1024))) AS text, generate_subscripts(range(0, greatest(length(text), 1), 924), 1) AS i FROM documents)
SELECT {_ROWS} FROM (SELECT doc_id, text, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_index FROM c WHERE length(text) >= 100)""",
)
def chunk_fixed(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return K.chunk_rows(docs, K.fixed_windows(F.col("text")))


@chunking.query(
    "overlap_tail",
    "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text WHEN strpos(t, '. ') > 0 THEN substring(t, strpos(t, '. ') + 2) ELSE t END AS tail FROM (SELECT doc_id, text, right(text, 100) AS t FROM documents)",
)
def overlap_tail(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", K.overlap_text(F.col("text"), 100).alias("tail"))


@chunking.query("chunk_semantic")
def chunk_semantic(spark, sf_dir):
    return K.chunk_rows(_docs(spark, sf_dir), K.semantic_chunks(F.col("text")))


@chunking.query("chunk_recursive")
def chunk_recursive(spark, sf_dir):
    return K.chunk_rows(_docs(spark, sf_dir), K.recursive_chunks(F.col("text")))


@chunking.query("chunk_both", f"SELECT doc_id, printf('%d_coarse_%04d', doc_id, chunk_index) AS chunk_id, length(text)::INTEGER AS n_chars FROM ({chunking.sql['chunk_coarse']}) UNION ALL SELECT doc_id, printf('%d_fine_%04d', doc_id, chunk_index), length(text)::INTEGER FROM ({chunking.sql['chunk_fine']})")
def chunk_both(spark, sf_dir):
    """Both sizes of chunks, under the ids that the chunk files give them."""
    docs = _docs(spark, sf_dir)
    named = lambda df, kind: df.select("doc_id", F.format_string(f"%d_{kind}_%04d", "doc_id", "chunk_index").alias("chunk_id"), F.length("text").alias("n_chars"))
    return named(K.coarse_chunks(docs), "coarse").unionByName(named(K.fine_chunks(docs), "fine"))

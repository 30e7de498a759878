"""Queries behind a question-answering service, and what the coverage pass found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.numbering import with_row_number
from vellumine.functions.text import strip
from vellumine.operators import answers as A
from vellumine.operators import faithfulness as V
from vellumine.operators import gold as G
from vellumine.operators import layout as L
from vellumine.operators import retrieval as R
from vellumine.plans.analysis import _PAIRS_SQL
from vellumine.plans.registry import Registry
from vellumine.plans.retrieval import _hits, _rounded, _topk_sql
from vellumine.sources.tables import table

service = Registry()
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_BULLET = r"regexp_replace(x, '^[\s\-•*]+', '')"
_HEAD = r"regexp_replace(s, '(?i)#{0,2}\s*Executive Summary', '')"


@service.query(
    "box_deoverlap",
    """WITH RECURSIVE o AS (SELECT DISTINCT element_id, paper_id, page_number, reading_order, bbox FROM parsed_elements WHERE bbox IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY paper_id, page_number ORDER BY reading_order, element_id) AS i, greatest(0, least(round_even(bbox.x1 / 896.0 * 900, 0)::INTEGER, 899)) AS a, greatest(0, least(round_even(bbox.y1 / 896.0 * 300, 0)::INTEGER, 299)) AS b,
  greatest(0, least(round_even(bbox.x2 / 896.0 * 900, 0)::INTEGER + 1, 900)) AS c0, greatest(0, least(round_even(bbox.y2 / 896.0 * 300, 0)::INTEGER + 1, 300)) AS d0 FROM o),
p AS (SELECT *, CASE WHEN c0 <= a THEN least(a + 1, 900) ELSE c0 END AS c, CASE WHEN d0 <= b THEN least(b + 1, 300) ELSE d0 END AS d FROM n),
r AS (SELECT paper_id, page_number, i, element_id, a AS x1, b AS y1, c AS x2, d AS y2 FROM p WHERE i = 1
  UNION ALL SELECT paper_id, page_number, i, element_id, a, t, c, CASE WHEN m AND d <= t THEN least(t + 1, 300) ELSE d END FROM (SELECT p.*, (p.a < r.x2 AND p.c > r.x1 AND p.b < r.y2 AND p.d > r.y1) AS m,
    CASE WHEN p.a < r.x2 AND p.c > r.x1 AND p.b < r.y2 AND p.d > r.y1 THEN least(r.y2, 299) ELSE p.b END AS t FROM r JOIN p ON p.paper_id = r.paper_id AND p.page_number = r.page_number AND p.i = r.i + 1))
SELECT element_id, x1, y1, x2, y2 FROM r""",
)
def box_deoverlap(spark, sf_dir):
    """Boxes of a page in reading order, scaled to 900 x 300 pixels so that some meet."""
    one = table(spark, sf_dir, "parsed_elements").filter("bbox is not null").select("element_id", "paper_id", "page_number", "reading_order", "bbox").distinct()
    pages = one.groupBy("paper_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("reading_order", "element_id", "bbox"))).alias("x"))  # a page bounds a group
    boxes = L.pixel_boxes(F.transform("x", lambda e: e["bbox"]), 900, 300)
    rows = pages.select(F.explode(F.arrays_zip(F.transform("x", lambda e: e["element_id"]).alias("element_id"), boxes.alias("b"))).alias("z"))
    return rows.select("z.element_id", "z.b.*")


_ANSWER = """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '## Executive Summary' || chr(10) || '- ' || replace(a, chr(10), chr(10) || '- ') || chr(10) || '## Detailed Analysis' || chr(10) || '### First' || chr(10) || b || chr(10) || '### Empty' || chr(10) || '## Key References' || chr(10) || 'x'
WHEN 1 THEN 'Executive Summary ' || a || ' Detailed Analysis ' || b ELSE '## Executive Summary' || chr(10) || a || chr(10) || '## Detailed Analysis' || chr(10) || b END AS answer FROM (SELECT doc_id, left(text, length(text) // 2) AS a, substr(text, length(text) // 2 + 1) AS b FROM documents)"""


def _answers(spark, sf_dir):
    """Each document's whole text as an answer in two sections, in three layouts."""
    t, nl = F.col("text"), F.lit("\n")
    half = F.floor(F.length(t) / 2).cast("int")
    a, b = F.left(t, half), t.substr(half + 1, F.length(t))
    full = F.concat(F.lit("## Executive Summary\n- "), F.replace(a, nl, F.lit("\n- ")), F.lit("\n## Detailed Analysis\n### First\n"), b, F.lit("\n### Empty\n## Key References\nx"))
    plain = F.concat(F.lit("Executive Summary "), a, F.lit(" Detailed Analysis "), b)
    m = F.col("doc_id") % 3
    return table(spark, sf_dir, "documents").select("doc_id", F.when(m == 0, full).when(m == 1, plain).otherwise(F.concat(F.lit("## Executive Summary\n"), a, F.lit("\n## Detailed Analysis\n"), b)).alias("answer"))


@service.query(
    "answer_summary",
    rf"""WITH a AS ({_ANSWER}), h AS (SELECT doc_id, CASE WHEN regexp_matches(answer, '(?i)Executive Summary') THEN regexp_replace(regexp_extract(answer, '(?is)(#{{0,2}}\s*Executive Summary.*)', 1), '(?is)\s*(#{{1,2}}\s*)?Detailed Analysis.*', '') ELSE '' END AS s FROM a),
p AS (SELECT doc_id, s, list_filter(list_transform(list_filter(string_split(s, chr(10)), lambda x: regexp_matches({_STRIP.format("x")}, '^[-•]')), lambda x: {_STRIP.format(_BULLET)}), lambda x: x <> '') AS b FROM h)
SELECT doc_id, unnest(CASE WHEN len(b) > 0 THEN b ELSE list_filter([{_STRIP.format(_HEAD)}], lambda x: x <> '') END) AS point FROM p""",
)
def answer_summary(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", F.explode(A.summary_points(F.col("answer"))).alias("point"))


@service.query("answer_details")
def answer_details(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", F.inline(A.detail_sections(F.col("answer"))))


@service.query("question_model_pairs", "SELECT DISTINCT g.id, m.model FROM gold_pairs g, (VALUES ('a'), ('b'), ('c')) m(model)")
def question_model_pairs(spark, sf_dir):
    """Every question for every model; the list of models is an argument, not a table."""
    return table(spark, sf_dir, "gold_pairs").select("id").distinct().withColumn("model", F.explode(F.array(*map(F.lit, "abc"))))


@service.query(
    "rerank_positions",
    f"""WITH {_topk_sql("ip", 10)}, l AS (SELECT query_id, list(vec_id ORDER BY rank) AS ids FROM top GROUP BY 1)
SELECT query_id, i - 1 AS new_rank, ids[11 - i] AS vec_id FROM (SELECT query_id, ids, unnest(range(1, 6)) AS i FROM l)""",
)
def rerank_positions(spark, sf_dir):
    """A reranker that answers with positions of its candidates (here: from the last to the first), mapped back to them."""
    lists = _hits(spark, sf_dir, 10).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("c"))
    order = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.lit(9) - i)
    rows = lists.select("query_id", "c", F.posexplode(order).alias("new_rank", "position"))
    return rows.select("query_id", F.col("new_rank").cast("long").alias("new_rank"), F.get("c", F.col("position"))["vec_id"].alias("vec_id"))


@service.query("rerank_lexical")
def rerank_lexical(spark, sf_dir):
    """Documents ranked for each gold question by shared words, a stand-in for a cross-encoder: candidates come from the pair's own papers."""
    pairs = table(spark, sf_dir, "gold_pairs")
    spans = G.spans(pairs).select("id", "paper_id").distinct().join(pairs.select("id", "question").distinct(), "id")
    docs = table(spark, sf_dir, "documents").filter("paper_id is not null").select("paper_id", "doc_id", "text")
    scored = spans.join(docs, "paper_id").select("id", "doc_id", V.containment(F.col("question"), F.col("text")).alias("score")).distinct()
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "doc_id")) - 1)


@service.query("record_json", "SELECT id, id AS back, bbox_x FROM (SELECT DISTINCT element_id AS id, bbox.x1 AS bbox_x FROM parsed_elements)")
def record_json(spark, sf_dir):
    """Elements to JSON and back."""
    e = table(spark, sf_dir, "parsed_elements").select("element_id", "bbox").distinct()
    j = e.select(F.col("element_id").alias("id"), F.from_json(F.to_json(F.struct("element_id", "bbox")), "element_id string, bbox struct<x1:int>").alias("j"))
    return j.select("id", F.col("j.element_id").alias("back"), F.col("j.bbox.x1").alias("bbox_x"))


@service.query("health", "SELECT 'ok' AS status, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT chunk_id) FROM chunks) AS chunks")
def health(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors"))
    c = table(spark, sf_dir, "chunks").agg(F.countDistinct("chunk_id").alias("chunks"))
    return v.crossJoin(c).select(F.lit("ok").alias("status"), "vectors", "chunks")  # one row each


@service.query("search_results", f"WITH {_topk_sql('ip', 5)} SELECT query_id, vec_id, label, round(score, 6) AS score, rank, printf('%.2f%%', round(score, 4) * 100) AS shown FROM top JOIN embeddings USING (vec_id)")
def search_results(spark, sf_dir):
    hits = _rounded(_hits(spark, sf_dir, 5)).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return hits.select("query_id", "vec_id", "label", "score", "rank", F.format_string("%.2f%%", F.round("score", 4) * 100).alias("shown"))


@service.query("model_dimensions", "SELECT label, coalesce(CASE WHEN label = 3 THEN 99 END, CASE label WHEN 0 THEN 1536 WHEN 1 THEN 3072 WHEN 2 THEN 1024 END, 1536) AS dims FROM (SELECT DISTINCT label FROM embeddings)")
def model_dimensions(spark, sf_dir):
    """An explicit value wins over the table of models, the table over the default."""
    known = F.create_map(*[F.lit(x) for x in (0, 1536, 1, 3072, 2, 1024)])
    labels = table(spark, sf_dir, "embeddings").select("label").distinct()
    return labels.select("label", F.coalesce(F.when(F.col("label") == 3, 99), F.try_element_at(known, F.col("label").cast("int")), F.lit(1536)).alias("dims"))


@service.query("available_models", "SELECT DISTINCT lang AS model FROM documents WHERE lang NOT IN ('fr')")
def available_models(spark, sf_dir):
    """The specifications that need no key that is missing."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("model")).distinct().filter("model not in ('fr')")


# Fixed value: the agreement that is aimed at.
KAPPA_TARGET = 0.6
_LABELS = ("supports", "contradicts", "unrelated")


@service.query(
    "kappa_gate",
    f"""{_PAIRS_SQL}, l AS (SELECT 'pairs' AS cfg, a, r FROM ok
  UNION ALL SELECT 'one-sided', CASE WHEN doc_id % 25 = 0 THEN 'unrelated' ELSE 'supports' END, CASE WHEN doc_id % 25 = 1 THEN 'unrelated' ELSE 'supports' END FROM documents),
t AS (SELECT cfg, count(*)::DOUBLE AS n, avg((a = r)::INTEGER) AS po FROM l GROUP BY cfg),
m AS (SELECT cfg, v, count(*) FILTER (WHERE a = v) AS x, count(*) FILTER (WHERE r = v) AS y FROM l, (VALUES ('supports'), ('contradicts'), ('unrelated')) d(v) GROUP BY cfg, v),
k AS (SELECT cfg, t.n, po, sum(x * y) / (t.n * t.n) AS pe FROM t JOIN m USING (cfg) GROUP BY cfg, t.n, po),
g AS (SELECT cfg, n, CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END AS kappa FROM k)
SELECT cfg, strict, coalesce(n, 0)::BIGINT AS n, round(kappa, 6) AS kappa, CASE WHEN n IS NULL THEN 'undefined' WHEN kappa >= {KAPPA_TARGET} THEN 'pass' ELSE 'below target' END AS verdict,
  CASE WHEN strict AND kappa < {KAPPA_TARGET} THEN 1 ELSE 0 END AS exit_code FROM (VALUES ('pairs'), ('one-sided'), ('none')) c(cfg) LEFT JOIN g USING (cfg) CROSS JOIN (VALUES (true), (false)) s(strict)""",
)
def kappa_gate(spark, sf_dir):
    """The gate on the agreement subset, on labels that agree in 92 % of all cases by chance alone, and on no labels; strict and not."""
    rare = lambda i: F.when(F.col("doc_id") % 25 == i, "unrelated").otherwise("supports")
    pairs = G.label_pairs(table(spark, sf_dir, "gold_pairs"), _LABELS)
    sets = {"pairs": pairs, "one-sided": table(spark, sf_dir, "documents").select(rare(0).alias("annotator_label"), rare(1).alias("reviewer_label")), "none": pairs.limit(0)}
    gates = [G.gate(G.cohens_kappa(labels), KAPPA_TARGET, strict).select(F.lit(name).alias("cfg"), F.lit(strict).alias("strict"), "n", F.round("kappa", 6).alias("kappa"), "verdict", "exit_code") for name, labels in sets.items() for strict in (True, False)]
    return reduce(DataFrame.unionByName, gates)


@service.query("citations_in_chunks", r"WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks) SELECT chunk_id, len(list_filter(['[1]', '[15]', '(20)', '$^{7}$'], lambda x: contains(text, x)))::INTEGER AS n_cited FROM c")
def citations_in_chunks(spark, sf_dir):
    """Which of a list of citations a chunk contains."""
    wanted = F.array(*map(F.lit, ("[1]", "[15]", "(20)", "$^{7}$")))
    return table(spark, sf_dir, "chunks").select("chunk_id", "text").distinct().select("chunk_id", F.size(F.filter(wanted, lambda x: F.col("text").contains(x))).alias("n_cited"))


@service.query("elements_by_label", "SELECT coalesce(label, '?') AS label, count(DISTINCT element_id) AS n, min(length(text))::INTEGER AS shortest, max(length(text))::INTEGER AS longest FROM parsed_elements GROUP BY 1")
def elements_by_label(spark, sf_dir):
    return table(spark, sf_dir, "parsed_elements").groupBy(F.coalesce("label", F.lit("?")).alias("label")).agg(F.countDistinct("element_id").alias("n"), F.min(F.length("text")).alias("shortest"), F.max(F.length("text")).alias("longest"))


@service.query("gold_papers", "SELECT id, list_sort(list(DISTINCT s.paper_id)) AS papers FROM (SELECT id, unnest(c.supporting_spans) AS s FROM (SELECT id, unnest(claims) AS c FROM gold_pairs)) GROUP BY 1")
def gold_papers(spark, sf_dir):
    return G.spans(table(spark, sf_dir, "gold_pairs")).groupBy("id").agg(F.sort_array(F.collect_set("paper_id")).alias("papers"))


@service.query("shared_papers", "WITH g AS (SELECT id, list_distinct(list(s.paper_id)) AS p FROM (SELECT id, unnest(c.supporting_spans) AS s FROM (SELECT id, unnest(claims) AS c FROM gold_pairs)) GROUP BY 1), n AS (SELECT id, p, lead(p) OVER (ORDER BY id) AS q FROM g) SELECT id, len(list_intersect(p, q))::INTEGER AS shared FROM n WHERE q IS NOT NULL")
def shared_papers(spark, sf_dir):
    """How many papers a pair shares with the next one by id."""
    sets = G.spans(table(spark, sf_dir, "gold_pairs")).groupBy("id").agg(F.collect_set("paper_id").alias("p"))
    a = with_row_number(sets, "id", "n")
    b = a.select((F.col("n") - 1).alias("n"), F.col("p").alias("q"))
    return a.join(b, "n").select("id", F.size(F.array_intersect("p", "q")).alias("shared"))


@service.query("latest_versions", "SELECT openalex_id, max(loaded_at) AS loaded_at, count(*) AS n_rows FROM flat_works GROUP BY 1")
def latest_versions(spark, sf_dir):
    return table(spark, sf_dir, "flat_works").groupBy("openalex_id").agg(F.max("loaded_at").alias("loaded_at"), F.count("*").alias("n_rows"))

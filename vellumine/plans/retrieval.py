"""Queries of vector search and its evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellumine.functions.numbering import with_row_number
from vellumine.operators import evaluation as E
from vellumine.operators import retrieval as R
from vellumine.plans.registry import Registry
from vellumine.sources.tables import table

retrieval = Registry()
KS = (1, 5, 10, 20)


def _vectors(spark, sf_dir):
    corpus = table(spark, sf_dir, "embeddings")
    queries = corpus.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return queries, corpus


def _topk_sql(metric: str, k: int, name: str = "top", skip_self: bool = True) -> str:
    if metric == "ip":
        score, order = "round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9)", "DESC"
    else:
        score, order = "round(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) + list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]) - 2 * list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9)", "ASC"
    return f"""{name} AS (SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) - 1 AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id, {score} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 {"AND q.vec_id <> c.vec_id" if skip_self else ""})) WHERE rank < {k})"""


def _hits(spark, sf_dir, k, metric="ip"):
    return R.topk(*_vectors(spark, sf_dir), k, metric, skip_self=True)


def _rounded(df):
    return df.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


for _metric, _name in (("ip", "topk_inner_product"), ("l2", "topk_l2")):
    retrieval.query(_name, f"WITH {_topk_sql(_metric, 10)} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM top")(lambda spark, sf_dir, m=_metric: _rounded(_hits(spark, sf_dir, 10, m)))


@retrieval.query(
    "two_stage_topk",
    f"""WITH {_topk_sql("ip", 75)}, again AS (SELECT t.query_id, t.vec_id, -abs(t.vec_id - t.query_id)::DOUBLE AS score FROM top t)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM again QUALIFY rank < 10""",
)
def two_stage_topk(spark, sf_dir):
    """75 candidates by inner product, ranked again by a pluggable scorer (here: nearness of ids)."""
    near = lambda df: (-F.abs(F.col("vec_id") - F.col("query_id"))).cast("double")
    return _rounded(R.two_stage(*_vectors(spark, sf_dir), 10, near, skip_self=True))


@retrieval.query(
    "maxsim_topk",
    """WITH tok AS (SELECT vec_id, t, (embedding::DOUBLE[])[t * 16 + 1:t * 16 + 16] AS v FROM embeddings, range(4) r(t)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, q.t, max(list_inner_product(q.v, c.v)) AS m FROM tok q, tok c WHERE q.vec_id % 50 = 0 GROUP BY ALL),
z AS (SELECT query_id, vec_id, round(sum(m), 9) AS score FROM s GROUP BY ALL)
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM z QUALIFY rank < 10""",
)
def maxsim_topk(spark, sf_dir):
    """Each vector read as four token vectors of 16 dimensions."""
    tokens = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tok"), F.col("embedding").cast("array<double>").alias("e"))
    tokens = tokens.select("vec_id", "tok", F.slice("e", F.col("tok") * 16 + 1, F.lit(16)).alias("v"))
    return _rounded(R.maxsim(tokens.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), tokens, 10))


@retrieval.query("l2_normalise", "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x * 3 / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) * 9), 6)) AS unit FROM embeddings")
def l2_normalise(spark, sf_dir):
    tripled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(R.l2_normalise(tripled), lambda x: F.round(x, 6)).alias("unit"))


@retrieval.query("first_hit_per_label", f"WITH {_topk_sql('ip', 20)} SELECT query_id, vec_id, label, rank FROM top JOIN embeddings USING (vec_id) QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY rank) = 1")
def first_hit_per_label(spark, sf_dir):
    labelled = _rounded(_hits(spark, sf_dir, 20)).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return R.first_per_group(labelled, "label").select("query_id", "vec_id", "label", "rank")


@retrieval.query("index_table", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, vec_id, len(embedding)::INTEGER AS dims FROM embeddings")
def index_table(spark, sf_dir):
    """Row numbers by global order: range partitions are counted, then numbered, so no task sorts the whole table."""
    rows = with_row_number(table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dims")), "vec_id", "row_id")
    return rows.select("row_id", "vec_id", "dims")


@retrieval.query("hits_with_metadata", f"WITH {_topk_sql('l2', 5)} SELECT query_id, rank, vec_id, label, round(score, 6) AS score FROM top JOIN embeddings USING (vec_id)")
def hits_with_metadata(spark, sf_dir):
    return _rounded(_hits(spark, sf_dir, 5, "l2")).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").select("query_id", "rank", "vec_id", "label", "score")


@retrieval.query("embed_hash")
def embed_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("passage: "), "text").alias("text"))
    return docs.select("doc_id", R.hash_embedding(F.col("text")).alias("embedding"))


_PICK = """one AS (SELECT DISTINCT ON (chunk_id) chunk_id, paper_id, chunk_type, chunk_index, coalesce(paper_title, 'Unknown') AS paper_title, coalesce(section_hierarchy, []) AS section_hierarchy, coalesce(text, '') AS text FROM chunks ORDER BY chunk_id, ingested_at),
hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY length(text) DESC, chunk_id) - 1 AS rank, round(length(text) / (length(text) + 1000), 4) AS score FROM one WHERE chunk_type = 'coarse') WHERE rank < 10)"""


def _ones(spark, sf_dir):
    first = F.min_by(F.struct("paper_id", "chunk_type", "chunk_index", F.coalesce("paper_title", F.lit("Unknown")).alias("paper_title"), F.coalesce("section_hierarchy", F.array().cast("array<string>")).alias("section_hierarchy"), F.coalesce("text", F.lit("")).alias("text")), "ingested_at")
    return table(spark, sf_dir, "chunks").groupBy("chunk_id").agg(first.alias("c")).select("chunk_id", "c.*")


def _picked(spark, sf_dir):
    """The top ten of all coarse chunks of each paper by length, standing for its hits: the paper is the query."""
    hit = _ones(spark, sf_dir).filter("chunk_type = 'coarse'").withColumn("score", F.round(F.length("text") / (F.length("text") + 1000), 4))
    order = Window.partitionBy("paper_id").orderBy(F.length("text").desc(), "chunk_id")
    return hit.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).filter("rank < 10")


@retrieval.query(
    "prompt_block",
    f"""WITH {_PICK} SELECT paper_id, string_agg(chr(10) || '### Source ' || (rank + 1) || ': ' || string_split(paper_title, chr(10))[1] || chr(10) || '**Section**: ' || array_to_string(section_hierarchy, ' > ') || chr(10)
|| '**Relevance Score**: ' || printf('%.2f%%', score * 100) || chr(10) || chr(10) || text || chr(10), chr(10) || '---' || chr(10) ORDER BY rank) AS prompt FROM hit GROUP BY paper_id""",
)
def prompt_block(spark, sf_dir):
    return R.prompt_block(_picked(spark, sf_dir), "paper_id")


@retrieval.query("citation_cards", f"WITH {_PICK} SELECT paper_id, left(string_split(paper_title, chr(10))[1], 100) AS title, left(text, 150) || '...' AS snippet FROM hit QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY rank) = 1")
def citation_cards(spark, sf_dir):
    first = R.first_per_group(_picked(spark, sf_dir), "paper_title", "paper_id")
    first = first.groupBy("paper_id").agg(F.min_by(F.struct("paper_title", "text"), "rank").alias("f"))
    title, snippet = R.citation_card(F.col("f.paper_title"), F.col("f.text"))
    return first.select("paper_id", title.alias("title"), snippet.alias("snippet"))


@retrieval.query("neighbour_context", f"WITH {_PICK} SELECT h.chunk_id AS hit_id, o.chunk_id FROM one h JOIN one o ON h.paper_id = o.paper_id AND h.chunk_type = o.chunk_type AND abs(h.chunk_index - o.chunk_index) <= 1")
def neighbour_context(spark, sf_dir):
    """Every chunk with those beside it."""
    one = _ones(spark, sf_dir)
    return R.neighbours(one, one.withColumnRenamed("chunk_id", "hit_id"), 1).select("hit_id", "chunk_id")


# ---- evaluation -----------------------------------------------------------------------------
_GOLD = f"""WITH {_topk_sql("ip", 20)}, gold AS (SELECT q.vec_id AS query_id, c.vec_id AS item FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
n AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
seen AS (SELECT t.query_id, t.rank, g.item IS NOT NULL AS is_gold FROM top t LEFT JOIN gold g ON g.query_id = t.query_id AND g.item = t.vec_id),
per AS (SELECT n.query_id, any_value(n_gold) AS n_gold, """ + ", ".join(
    f"avg(is_gold::INTEGER) FILTER (WHERE rank < {k}) AS precision_{k}, count(*) FILTER (WHERE rank < {k} AND is_gold) / any_value(n_gold) AS recall_{k}, max(is_gold::INTEGER) FILTER (WHERE rank < {k})::DOUBLE AS hit_{k}, "
    f"coalesce(sum(1 / log2(rank + 2)) FILTER (WHERE rank < {k} AND is_gold), 0) / list_sum(list_transform(range(1, least(any_value(n_gold), {k}) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_{k}"
    for k in KS
) + ", coalesce(1 / min(rank + 1) FILTER (WHERE is_gold), 0) AS mrr FROM n JOIN seen USING (query_id) GROUP BY n.query_id)"
_NAMES = [f"{m}_{k}" for k in KS for m in ("precision", "recall", "hit", "ndcg")] + ["mrr"]


def _per_query(spark, sf_dir):
    queries, corpus = _vectors(spark, sf_dir)
    q = corpus.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    gold = q.join(corpus.select(F.col("vec_id").alias("item"), "label"), "label").filter("item <> query_id").select("query_id", "item")
    return E.ranking_metrics(_hits(spark, sf_dir, 20).withColumnRenamed("vec_id", "item"), gold, KS)


@retrieval.query("metrics_per_query", _GOLD + "SELECT query_id, n_gold, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NAMES) + " FROM per")
def metrics_per_query(spark, sf_dir):
    return _per_query(spark, sf_dir).select("query_id", "n_gold", *[F.round(c, 6).alias(c) for c in _NAMES])


@retrieval.query("metrics_macro", _GOLD + "SELECT count(mrr) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _NAMES) + " FROM per")
def metrics_macro(spark, sf_dir):
    return E.macro_average(_per_query(spark, sf_dir)).select("n", *[F.round(c, 6).alias(c) for c in _NAMES])


@retrieval.query(
    "hit10_by_label_pivot",
    f"""WITH {_topk_sql("ip", 10, "a")}, {_topk_sql("l2", 10, "b")}, hits AS (SELECT 'ip' AS config, * FROM a UNION ALL SELECT 'l2', * FROM b),
per AS (SELECT h.config, h.query_id, q.label, max((q.label = c.label)::INTEGER) AS hit FROM hits h JOIN embeddings q ON q.vec_id = h.query_id JOIN embeddings c ON c.vec_id = h.vec_id GROUP BY ALL)
SELECT label, round(avg(hit) FILTER (WHERE config = 'ip'), 6) AS ip, round(avg(hit) FILTER (WHERE config = 'l2'), 6) AS l2 FROM per GROUP BY label""",
)
def hit10_by_label_pivot(spark, sf_dir):
    per = _hit10(spark, sf_dir)
    wide = per.groupBy("label").pivot("config", ["ip", "l2"]).avg("hit")
    return wide.select("label", F.round("ip", 6).alias("ip"), F.round("l2", 6).alias("l2"))


def _hit10(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = _hits(spark, sf_dir, 10, "ip").withColumn("config", F.lit("ip")).unionByName(_hits(spark, sf_dir, 10, "l2").withColumn("config", F.lit("l2")))
    hits = hits.join(labels.withColumnRenamed("label", "found"), "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return hits.groupBy("config", "query_id", "label").agg(F.max((F.col("found") == F.col("label")).cast("int")).alias("hit"))


@retrieval.query(
    "failure_buckets",
    f"""WITH {_topk_sql("ip", 10, "a")}, {_topk_sql("l2", 10, "b")}, hits AS (SELECT 'ip' AS config, * FROM a UNION ALL SELECT 'l2', * FROM b),
per AS (SELECT h.config, h.query_id, max((q.label = c.label)::INTEGER) AS hit FROM hits h JOIN embeddings q ON q.vec_id = h.query_id JOIN embeddings c ON c.vec_id = h.vec_id GROUP BY ALL)
SELECT query_id, count(*) FILTER (WHERE hit = 0) AS missed, CASE WHEN count(*) FILTER (WHERE hit = 0) = count(*) THEN 'all' WHEN count(*) FILTER (WHERE hit = 0) > 0 THEN 'some' ELSE 'none' END AS bucket FROM per GROUP BY 1""",
)
def failure_buckets(spark, sf_dir):
    missed = F.count_if(F.col("hit") == 0)
    return _hit10(spark, sf_dir).groupBy("query_id").agg(missed.alias("missed"), F.when(missed == F.count("*"), "all").when(missed > 0, "some").otherwise("none").alias("bucket"))


@retrieval.query("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    return E.bootstrap_ci(_per_query(spark, sf_dir), "mrr")


_SPANS = """WITH p AS (SELECT DISTINCT id AS pair_id, annotator, difficulty, unnest(claims) AS c FROM gold_pairs WHERE annotator IS DISTINCT FROM 'adversarial' AND difficulty IS DISTINCT FROM 'unanswerable'),
spans AS (SELECT DISTINCT pair_id, s.paper_id, s.char_start, s.char_end FROM (SELECT pair_id, unnest(c.supporting_spans) AS s FROM p)),
hits AS (SELECT DISTINCT pair_id, chunk_type, chunk_id FROM spans JOIN chunks k ON k.paper_id = spans.paper_id AND coalesce(k.char_start, 0) < spans.char_end AND spans.char_start < coalesce(k.char_end, 0))"""


def _spans(spark, sf_dir):
    pairs = table(spark, sf_dir, "gold_pairs").filter(E.evaluable(F.col("annotator"), F.col("difficulty")))
    spans = pairs.select(F.col("id").alias("pair_id"), F.explode("claims").alias("c")).select("pair_id", F.explode("c.supporting_spans").alias("s"))
    return spans.select("pair_id", "s.paper_id", "s.char_start", "s.char_end").distinct()


@retrieval.query("span_chunk_overlap", _SPANS + " SELECT pair_id, chunk_type, chunk_id FROM hits")
def span_chunk_overlap(spark, sf_dir):
    return E.resolve_spans(_spans(spark, sf_dir), table(spark, sf_dir, "chunks"))


@retrieval.query("gold_sets", _SPANS + " SELECT pair_id, chunk_type, list_sort(list(DISTINCT chunk_id)) AS chunk_ids FROM hits GROUP BY ALL")
def gold_sets(spark, sf_dir):
    hits = E.resolve_spans(_spans(spark, sf_dir), table(spark, sf_dir, "chunks"))
    return hits.groupBy("pair_id", "chunk_type").agg(F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"))


@retrieval.query("coverage_flag", _SPANS + " SELECT pair_id, t.chunk_type, count(h.chunk_id) > 0 AS covered FROM (SELECT DISTINCT pair_id FROM spans) CROSS JOIN (VALUES ('coarse'), ('fine')) t(chunk_type) LEFT JOIN hits h USING (pair_id, chunk_type) GROUP BY ALL")
def coverage_flag(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    every = spans.select("pair_id").distinct().withColumn("chunk_type", F.explode(F.array(F.lit("coarse"), F.lit("fine"))))
    hits = E.resolve_spans(spans, table(spark, sf_dir, "chunks"))
    return every.join(hits, ["pair_id", "chunk_type"], "left").groupBy("pair_id", "chunk_type").agg((F.count("chunk_id") > 0).alias("covered"))

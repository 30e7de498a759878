"""Queries that write a format and read it back, and streams replayed from files.

What they write lies in the folder the cluster shares (``spark.checkpoint.dir``), in a folder of
its own per call.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from vellumine.operators.metadata import corpus_summary
from vellumine.plans.registry import Registry
from vellumine.session import shared_folder
from vellumine.sources import files as S
from vellumine.sources.tables import table
from vellumine.streaming import incremental

files = Registry()


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _first_ingested(spark, sf_dir, kind=None):
    """Each chunk as it was first ingested; of ``kind`` only, whose rows alone are sorted with their texts."""
    w = Window.partitionBy("chunk_id").orderBy("ingested_at")
    chunks = table(spark, sf_dir, "chunks")
    if kind:
        chunks = chunks.withColumns({c: F.when(F.col("chunk_type") == kind, F.col(c)) for c in ("text", "paper_title", "section_hierarchy")})
    first = chunks.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return first.filter(F.col("chunk_type") == kind) if kind else first


_ONE = "SELECT DISTINCT ON (chunk_id) * FROM chunks ORDER BY chunk_id, ingested_at"


@files.query("roundtrip_chunk_files", f"SELECT paper_id || '_' || chunk_type AS file, chunk_id, text, chunk_index, coalesce(section_hierarchy, []) AS section_hierarchy FROM ({_ONE})")
def roundtrip_chunk_files(spark, sf_dir):
    at = scratch(spark)
    S.write_chunk_files(_first_ingested(spark, sf_dir), at).agg(F.sum("n_items")).collect()
    return S.read_chunk_files(spark, at).select("file", "chunk_id", "text", "chunk_index", "section_hierarchy")


@files.query("roundtrip_bare_chunk_files", f"SELECT paper_id || '_' || chunk_type AS file, chunk_id, char_start, coalesce(char_end, 0) AS char_end FROM ({_ONE.replace('*', '* REPLACE (coalesce(char_start, 0) AS char_start)')}) WHERE chunk_type = 'coarse'")
def roundtrip_bare_chunk_files(spark, sf_dir):
    """The coarse chunks as bare lists."""
    at = scratch(spark)
    S.write_chunk_files(_first_ingested(spark, sf_dir), at, bare=True).agg(F.sum("n_items")).collect()
    return S.read_bare_chunk_files(spark, at, "coarse").select("file", "chunk_id", "char_start", "char_end")


@files.query("roundtrip_chunk_map", f"SELECT row_number() OVER (ORDER BY paper_id NULLS FIRST, chunk_type NULLS FIRST, chunk_index NULLS FIRST, chunk_id NULLS FIRST) - 1 AS row_id, chunk_id, text FROM ({_ONE}) WHERE chunk_type = 'coarse'")
def roundtrip_chunk_map(spark, sf_dir):
    """The coarse chunks by their row in an index, written as one JSON object with text keys."""
    at = scratch(spark)
    S.write_chunk_map(_first_ingested(spark, sf_dir, "coarse"), at, "coarse_metadata.json")
    return S.read_chunk_map(spark, f"{at}/coarse_metadata.json").select("row_id", "chunk_id", "text")


@files.query("roundtrip_markdown", r"SELECT paper_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM documents WHERE paper_id IS NOT NULL")
def roundtrip_markdown(spark, sf_dir):
    at = scratch(spark)
    docs = table(spark, sf_dir, "documents").filter("paper_id is not null")
    S.write_named(docs, at, F.concat("paper_id", F.lit("/document.md")), "text").agg(F.count("*")).collect()
    return S.read_markdown(spark, at)


@files.query("roundtrip_gold_files", "SELECT DISTINCT id, annotator, len(claims)::INTEGER AS n_claims, member_file FROM gold_pairs")
def roundtrip_gold_files(spark, sf_dir):
    """Pairs as one JSON array per member, read back with the member's name."""
    at = scratch(spark)
    fields = ["id", "question", "gold_answer", "difficulty", "category", "annotator", "reviewer", "review_status", "iaa_subset", "claims"]
    pairs = table(spark, sf_dir, "gold_pairs").withColumn("_item", F.to_json(F.struct(*fields)))
    S.write_arrays(pairs, at, F.col("member_file"), F.col("_item"), ["id", "_item"], F.lit("["), F.lit("]")).agg(F.sum("n_items")).collect()
    return S.read_gold(spark, at).select("id", "annotator", F.size("claims").alias("n_claims"), "member_file").distinct()


@files.query("roundtrip_works_json", "SELECT count(*) FILTER (WHERE json_type(CASE WHEN json_valid(record) THEN record::JSON END) = 'OBJECT') AS n_works, count(*) FILTER (WHERE coalesce(json_type(CASE WHEN json_valid(record) THEN record::JSON END), '?') <> 'OBJECT') AS n_rejected FROM raw_works WHERE record IS NOT NULL")
def roundtrip_works_json(spark, sf_dir):
    """Records as JSON lines; what is no object is counted as rejected."""
    at = scratch(spark)
    one_line = F.regexp_replace("record", r"[\r\n]+", " ")  # inside JSON a raw line end is white space
    table(spark, sf_dir, "raw_works").filter("record is not null").select(one_line).write.text(f"{at}/works")
    good, bad = S.read_works(spark, f"{at}/works")
    return good.agg(F.count("*").alias("n_works")).crossJoin(bad.agg(F.count("*").alias("n_rejected")))  # one row each


@files.query("roundtrip_index", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, vec_id, label, len(embedding)::INTEGER AS dims FROM embeddings")
def roundtrip_index(spark, sf_dir):
    at = scratch(spark)
    S.write_index(table(spark, sf_dir, "embeddings"), at, "vec_id", "embedding", ["label"])
    return S.read_index(spark, at).select("row_id", "vec_id", "label", F.size("embedding").alias("dims"))


@files.query("roundtrip_typed_parquet", "SELECT id, is_oa, publication_year, cited_by_count FROM flat_works WHERE work_type IS NOT NULL")
def roundtrip_typed_parquet(spark, sf_dir):
    at = scratch(spark)
    S.write_typed(table(spark, sf_dir, "flat_works"), f"{at}/works", ["work_type"])
    return spark.read.parquet(f"{at}/works").filter("work_type is not null").select("id", "is_oa", "publication_year", "cited_by_count")


@files.query("roundtrip_id_list", "SELECT DISTINCT paper_id AS id FROM documents WHERE paper_id IS NOT NULL")
def roundtrip_id_list(spark, sf_dir):
    at = scratch(spark)
    ids = table(spark, sf_dir, "documents").select("paper_id").distinct().orderBy("paper_id")
    ids.select(F.coalesce(F.concat(F.lit("  "), "paper_id", F.lit(" ")), F.lit("   "))).write.text(f"{at}/ids")
    return S.read_id_list(spark, f"{at}/ids")


@files.query("file_listing", "SELECT 'in' AS folder, member_file AS name, (2 + sum(octet_length(encode(id)) + 2) + count(*) - 1)::BIGINT AS length FROM gold_pairs WHERE id IS NOT NULL GROUP BY member_file")
def file_listing(spark, sf_dir):
    """The files of a folder with their sizes: one list of ids per member."""
    at = scratch(spark)
    quoted = F.concat(F.lit('"'), "id", F.lit('"'))
    S.write_arrays(table(spark, sf_dir, "gold_pairs"), at, F.concat(F.lit("in/"), "member_file"), quoted, ["id"], F.lit("["), F.lit("]")).agg(F.sum("n_items")).collect()
    return S.list_files(spark, at, "*.json").select("folder", "name", "length")


@files.query("folder_listing", "SELECT DISTINCT paper_id AS folder FROM documents WHERE paper_id IS NOT NULL")
def folder_listing(spark, sf_dir):
    """The papers of a store, from the names of their folders; no file is opened."""
    at = scratch(spark)
    docs = table(spark, sf_dir, "documents").filter("paper_id is not null and text is not null")
    S.write_named(docs, at, F.concat("paper_id", F.lit("/document.md")), "text").agg(F.count("*")).collect()
    return S.list_files(spark, at, "document.md").select("folder").distinct()


@files.query("ids_from_stems", f"SELECT DISTINCT paper_id FROM ({_ONE}) WHERE paper_id IS NOT NULL AND chunk_type IS NOT NULL")
def ids_from_stems(spark, sf_dir):
    """The papers that have chunk files, from the files' names without their type."""
    at = scratch(spark)
    S.write_chunk_files(_first_ingested(spark, sf_dir), at).agg(F.sum("n_items")).collect()
    return S.list_files(spark, at, "*.json").select(F.regexp_replace("name", r"_(?:coarse|fine)\.json$", "").alias("paper_id")).distinct()


@files.query("failure_report", "SELECT id, 'no pdf' AS error FROM flat_works WHERE NOT coalesce(has_any_pdf, false)")
def failure_report(spark, sf_dir):
    w = table(spark, sf_dir, "flat_works").select("id", F.when(~F.coalesce("has_any_pdf", F.lit(False)), "no pdf").alias("error"))
    at = scratch(spark)
    S.split_failures(w, "error")[1].write.json(f"{at}/failures")
    return spark.read.schema("id string, error string").json(f"{at}/failures")


@files.query("summary_json", "SELECT count(*) AS total_works, count(doi) AS with_doi FROM flat_works")
def summary_json(spark, sf_dir):
    text = S.summary_json(corpus_summary(table(spark, sf_dir, "flat_works")))
    return spark.createDataFrame([(text,)], "t string").select(F.get_json_object("t", "$.total_works").cast("long").alias("total_works"), F.get_json_object("t", "$.with_doi").cast("long").alias("with_doi"))


@files.query("stream_hourly_counts", "SELECT * FROM (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE hour + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR FROM events)")
def stream_hourly_counts(spark, sf_dir):
    """The events replayed as a stream into hourly counts, each hour written once, when the watermark has passed it."""
    at = scratch(spark)
    events = table(spark, sf_dir, "events")
    events.write.parquet(f"{at}/in")
    counts = incremental.hourly_counts(incremental.replay(spark, f"{at}/in", events.schema, 100))
    incremental.append_to(counts, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@files.query("stream_chunks", "SELECT doc_id, length(text) AS n_chars, true AS complete FROM documents WHERE text IS NOT NULL AND length(trim(text)) > 0")
def stream_chunks(spark, sf_dir):
    """Documents that arrive in files, each chunked once although some files come twice: every chunk of each is there, none twice."""
    at = scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.write.parquet(f"{at}/in")
    docs.filter("doc_id % 10 = 0").write.mode("append").parquet(f"{at}/in")
    incremental.chunk_stream(incremental.replay(spark, f"{at}/in", docs.schema, 2), f"{at}/chunks", f"{at}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{at}/chunks").groupBy("doc_id").agg(((F.count("*") == F.max("total_chunks")) & (F.countDistinct("chunk_index") == F.count("*"))).alias("complete"))
    return got.join(docs.select("doc_id", F.length("text").alias("n_chars")).distinct(), "doc_id").select("doc_id", "n_chars", "complete")

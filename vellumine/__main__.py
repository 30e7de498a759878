"""``python -m vellumine VERB``: the offline verbs over Parquet tables and folders.

flatten IN OUT       nested records (openalex_id, record, ..) to the flat table
tables IN OUT        nested records to one table per level
chunk IN OUT         documents (doc_id, text) to coarse and fine chunks
markdown IN OUT      parsed elements to Markdown per page
embed IN OUT         documents to stand-in vectors
stats IN             summary of a flat table as JSON
search INDEX IDS K   the nearest vectors of an index folder to those with the given ids
info                 the registered queries
"""

from __future__ import annotations

import sys

from pyspark.sql import functions as F


def main(argv: list[str]) -> int:
    if not argv or argv[0] not in ("flatten", "tables", "chunk", "markdown", "embed", "stats", "search", "info"):
        print(__doc__)
        return 2
    verb, args = argv[0], argv[1:]
    if verb == "info":
        from vellumine.plans import core_registries

        print("\n".join(sorted(name for r in core_registries() for name in r.queries)))
        return 0

    from pyspark.sql import SparkSession

    from vellumine.operators import chunking, metadata, nested, retrieval
    from vellumine.functions import text
    from vellumine.session import local_session
    from vellumine.sources import files

    spark = SparkSession.getActiveSession() or local_session()
    if verb == "search":
        index = files.read_index(spark, args[0])
        wanted = [int(x) for x in args[1].split(",")]
        queries = index.filter(F.col("row_id").isin(wanted)).select(F.col("row_id").alias("query_id"), "embedding")
        retrieval.topk(queries, index.select(F.col("row_id").alias("vec_id"), "embedding"), int(args[2])).orderBy("query_id", "rank").show(200, False)
        return 0
    table = spark.read.parquet(args[0])
    if verb == "stats":
        print(files.summary_json(metadata.corpus_summary(table)))
    elif verb == "flatten":
        files.write_typed(metadata.flatten_works(table), args[1])
    elif verb == "tables":
        for name, df in nested.nested_to_flat(table).items():
            files.write_typed(df, f"{args[1]}/{name}")
    elif verb == "chunk":
        both = chunking.coarse_chunks(table).withColumn("chunk_type", F.lit("coarse")).unionByName(chunking.fine_chunks(table).withColumn("chunk_type", F.lit("fine")))
        files.write_typed(both, args[1], ["chunk_type"])
    elif verb == "embed":
        table.select("doc_id", retrieval.hash_embedding(F.col("text")).alias("embedding")).write.mode("overwrite").parquet(args[1])
    else:
        parts = table.select("paper_id", "page_number", "reading_order", text.element_markdown("label", "text", "reading_order").alias("md")).filter("md is not null")
        pages = parts.groupBy("paper_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("reading_order", "md"))).alias("p"))
        pages.select("paper_id", "page_number", F.array_join(F.transform("p", lambda x: x["md"]), "").alias("md")).write.mode("overwrite").parquet(args[1])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

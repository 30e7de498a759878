import json

import pytest
from pyspark.sql import functions as F

from vellumine.operators import evaluation as E
from vellumine.operators import records as R
from vellumine.sources import files as S

FLAT = "id string, openalex_url string, doi string, title string, publication_year int, work_type string, is_oa boolean, oa_status string, any_repository_has_fulltext boolean, best_oa_pdf_url string, best_oa_source string, best_oa_source_type string, primary_pdf_url string, primary_source string, primary_source_type string, cited_by_count int, is_retracted boolean, is_paratext boolean, lang string, full_json string"


def test_records_are_checked(spark):
    rows = [(1, '{"id": "W1", "title": "t", "publication_year": 2001}'), (2, '{"title": 5, "is_retracted": "no"}'), (3, "[1]"), (4, None), (5, "{"), (6, '{"id": "W6", "title": null, "cited_by_count": 1.5}')]
    good, bad = R.validated(spark.createDataFrame([(*r, "x") for r in rows], "row_id int, record string, error string"), R.record_errors(F.col("record")))
    assert [r.row_id for r in good.collect()] == [1]
    assert {r.row_id: sorted(r.errors) for r in bad.collect()} == {
        2: ["id is missing", "is_retracted has a wrong type", "title has a wrong type"], 3: ["no object"], 4: ["no object"], 5: ["no object"], 6: ["cited_by_count has a wrong type"],
    }


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("en", 2001, True), ("de", 2002, True), (None, 2003, False)], "lang string, year int, oa boolean").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = df.filter(R.filter_predicate(df, "lang:en|de, year:!2001, x"))
    assert [r.year for r in got.collect()] == [2002]
    assert "In(lang, [de,en])" in got._jdf.queryExecution().toString() or "In(lang, [en,de])" in got._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        R.filter_predicate(df, "nothing:1")
    assert df.filter(R.filter_predicate(df, "")).count() == 3


def test_works_are_rebuilt(spark):
    row = ("W1", None, None, "t", None, None, None, None, None, "http://a/b.pdf", None, "repository", None, "kept out", None, None, None, None, None)
    full = json.dumps({"id": "W9", "title": "from the record", "primary_location": {"pdf_url": "p", "source": {"display_name": "s"}}})
    df = spark.createDataFrame([(*row, None), (*row, full), (*row, "{ no")], FLAT)
    a, b, c = (r.w for r in df.select(R.rehydrated(df).alias("w")).collect())
    assert a.best_oa_location.is_oa is True and a.best_oa_location.source is None and a.primary_location is None
    assert (a.cited_by_count, a.is_retracted, a.open_access.is_oa) == (0, False, False) and c == a
    assert b.id == "W9" and b.primary_location.source.display_name == "s"


def test_answers_prices_and_statistics(spark):
    answers = ['```json\n["a", "b"]\n```', '["a"]', "  ```\n[]\n``` ", "no list", None]
    got = [r.x for r in spark.createDataFrame([(a,) for a in answers], "t string").select(R.fenced_array(F.col("t")).alias("x")).collect()]
    assert got == [["a", "b"], ["a"], [], None, None]
    texts = spark.createDataFrame([(i, 10 if i < 100 else 99) for i in range(150)], "i int, n int")
    assert R.cost_from_first(texts, "i", F.col("n"), 2.0).first().n_tokens == 1500
    assert R.cost_from_first(texts.limit(0), "i", F.col("n"), 2.0).first().n_tokens == 0
    one = spark.range(1).select(R.prefixed(F.lit("t"), F.lit("intfloat/E5-base"), True).alias("p"), R.prefixed(F.lit("t"), F.lit("bge"), True).alias("r"), R.metric_cell(F.lit(0.5), True).alias("c")).first()
    assert tuple(one) == ("passage: t", "t", "50.0%")
    none = R.download_statistics(spark.createDataFrame([], "s string, t timestamp"), "s", "t").first()
    assert (none.total_works, none.success_rate, none.duration_seconds) == (0, 0.0, 0.0)
    assert R.html_table(spark.createDataFrame([("<a>", None)], "x string, y string"), ["x", "y"]) == "<table>\n<tr><th>x</th><th>y</th></tr>\n<tr><td>&lt;a&gt;</td><td></td></tr>\n</table>"


def test_results_that_are_there(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"config": "a", "n": 2, "hit_5": 0.5, "precision_5": null, "recall_5": 1.0, "mrr": 0.25}')
    schema = "config string, n long, hit_5 double, precision_5 double, recall_5 double, mrr double"
    rows = S.read_results(spark, str(tmp_path), ["a", "b"], schema)
    assert [tuple(r) for r in E.summary_row(rows, (5,)).collect()] == [("a", 2, "0.500", "—", "1.000", "0.250")]
    assert S.read_results(spark, str(tmp_path), ["b"], schema).count() == 0 and S.read_gold(spark, str(tmp_path / "none")).count() == 0


def test_files_of_many_rows(spark, tmp_path):
    chunks = spark.range(3000).select(F.lit("P1").alias("paper_id"), F.lit("fine").alias("chunk_type"), F.lit("T").alias("paper_title"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), (2999 - F.col("id")).cast("int").alias("chunk_index"),
        F.lit("t\n\"x\"").alias("text"), F.lit(None).cast("array<string>").alias("section_hierarchy"), F.lit(None).cast("int").alias("char_start"), F.lit(5).alias("char_end"), F.lit(3000).alias("total_chunks"), F.lit(None).cast("boolean").alias("overlap_with_previous"))
    assert [tuple(r) for r in S.write_chunk_files(chunks, str(tmp_path / "f")).collect()] == [("P1_fine.json", 3000)]
    body = json.loads((tmp_path / "f/P1_fine.json").read_text())
    assert [c["chunk_index"] for c in body["chunks"]] == list(range(3000)) and body["total_chunks"] == 3000 and body["paper_title"] == "T"
    one = S.read_chunk_files(spark, str(tmp_path / "f")).filter("chunk_index = 7").first()
    assert (one.text, one.section_hierarchy, one.char_start, one.overlap_with_previous) == ("t\n\"x\"", [], 0, False)
    with pytest.raises(Exception, match="(?i)scheme|unrecognized|filesystem"):
        S.write_chunk_files(chunks, "nowhere://a/b").collect()

import pytest
from pyspark.sql import functions as F

from vellumine.functions.numbering import with_row_number
from vellumine.operators import gold
from vellumine.sources import files


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_are_whole_and_stay_with_their_rows(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 3_000_000
        rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("key"), F.concat(F.lit("payload of "), F.col("id").cast("string")).alias("a"), F.sha2(F.col("id").cast("string"), 256).alias("b"))
        got = with_row_number(rows, "key", "row_id")
        one = got.agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("d"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"), F.count_if(F.col("row_id") != F.col("key")).alias("off")).first()
        assert (one.n, one.d, one.lo, one.hi, one.off) == (n, n, 0, n - 1, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_a_value_of_most_rows_is_divided(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 15_000, 5).otherwise(F.col("id")).alias("key"), F.col("id").alias("other"))
    got = with_row_number(rows, "key", "n")
    one = got.agg(F.countDistinct("n").alias("d"), F.max("n").alias("hi"), F.max(F.when(F.col("key") == 5, F.col("n"))).alias("ties")).first()
    assert (one.d, one.hi, one.ties) == (20_000, 19_999, 14_999)
    assert with_row_number(rows.limit(0), ["key", "other"], "n").count() == 0


def test_each_vector_of_an_index_belongs_to_its_id(spark, tmp_path):
    n = 3_000_000
    rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("vec_id")).withColumn("v", F.array(F.col("vec_id").cast("float"), F.lit(1.0).cast("float"))).withColumn("label", F.concat(F.lit("of "), F.col("vec_id").cast("string")))
    files.write_index(rows, str(tmp_path), "vec_id", "v", ["label"])
    back = files.read_index(spark, str(tmp_path))
    wrong = (F.get("embedding", 0) != F.col("vec_id").cast("float")) | (F.col("label") != F.concat(F.lit("of "), F.col("vec_id").cast("string"))) | (F.col("row_id") != F.col("vec_id"))
    one = back.agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong")).first()
    assert (one.n, one.wrong) == (n, 0)


def test_gate_asks_for_agreement_beyond_chance(spark):
    one_sided = [("supports", "supports")] * 96 + [("supports", "unrelated")] * 2 + [("unrelated", "supports")] * 2
    frame = lambda rows: spark.createDataFrame(rows, "annotator_label string, reviewer_label string")
    gate = lambda rows, strict: gold.gate(gold.cohens_kappa(frame(rows)), 0.6, strict).first()
    assert (gate(one_sided, True).verdict, gate(one_sided, True).exit_code, gate(one_sided, False).exit_code) == ("below target", 1, 0)
    assert gate(one_sided, True).kappa < 0
    assert gate([("supports", "supports"), ("unrelated", "unrelated")], True).verdict == "pass"
    assert (gate([], True).verdict, gate([], True).exit_code) == ("undefined", 0)

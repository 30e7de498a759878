from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumine.llm.splitting import cut_points, split_oversized


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n,é😀", max_size=300), st.integers(1, 60), st.integers(0, 59))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    cuts = cut_points(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in cuts) or not text
    for (a, b), (c, e) in zip(cuts, cuts[1:]):
        assert a < c <= b < e and b - c <= overlap


def test_natural_boundaries_first():
    text = "One sentence here. Another one there.\n\nA second paragraph that goes on and on."
    (a, b), *_ = cut_points(text, 50, 0)
    assert text[a:b] == "One sentence here. Another one there.\n\n"
    assert cut_points("x" * 25, 10, 3) == [(0, 10), (7, 17), (14, 24), (21, 25)]


def test_rows(spark):
    rows = [("a", "w " * 50, ["S"], 10, True), ("b", None, None, None, None), ("c", "", ["S"], 0, None), ("d", "short\r\nline", None, None, False), ("e", "y" * 100_000, [], 5, None), ("a", "w " * 50, ["S"], 10, True)]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "chunk_id string, text string, section_hierarchy array<string>, char_start int, overlap_with_previous boolean, piece string, lim int")
    out = split_oversized(df, F.lit(40), F.lit(8)).orderBy("chunk_id", "piece").collect()
    by = {}
    for r in out:
        by.setdefault(r.chunk_id, []).append(r)
    assert set(by) == {"a", "c", "d", "e"} and all(len(r.text) <= 40 for r in out)
    first, second = by["a"][0], by["a"][2]
    assert first.char_start == 10 and first.overlap_with_previous is True and second.overlap_with_previous is True and second.section_hierarchy == ["S"]
    whole = ("w " * 50)
    assert all(whole[r.char_start - 10 : r.char_end - 10] == r.text for r in by["a"])
    assert by["d"][0].text == "short\nline" and by["d"][0].char_start is None and by["c"][0].n_pieces == 1
    assert split_oversized(df.limit(0), F.lit(40), F.lit(8)).count() == 0
    assert split_oversized(df, F.lit(None).cast("int"), F.lit(0)).count() == 5
    assert split_oversized(df.filter("chunk_id = 'e'"), F.lit(40), F.lit(99)).count() > 2500


def test_time_grows_with_the_length(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([("x", "a few words of text; " * (n // 21), ["h"], 5, None)], "chunk_id string, text string, section_hierarchy array<string>, char_start int, overlap_with_previous boolean")
        began = time.perf_counter()
        out = split_oversized(df, F.lit(450), F.lit(50)).agg(F.sum(F.length("text")).alias("n"), F.max("char_end").alias("end")).first()
        assert out.end == 5 + n // 21 * 21 and out.n > n // 21 * 21
        return time.perf_counter() - began

    seconds(500_000)
    assert seconds(8_000_000) < 24 * max(0.5, seconds(500_000))

import re

import pytest
from pyspark.sql import functions as F

from vellumine.operators import chunking as K

TEXTS = [
    "intro\n\n# A\n\ntext one\n\n## B\n" + "\n\n".join(f"para {i} " + "word " * i for i in range(1, 14)) + "\n\n### C\nx\n\n## D\nlast. One more! Yes?",
    "no headings at all\n\n" + "long sentence here. " * 60,
    "# Only\n---\nbody\n\n\n\nend",
    "",
    "a",
    "x" * 700,
]


def brute_pack(text, limit):
    if len(text) <= limit:
        return [text]
    out, cur = [], ""
    for p in (q.strip() for q in re.split(r"\n\n+", text)):
        if not p:
            continue
        if cur and len(cur) + len(p) + 2 > limit:
            out.append(cur)
            cur = p
        else:
            cur = f"{cur}\n\n{p}" if cur else p
    return out + ([cur] if cur else [])


def brute_recursive(text, seps, size):
    if not seps:
        return [text]
    parts = text.split(seps[0])
    if len(parts) == 1:
        return brute_recursive(text, seps[1:], size)
    out = []
    for p in parts:
        out += brute_recursive(p, seps[1:], size) if len(p) > size else [p + seps[0]]
    return out


def brute_recursive_chunks(text, size, least):
    out, cur = [], ""
    for p in brute_recursive(text, list(K.SEPARATORS), size):
        if len(cur) + len(p) > size:
            if cur:
                out.append(cur.strip())
            cur = p
        else:
            cur += p
    return out + ([cur.strip()] if cur and len(cur) >= least else [])


def brute_semantic(text, size, overlap, least):
    def tail(t):
        if len(t) <= overlap:
            return t
        s = t[-overlap:]
        i = s.find(". ")
        return s[i + 2 :] if i >= 0 else s

    def long(p):
        done, cur = [], ""
        for s in re.split(r"(?<=[.!?])\s+", p):
            if len(cur) + len(s) > size:
                if cur:
                    done.append(cur.strip())
                cur = s
            else:
                cur = f"{cur} {s}" if cur else s
        return done + ([cur.strip()] if cur else [])

    out, cur, n = [], "", 0
    for p in (q.strip() for q in text.split("\n\n")):
        if not p:
            continue
        if len(p) > size * 1.5:
            out += ([cur.strip()] if cur else []) + long(p)
            cur, n = "", 0
        elif n + len(p) > size:
            if cur:
                out.append(cur.strip())
            cur, n = (tail(cur) + "\n\n" + p, len(tail(cur)) + len(p)) if overlap else (p, len(p))
        else:
            cur, n = (f"{cur}\n\n{p}" if cur else p), n + len(p)
    return out + ([cur.strip()] if cur and len(cur) >= least else [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(99, None, "clash")], "doc_id int, text string, section string").cache()


def lists(df, column):
    return {r.doc_id: r.c for r in df.select("doc_id", column.alias("c")).collect()}


@pytest.mark.parametrize("limit", [40, 120, 600])
def test_packing(docs, limit):
    got = lists(docs, K.split_at_paragraphs(F.col("text"), limit))
    assert all(got[i] == brute_pack(t, limit) for i, t in enumerate(TEXTS))


@pytest.mark.parametrize("size,overlap,least", [(80, 20, 10), (200, 0, 5), (60, 15, 30)])
def test_semantic_and_recursive(docs, size, overlap, least):
    got = lists(docs, K.semantic_chunks(F.col("text"), size, overlap, least))
    assert all(got[i] == brute_semantic(t, size, overlap, least) for i, t in enumerate(TEXTS))
    got = lists(docs, K.recursive_chunks(F.col("text"), size, least))
    assert all(got[i] == brute_recursive_chunks(t, size, least) for i, t in enumerate(TEXTS))


def test_fixed_windows(docs):
    got = lists(docs, K.fixed_windows(F.col("text"), 50, 10, 20))
    for i, t in enumerate(TEXTS):
        assert got[i] == [w for w in (t[k : k + 50] for k in range(0, len(t), 40)) if len(w) >= 20]
    with pytest.raises(ValueError):
        K.fixed_windows(F.col("text"), 10, 10)


def test_section_stack_and_offsets(docs):
    rows = {(r.doc_id, r.section): r for r in K.sections(docs.select("doc_id", "text")).collect()}
    assert [rows[0, i].hierarchy for i in range(4)] == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"]]
    assert all(TEXTS[i][r.char_start : r.char_end] == r.text for (i, _), r in rows.items())
    assert rows[1, 0].hierarchy == ["Document"] and (99, 0) not in rows


def test_overlap_of_tiny_chunks_is_the_whole_chunk(spark):
    df = spark.createDataFrame([(1, "# A\nx\n# B\ny")], "doc_id int, text string")
    texts = [r.text for r in K.coarse_chunks(df).orderBy("chunk_index").collect()]
    assert texts == ["# A\nx", "# A\nx\n\n# B\ny"]
    assert K.fine_chunks(df).count() == 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert K.fine_chunks(empty).count() == 0

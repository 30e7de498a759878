from pyspark.sql import functions as F

from vellumine.llm.scans import anagram_value, corrections, differences, _value, find_noise, header_kind, misreads, paper_paragraphs, repair, without_page

SCHEMA = "unit_id string, paper_id string, kind string, page int, place int, edge boolean, title string, text string, label string"
TITLE = "The economics of patent pools: a study"


def units(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def body(n):
    return "The regional clusters weaken the measurement of long-term innovation and the output of industrial firms. " * n


def rows():
    out = [(f"b{i}", f"P{i % 7}", "coarse", 0, i, False, None, body(5)) for i in range(40)]
    out += [
        ("g1", "P1", "coarse", 0, 100, False, None, "The rcgional clusters and the rneasurement of 0utput"),
        ("h1", "P1", "coarse", 0, 101, False, None, "the regional clus-\nters weaken long-\nterm innovation"),
        ("h2", "P1", "coarse", 0, 102, False, None, "the out‐"),
        ("h3", "P1", "coarse", 0, 103, False, None, "put of industrial firms"),
        ("n1", "P1", "coarse", 0, 104, False, None, "in the year l999 of"),
        ("e0", "Q", "element", 1, 0, False, TITLE, TITLE),
        ("z", None, "coarse", None, None, None, None, None),
        ("z2", "P1", "coarse", None, None, None, None, ""),
    ]
    for p in range(1, 5):
        out += [
            (f"e{p}h", "Q", "element", p + 1, 0, True, None, f"THE ECONOMICS OF PATENT   {40 + p}"),
            (f"e{p}b", "Q", "element", p + 1, 1, False, None, f"[{p}]"),
            (f"e{p}n", "Q", "element", p + 1, 2, True, None, f"- {40 + p} -"),
        ]
    out.append(("m", "Q", "element", 6, 0, False, None, "45 THE ECONOMICS OF PATENT\nThe regional clusters weaken"))
    return out


def test_noise_of_each_kind(spark):
    n = {k: df.collect() for k, df in find_noise(units(spark, rows() + [rows()[41]])).items()}
    assert {r.unit_id for r in n["hyphen"]} == {"h1", "h2"}
    assert {(r.unit_id, r.word, r.right) for r in n["glyph"]} == {("g1", "rcgional", "regional"), ("g1", "rneasurement", "measurement"), ("g1", "0utput", "output"), ("n1", "l999", "1999")}
    assert {r.unit_id for r in n["header"]} == {"e1h", "e2h", "e3h", "e4h", "m"}
    assert {r.unit_id for r in n["page_no"]} == {"e1n", "e2n", "e3n", "e4n"}


def test_no_units(spark):
    assert all(df.count() == 0 for df in find_noise(units(spark, [])).values())


def test_anagram_values_meet(spark):
    assert misreads("iiriless", "unless") == 2 and misreads("clisclosure", "disclosure") == 1 and misreads("word", "ward") == 0
    assert _value("unless") - _value("iiriless") in differences("iiriless")
    got = spark.createDataFrame([("unless",), ("a†b",)], "w string").select(anagram_value(F.col("w")).alias("v")).collect()
    assert [r.v for r in got] == [_value("unless"), _value("a†b")]
    vocabulary = spark.createDataFrame([("unless", 900), ("iiriless", 3), ("often", 50), ("oftcn", 40)], "word string, n long")
    assert [(r.word, r.right) for r in corrections(vocabulary).collect()] == [("iiriless", "unless")]


def test_lines():
    assert without_page("124 DO FIRMS SHARE") == ("DO FIRMS SHARE", 124) and without_page("Moor et al.   l7") == ("Moor et al.", 17)
    assert header_kind("Moor and others", None) == header_kind("Elwick Journal of Science Policy 18 (2008)", None) == "form"
    assert header_kind("The economics of patent", TITLE) == "sure"
    assert header_kind("Earlier studies of firms use a sentence.", None) is None


def test_repaired_text():
    text = "45 THE ECONOMICS\nThe rcgional clus-\nters and long-\nterm 0utput in l999 incre‐"
    fixed = repair(text, ["45 THE ECONOMICS"], [("clus", "ters")], {"rcgional": "regional", "0utput": "output", "l999": None}, "ase", False)
    assert fixed == "The regional clusters and long-term output in 1999 increase"
    assert repair("ase. Then more", [], [], {}, None, True) == ". Then more"
    assert repair("", [], [], {}, None, False) == ""


def test_paragraphs_go_on_over_pages(spark):
    e = [
        ("a", "P", 1, 0, "para", "The output may incre‐", 300, None), ("b", "P", 1, 1, "fig", "![Figure](x.png)", 400, None), ("c", "P", 1, 2, "foot", "- 7 -", 870, None),
        ("d", "P", 2, 0, "para", "ase. It then goes on and on", 100, None), ("e", "P", 2, 1, "foot", "- 8 -", 870, None), ("d", "P", 2, 0, "para", "ase. It then goes on and on", 100, None), ("f", None, None, None, None, None, None, None),
    ]
    elements = spark.createDataFrame([(a, b, c, d, l, t, (0, y, 1, y + 1) if y else None, "clash") for a, b, c, d, l, t, y, _ in e], "element_id string, paper_id string, page_number int, reading_order int, label string, text string, bbox struct<x1:int,y1:int,x2:int,y2:int>, kind string")
    chunks = spark.createDataFrame([], "chunk_id string, paper_id string, chunk_type string, chunk_index int, paper_title string, text string")
    rows = paper_paragraphs(elements, chunks).orderBy("page", "place").collect()
    assert [(r.page, r.place, r.text) for r in rows] == [(1, 0, "The output may increase. It then goes on and on"), (1, 1, "![Figure](x.png)")]


def test_chunks_give_paragraphs(spark):
    elements = spark.createDataFrame([("a", "P", 1, 0, "para", "Firms share their patents widely", None)], "element_id string, paper_id string, page_number int, reading_order int, label string, text string, bbox struct<x1:int,y1:int,x2:int,y2:int>")
    rows = [
        ("c0", "C", "coarse", 0, False, "# Title\r\n\r\nThe output of indus-\r\ntrial firms. It may grow."), ("c1", "C", "coarse", 1, None, "It may grow.\n\nLater the out‐"), ("c2", "C", "coarse", 2, True, "Later the out‐\n\nput falls again. Then it rises"),
        ("f0", "C", "fine", 0, False, "The output of indus-\ntrial firms."), ("p0", "P", "coarse", 0, False, "Other text of the paper"), ("q0", "Q", "fine", 0, False, "Only fine text stands here"), ("c0", "C", "coarse", 0, False, "# Title\r\n\r\nThe output of indus-\r\ntrial firms. It may grow."),
    ]
    rows += [("w", "W", "coarse", 0, False, "The output of industrial firms")]
    chunks = spark.createDataFrame([(a, b, c, d, o, t, None) for a, b, c, d, o, t in rows], "chunk_id string, paper_id string, chunk_type string, chunk_index int, overlap_with_previous boolean, text string, paper_title string")
    got = {}
    for r in paper_paragraphs(elements, chunks).orderBy("paper_id", "page", "place", "part").collect():
        got.setdefault(r.paper_id, []).append(r.text)
    assert got == {
        "C": ["# Title", "The output of industrial firms. It may grow.", "Later the output falls again. Then it rises"],
        "P": ["Other text of the paper", "Firms share their patents widely"],
        "Q": ["Only fine text stands here"],
        "W": ["The output of industrial firms"],
    }


def test_breaks_at_the_end_are_judged_alike_at_every_size(spark):
    for times in (1, 30):
        out = [(f"b{i}", "P", "coarse", 0, 10 * i, False, None, "Firms meet again and again under long-term and long-term contracts as the under-secretary understands") for i in range(3 * times)]
        out += [(f"x{i}", "P", "coarse", 0, 100_000 + 10 * i, False, None, "Firms meet agai-") for i in range(times)]
        out += [(f"y{i}", "P", "coarse", 0, 200_000 + 10 * i, False, None, "The contracts are long-") for i in range(times)]
        found = {r.unit_id[0] for r in find_noise(units(spark, out))["hyphen"].collect()}
        assert found == {"x"}


def test_text_that_only_fine_chunks_hold_is_given(spark):
    elements = spark.createDataFrame([], "element_id string, paper_id string, page_number int, reading_order int, label string, text string, bbox struct<x1:int,y1:int,x2:int,y2:int>")
    rows = [
        ("c0", "C", "coarse", 0, "The output of the firms grows\nwithout a stop. It may grow more. A coarse text"), ("c1", "C", "coarse", 1, None), ("d0", "D", "coarse", 0, "Nothing of the fine text stands here."),
        ("f0", "C", "fine", 0, "The output of the firms grows without a stop. It may"), ("f1", "C", "fine", 1, "may grow more. Only here do patents count. A coarse text"),
        ("f2", "C", "fine", 2, "Later the out‐"), ("f3", "C", "fine", 3, "put of these firms falls again. It may grow more."), ("f7", "C", "fine", 7, "it stands alone after what was left out."),
        ("g0", "D", "fine", 0, "The output of the firms grows without a stop."), ("n0", None, "fine", 0, "Text of no known paper."), ("f1", "C", "fine", 1, "may grow more. Only here do patents count. A coarse text"),
    ]
    rows += [(f"b{i}", "B", "coarse", i, "The output is high.") for i in range(5)]
    chunks = spark.createDataFrame([(a, b, c, d, False, t, None) for a, b, c, d, t in rows], "chunk_id string, paper_id string, chunk_type string, chunk_index int, overlap_with_previous boolean, text string, paper_title string")
    got = {}
    for r in paper_paragraphs(elements, chunks).filter("label = 'fine'").orderBy("paper_id", "place", "part").collect():
        got.setdefault(r.paper_id, []).append((r.place, r.text))
    assert got == {
        None: [(0, "Text of no known paper.")],
        "C": [(1, "Only here do patents count."), (2, "Later the output of these firms falls again."), (7, "it stands alone after what was left out.")],
        "D": [(0, "The output of the firms grows without a stop.")],
    }

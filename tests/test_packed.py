import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from vellumine.operators.packed import _split, parses, split_packed

FIRST = "Ada Ben Cyr Dora Eli Fay Gus Hal Ida Jon".split()
LAST = "Moor Nash Orr Pike Quin Rowe Sand Tate Ubly Vane".split()


def corpus():
    forms = ("{} {}", '{} "Kit" {}', "{} {}, Jr.", "{} de la {}")  # a few odd forms among the plain ones
    names = [forms[(i * 7 + j) % 10 if (i * 7 + j) % 10 < 4 else 0].format(a, b) for i, a in enumerate(FIRST) for j, b in enumerate(LAST)]
    rows, i = [], 0
    for k in range(0, 96, 4):
        group = names[k : k + 4]
        plain = [f"{FIRST[(k + i) % 10]} {LAST[(k // 10 + i) % 10]}" for i in range(4)]
        for text, group in (
            ("|".join(group), group), ("; ".join(group), group), (", ".join(plain[:-1]) + " and " + plain[-1], plain), ("\n".join(group), group), (json.dumps(group), group),
            (", ".join(f'"{g.split()[1]}, {g.split()[0]}"' for g in plain), plain),
        ):
            rows.append((i, text, group))
            i += 1
    return rows


def test_values_come_back_from_every_packing(spark):
    rows = corpus()
    extra = [(1000, "Sand, Ida", ["Sand, Ida"]), (1001, "|Ada Moor||Ben Nash|", ["Ada Moor", "Ben Nash"]), (1002, 'Ada "Kit" Moor|Ben Nash, Jr.', ['Ada "Kit" Moor', "Ben Nash, Jr."]), (1003, None, []), (1004, "  ", []), (1005, "||", []), (1006, "Ada Moor", ["Ada Moor"])]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t, _ in rows + extra] + [(1006, "Ada Moor", "y", 1)], "id long, names string, pos string, dialect int")
    got = {}
    for r in split_packed(df, "id", ["names"]).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.item)
    for i, text, want in rows + extra:
        found = got.get(i, [])
        assert found == want or [" ".join(reversed(x.split(", "))) for x in found] == want, text


def test_no_rows(spark):
    assert split_packed(spark.createDataFrame([], "id long, names string"), "id", ["names"]).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab ,;|"', min_size=1, max_size=6).map(str.strip).filter(bool), min_size=1, max_size=5), st.sampled_from(["|", ";", ","]))
def test_doubled_quotes_round_trip(items, delimiter):
    packed = delimiter.join('"' + x.replace('"', '""') + '"' for x in items)
    assert _split(packed, re.compile(re.escape(delimiter)), "doubled") == items


def test_a_broken_quote_is_no_parse():
    assert _split('"a" b|c', re.compile(r"\|"), "doubled") is None
    assert all("".join(items) for items in parses('"a|b'))

import json

from vellumine.operators.nested import child_paths, nested_to_flat

SCHEMA = "row_id long, openalex_id string, harvested_at timestamp_ntz, record string, work string, _h int"


def works(spark, *records):
    import datetime as d

    rows = [(i, key, d.datetime(2025, 1, 1) + d.timedelta(days=day) if day is not None else None, r if r is None or isinstance(r, str) else json.dumps(r), "x", 1) for i, (key, day, r) in enumerate(records)]
    return spark.createDataFrame(rows, SCHEMA)


def paths(df):
    return sorted(map(tuple, df.collect()))


def test_shapes_of_every_kind(spark):
    loc = {"pdf_url": "u", "source": {"display_name": "S"}}
    df = works(
        spark,
        ("W1", 0, {"id": "W1", "locations": [None, loc, {"source": None}, "text"], "authorships": {"author": "A. B", "institutions": {"id": "i"}}}),
        ("W2", 0, {"work": {"id": "W2", "locations": json.dumps([loc]), "authorships": None}}),
        ("W3", 0, {"meta": {}, "results": [{"id": "W3", "locations": loc, "authorships": [{"author": None, "institutions": [None, {"id": "i"}]}]}]}),
        ("W4", 0, {"id": "W4"}),
    )
    assert paths(child_paths(df)) == [
        ("W1", "authorship", "0"), ("W1", "institution", "0.0"), ("W1", "location", "1"), ("W1", "location", "2"), ("W1", "source", "1"),
        ("W2", "location", "0"), ("W2", "source", "0"), ("W3", "authorship", "0"), ("W3", "institution", "0.1"), ("W3", "location", "0"), ("W3", "source", "0"),
    ]
    tables = nested_to_flat(df)
    assert {r.author for r in tables["authorship"].collect()} == {"A. B", None}
    assert tables["work"].count() == 4


def test_latest_readable_version_wins(spark):
    old, new = {"id": "W", "locations": [{}]}, {"id": "W", "locations": [{}, {}]}
    df = works(spark, ("W", 0, old), ("W", 2, new), ("W", 3, '{"id": "W", "loc'), ("W", 4, None), ("W", 5, "null"), ("W", 6, "[1]"), ("W", None, old), (None, 9, new), ("W", 2, new))
    assert paths(child_paths(df)) == [("W", "location", "0"), ("W", "location", "1")]


def test_nothing_in_nothing_out(spark):
    empty = works(spark).limit(0) if False else spark.createDataFrame([], SCHEMA)
    assert child_paths(empty).count() == 0
    assert all(t.count() == 0 for t in nested_to_flat(empty).values())
    assert child_paths(works(spark, ("W", 0, ""), ("V", 0, "null"))).count() == 0

import datetime as d
import io
import json

import pyarrow as pa
from pyspark.sql import functions as F

from vellumine.__main__ import main
from vellumine.sources import files as S
from vellumine.sources.ranges import escaped_at, members_from, scan
from vellumine.streaming import incremental


def test_unreadable_files_and_lines_are_set_aside(spark, tmp_path):
    (tmp_path / "P1_coarse.json").write_text(json.dumps({"paper_id": "P1", "chunks": [{"chunk_id": "c", "text": "t\nu"}]}))
    (tmp_path / "P2_coarse.json").write_text("{ not json")
    (tmp_path / "P3_coarse.json").write_text(json.dumps({"paper_id": "P3", "chunks": []}))
    rows = S.read_chunk_files(spark, str(tmp_path), "coarse").collect()
    assert [(r.file, r.chunk_id, r.section_hierarchy) for r in rows] == [("P1_coarse", "c", [])]
    (tmp_path / "works").mkdir()
    (tmp_path / "works/a.jsonl").write_text('{"id": 1}\n[1]\n\nnull\n{"id"\n')
    good, bad = S.read_works(spark, str(tmp_path / "works"))
    assert good.count() == 1 and bad.count() == 4


def test_markdown_and_ids(spark, tmp_path):
    (tmp_path / "P1").mkdir()
    (tmp_path / "P1/document.md").write_bytes("# A\r\nb\rc".encode())
    assert [tuple(r) for r in S.read_markdown(spark, str(tmp_path)).collect()] == [("P1", "# A\nb\nc")]
    (tmp_path / "ids.txt").write_text(" a \n\nb\na\n")
    assert sorted(r.id for r in S.read_id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]


def test_index_keeps_the_order(spark, tmp_path):
    rows = [(i, [float(i)], f"m{i}") for i in (5, 1, 9, 3)]
    S.write_index(spark.createDataFrame(rows, "vec_id int, v array<double>, m string"), str(tmp_path / "i"), "vec_id", "v", ["m"])
    assert [(r.row_id, r.vec_id, r.m, r.embedding) for r in S.read_index(spark, str(tmp_path / "i")).orderBy("row_id").collect()] == [(k, i, f"m{i}", [float(i)]) for k, i in enumerate((1, 3, 5, 9))]


def test_tables_and_failures(spark):
    df = spark.createDataFrame([("a", 0.5, None), ("b", None, "e")], "name string, x double, error string")
    assert S.markdown_table(df, ["name", "x"]) == "| name | x |\n|---|---|\n| a | 0.500 |\n| b | — |"
    good, bad = S.split_failures(df, "error")
    assert good.columns == ["name", "x"] and good.count() == bad.count() == 1


def test_repeated_events_come_once(spark, tmp_path):
    t = d.datetime(2025, 1, 1)
    parts = [[(1, t, "a"), (2, t + d.timedelta(hours=9), "a")], [(2, t + d.timedelta(hours=9), "a"), (3, t + d.timedelta(hours=1), "a"), (4, t + d.timedelta(hours=10), "a")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "event_id int, ts timestamp_ntz, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    once = incremental.first_seen(incremental.replay(spark, str(tmp_path / "in"), schema), "event_id", "ts")
    q = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    ids = [r.event_id for r in spark.table("once").collect()]
    assert len(ids) == len(set(ids)) and {1, 2, 4} <= set(ids)  # 3 is late: it may be dropped


def test_documents_are_chunked_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"# T{i}\nbody") for i in range(5)], "doc_id int, text string")
    for _ in range(2):
        docs.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda c: incremental.chunk_stream(incremental.replay(spark, str(tmp_path / "in"), docs.schema), str(tmp_path / "out"), str(tmp_path / c)).awaitTermination()
    run("c1")
    run("c2")  # a lost checkpoint replays everything
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_command_line(spark, tmp_path, capsys):
    docs = spark.createDataFrame([(1, "# T\nbody")], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    assert main(["chunk", str(tmp_path / "docs"), str(tmp_path / "chunks")]) == 0 and spark.read.parquet(str(tmp_path / "chunks")).count() == 2
    assert main(["nothing"]) == 2 and main(["info"]) == 0 and "p1_found" in capsys.readouterr().out


def test_an_object_is_read_in_ranges(spark, tmp_path):
    texts = ['a "b", {c', "\\", '\\"', "x" * 300, "}{][,:", "é†\n\r\t", "", '"}', "\\" * 37 + '"', "last"]
    chunks = {str(i): {"chunk_id": f"c{i}", "text": t, "section_hierarchy": ["s, {", '"'], "char_start": i} for i, t in enumerate(texts)}
    (tmp_path / "lines.json").write_text(json.dumps(chunks, indent=1, ensure_ascii=False))
    (tmp_path / "one.json").write_text(json.dumps(chunks))
    for name in ("lines.json", "one.json"):
        at = str(tmp_path / name)
        data = (tmp_path / name).read_bytes()
        file, n = pa.PythonFile(io.BytesIO(data), "r"), len(data)
        for step in (1, 2, 3, 7, 64, 1000, n):
            quoted, depth, members = False, 0, []
            for start in range(0, n, step):
                members += [json.loads(m) for m in members_from(file, start, min(start + step, n), n, quoted, depth)]
                block = scan(data[start : start + step], escaped_at(file, start))
                depth += block.depth(quoted)
                quoted ^= len(block.quotes) % 2 == 1
            assert members == [{k: c} for k, c in chunks.items()] and (quoted, depth) == (False, 0)
        assert sorted(str(json.loads(r.member)) for r in S.object_members(spark, at, 500).collect()) == sorted(str({k: c}) for k, c in chunks.items())
        rows = S.read_chunk_map(spark, at).orderBy("row_id").collect()
        assert [(r.row_id, r.chunk_id, r.text, r.section_hierarchy, r.char_start) for r in rows] == [(i, f"c{i}", t, ["s, {", '"'], i) for i, t in enumerate(texts)]
    for i, text in enumerate(("{}", "", '{"0": {"chunk_id": "c"}', '{"0": {"chunk_id": "c}}')):
        (tmp_path / f"none{i}.json").write_text(text)
        assert S.read_chunk_map(spark, str(tmp_path / f"none{i}.json")).count() == 0


def test_no_task_holds_a_whole_map(spark, tmp_path):
    (tmp_path / "m.json").write_text("{" + ",".join(f'"{i}":' + json.dumps({"chunk_id": f"c{i}", "text": "t" * 50_000}) for i in range(200)) + "}")
    rows = S.read_chunk_map(spark, str(tmp_path / "m.json"))
    per_task = [r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.sum(F.length("text")).alias("n")).collect()]
    assert sum(per_task) == 10_000_000 and max(per_task) < 6_000_000

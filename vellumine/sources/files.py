"""Readers and writers of the file formats documents, chunks, gold pairs and indexes come in."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions.numbering import with_row_number
from vellumine.sources import schemas
from vellumine.sources.ranges import escaped_at, members_from, scan

RANGE_BYTES = 4 << 20  # of a file that is read in ranges
MOST_TASKS = 1000  # that ranges are spread over; each reads its ranges one after the other


def _name(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


# ---- readers --------------------------------------------------------------------------------
def read_works(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(works, rejected)``: JSON lines as ``(row_id, record)``; lines that hold no object are rejected, not lost."""
    lines = spark.read.text(path).select(F.col("value").alias("record"), F.monotonically_increasing_id().alias("row_id"))
    ok = F.try_variant_get(F.try_parse_json("record"), "$", "struct<id:variant>").isNotNull()
    return lines.filter(ok), lines.filter(~ok)


def read_chunk_files(spark: SparkSession, path: str, chunk_type: str | None = None) -> DataFrame:
    """One row per chunk of ``<paper>_<type>.json`` files, with its file; unreadable files are skipped.

    A missing key gets its default: no hierarchy, no overlap, offsets 0. Order by ``file`` and
    ``chunk_index`` for the order of the files' names.
    """
    raw = spark.read.schema(schemas.CHUNK_FILE).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", f"*_{chunk_type or '*'}.json").json(path)
    rows = raw.select(_name(r"([^/]+)\.json$").alias("file"), F.explode("chunks").alias("c"))
    return _with_defaults(rows.select("file", "c.*"))


def _with_defaults(chunks: DataFrame) -> DataFrame:
    defaults = {"section_hierarchy": F.array().cast("array<string>"), "overlap_with_previous": F.lit(False), "char_start": F.lit(0), "char_end": F.lit(0), "text": F.lit("")}
    return chunks.withColumns({c: F.coalesce(c, d) for c, d in defaults.items()})


def read_bare_chunk_files(spark: SparkSession, path: str, chunk_type: str | None = None) -> DataFrame:
    """The same of ``<paper>_<type>_chunks.json`` files, each a list of chunks."""
    raw = spark.read.schema(schemas.CHUNK).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", f"*_{chunk_type or '*'}_chunks.json").json(path)
    return _with_defaults(raw.select(_name(r"([^/]+)_chunks\.json$").alias("file"), "*"))


def write_chunk_map(chunks: DataFrame, path: str, name: str) -> None:
    """One JSON object from row number to chunk: what an index calls its metadata."""
    fields = [c.split()[0] for c in schemas.CHUNK.split(", ")]
    numbered = with_row_number(chunks.select(*fields), ["paper_id", "chunk_type", "chunk_index", "chunk_id"], "_row")
    item = F.concat(F.lit('"'), F.col("_row").cast("string"), F.lit('":'), F.to_json(F.struct(*fields)))
    write_arrays(numbered, path, F.lit(name), item, ["_row"], F.lit("{"), F.lit("}")).count()


def read_chunk_map(spark: SparkSession, path: str) -> DataFrame:
    """``(row_id, chunk fields)`` of such an object: keys are row numbers written as text.

    The object is read in byte ranges by many tasks, whatever its size and its line ends; see ``object_members``.
    """
    one = F.from_json("member", f"map<string, struct<{', '.join(c.replace(' ', ': ', 1) for c in schemas.CHUNK.split(', '))}>>").alias("m")
    rows = object_members(spark, path).select(one).select(F.explode("m").alias("k", "c"))
    return rows.select(F.col("k").cast("long").alias("row_id"), "c.*")


def object_members(spark: SparkSession, path: str, step: int = RANGE_BYTES) -> DataFrame:
    """``(member)``: each member of the JSON object that a file holds, as an object of its own.

    A first pass over ranges of ``step`` bytes tells how each one changes the depth, for a range that
    begins inside a string and for one that does not; one small row per range gives the state at every range's
    start. A second pass cuts the members out: a range gives those that begin in it and reads on to the end of its last one,
    so a task holds one range and one member. A file that does not end its object gives no members.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    ranges = files.select("path", F.explode(F.expr(f"sequence(0L, length - 1, {step}L)")).alias("start"), "length")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, start, length in zip(b["path"], b["start"], b["length"]):
                storage, name = _storage(at)
                with storage.open_input_file(name) as f:
                    found = scan(f.read_at(min(step, length - start), start), escaped_at(f, start))
                yield pd.DataFrame({"path": [at], "start": [start], "length": [length], "odd": [len(found.quotes) % 2 == 1], "outside": [found.depth(False)], "inside": [found.depth(True)]})

    spread_ = lambda df, n: df.repartition(min(max(n, 1), MOST_TASKS))
    n = files.agg(F.sum(F.ceil(F.col("length") / step))).first()[0] or 0
    measured = spread_(ranges, n).mapInPandas(measure, "path string, start long, length long, odd boolean, outside long, inside long").collect()  # one row per range
    by_file: dict[str, list] = {}
    for r in sorted(measured, key=lambda r: (r.path, r.start)):
        by_file.setdefault(r.path, []).append(r)
    states = []
    for rows in by_file.values():
        quoted, depth, of_file = False, 0, []
        for r in rows:
            of_file.append((r.path, r.start, r.length, quoted, depth))
            depth += r.inside if quoted else r.outside
            quoted ^= r.odd
        if not quoted and depth == 0:
            states += of_file

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, start, length, quoted, depth in zip(b["path"], b["start"], b["length"], b["quoted"], b["depth"]):
                storage, name = _storage(at)
                with storage.open_input_file(name) as f:
                    members = list(members_from(f, start, min(start + step, length), length, bool(quoted), depth))
                if members:
                    yield pd.DataFrame({"member": members})

    begun = spark.createDataFrame(states, "path string, start long, length long, quoted boolean, depth long")
    return spread_(begun, len(states)).mapInPandas(cut_out, "member string")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """``(paper_id, text)`` of ``<paper>/document.md`` files, line ends as LF."""
    files = spark.read.option("pathGlobFilter", "document.md").option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(_name(r"([^/]+)/document\.md$").alias("paper_id"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_gold(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Gold pairs of JSON array files, with the member file they came from; a missing path holds no pairs."""
    paths = [p for p in ([paths] if isinstance(paths, str) else paths) if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], f"{schemas.GOLD}, member_file string")
    return spark.read.schema(schemas.GOLD).option("multiLine", True).json(paths).withColumn("member_file", _name(r"([^/]+)$"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids, one per line; blanks around them and empty lines are dropped. A missing file holds no ids."""
    if not exists(spark, path):
        return spark.createDataFrame([], "id string")
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("id")).filter("id <> ''").distinct()


def list_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """``(path, folder, name, length, modified)`` without reading any content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(row_id, embedding, metadata columns)`` of an index folder; both of its parts must exist."""
    vectors, meta = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/metadata")
    return vectors.join(meta, "row_id")


def read_results(spark: SparkSession, path: str, configs: Iterable[str], schema: str) -> DataFrame:
    """The results of the configurations whose file ``<config>.json`` is there; none gives no rows."""
    there = [f"{path}/{c}.json" for c in configs if exists(spark, f"{path}/{c}.json")]
    return spark.read.schema(schema).option("multiLine", True).json(there) if there else spark.createDataFrame([], schema)


# ---- writers --------------------------------------------------------------------------------
def write_typed(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    df.write.mode("overwrite").option("compression", "snappy").partitionBy(*partition_by).parquet(path)


def _storage(path: str):
    """``(file system, path)`` of a folder, opened where the code runs. A scheme that is not supported is an error, never a local file."""
    from pyarrow import fs

    path = path.replace("s3a://", "s3://", 1).replace("file:///", "/", 1).replace("file:/", "/", 1)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_arrays(rows: DataFrame, path: str, name: Column, item: Column, order: list[str], head: Column, tail: Column) -> DataFrame:
    """One file per name, ``head``, then the name's items in order parted by commas, then ``tail``; gives ``(name, n_items)``.

    Rows come to a task sorted by name and order, by a sort that spills; each is written as it comes,
    so no file is ever held whole. ``head`` and ``tail`` are the same in all rows of a name. Files get
    their name when they are complete, and a task that is run again writes the same ones. Rows without
    a name or an item are left out.
    """
    shaped = rows.select(name.alias("name"), item.alias("item"), head.alias("head"), tail.alias("tail"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]).filter("name is not null and item is not null")
    keys = [f"_o{i}" for i in range(len(order))]
    shaped = shaped.repartition("name").sortWithinPartitions("name", *keys).select("name", "item", "head", "tail")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        storage, root = _storage(path)
        now = out = end = None
        n = 0
        unique = uuid.uuid4().hex

        def close() -> pd.DataFrame:
            out.write(end.encode())
            out.close()
            storage.move(f"{root}/{now}.{unique}", f"{root}/{now}")
            return pd.DataFrame({"name": [now], "n_items": [n]})

        for b in batches:
            for key, item, head, tail in zip(b["name"], b["item"], b["head"], b["tail"]):
                if key != now:
                    if out is not None:
                        yield close()
                    now, end, n = key, tail, 0
                    storage.create_dir(f"{root}/{now}".rpartition("/")[0], recursive=True)
                    out = storage.open_output_stream(f"{root}/{now}.{unique}")
                    out.write(head.encode())
                out.write((("," if n else "") + item).encode())
                n += 1
        if out is not None:
            yield close()

    return shaped.mapInPandas(put, "name string, n_items long")


def write_chunk_files(chunks: DataFrame, path: str, bare: bool = False) -> DataFrame:
    """``<paper>_<type>.json`` files, each an object with its chunks and their number; ``bare``: ``<paper>_<type>_chunks.json``, a list of them."""
    fields = [c.split()[0] for c in schemas.CHUNK.split(", ")]
    chunks = chunks.select(*fields)
    sizes = chunks.groupBy("paper_id", "chunk_type").agg(F.max("paper_title").alias("_title"), F.count("*").cast("int").alias("_n"))
    rows = chunks.join(sizes, ["paper_id", "chunk_type"])
    stem = F.concat("paper_id", F.lit("_"), "chunk_type")
    item = F.to_json(F.struct(*fields))
    if bare:
        return write_arrays(rows, path, F.concat(stem, F.lit("_chunks.json")), item, ["chunk_index", "chunk_id"], F.lit("["), F.lit("]"))
    about = F.to_json(F.struct("paper_id", F.col("_title").alias("paper_title"), "chunk_type", F.col("_n").alias("total_chunks")))
    head = F.concat(F.expr("left(_about, length(_about) - 1)"), F.lit(',"chunks":['))
    return write_arrays(rows.withColumn("_about", about), path, F.concat(stem, F.lit(".json")), item, ["chunk_index", "chunk_id"], head, F.lit("]}"))


def write_named(df: DataFrame, path: str, name: Column, body: str) -> DataFrame:
    """One file per row, its text as it is; gives ``(name, n_items)``. Of rows with one name the last is kept."""
    last = df.select(name.alias("_name"), F.col(body).alias("_body")).groupBy("_name").agg(F.max("_body").alias("_body"))
    return write_arrays(last, path, F.col("_name"), F.col("_body"), [], F.lit(""), F.lit(""))


def write_index(vectors: DataFrame, path: str, id_col: str, vector_col: str, meta: list[str]) -> None:
    """Vectors and metadata under row numbers in the order of the id, both from the same numbered rows; the metric is chosen at query time."""
    rows = with_row_number(vectors.select(id_col, F.col(vector_col).alias("embedding"), *meta), id_col, "row_id")
    rows.select("row_id", "embedding").write.mode("overwrite").parquet(f"{path}/vectors")
    rows.select("row_id", id_col, *meta).write.mode("overwrite").parquet(f"{path}/metadata")


def split_failures(df: DataFrame, error_col: str) -> tuple[DataFrame, DataFrame]:
    """``(good rows, failed rows)`` for a failure side output."""
    return df.filter(F.col(error_col).isNull()).drop(error_col), df.filter(F.col(error_col).isNotNull())


def markdown_table(rows: DataFrame, headers: list[str]) -> str:
    """A small result (one row per configuration) as a Markdown table; null as an em dash, doubles with three decimals."""
    cell = lambda v: "—" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(headers) + " |", "|" + "---|" * len(headers)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[h]) for h in headers) + " |" for r in rows.select(*headers).collect()])


def summary_json(one_row: DataFrame) -> str:
    return json.dumps(json.loads(one_row.select(F.to_json(F.struct("*"))).first()[0]), indent=2, sort_keys=True)

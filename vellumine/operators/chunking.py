"""Markdown documents to chunks: document rows in, chunk rows out, as column expressions.

A document is one row, so sections, paragraphs, numbering and overlap are higher-order expressions
on that row: no text is ever shuffled, and every plan here is a scan, a projection and a generate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.binding import let
from vellumine.functions.text import strip

# Fixed value: what a heading line looks like.
HEADING = r"^(#{1,6})\s+(.+)$"


def clean_markdown(text: Column) -> Column:
    """Page rules to blank lines, more than one blank line to one."""
    return F.regexp_replace(F.regexp_replace(text, r"\n---+\n", "\n\n"), r"\n{3,}", "\n\n")


_SECTION = "struct<hierarchy:array<string>,text:string,char_start:int,char_end:int,line_no:int,level:int>"
_STATE = f"struct<off:int,line:int,stack:array<struct<level:int,heading:string>>,done:array<{_SECTION}>>"


def section_array(text: Column) -> Column:
    """The sections of a text; empty where it has no heading.

    The text is cut before every heading line; a fold carries the offset and the stack of headings."""
    pieces = F.split(text, r"\n(?=#{1,6}[^\S\n][^\n])")

    def step(s: Column, p: Column) -> Column:
        return let(F.substring_index(p, "\n", 1), lambda first: let(F.length(F.regexp_extract(first, HEADING, 1)), lambda level: grown(s, p, first, level)))

    def grown(s: Column, p: Column, first: Column, level: Column) -> Column:
        own = F.struct(level.alias("level"), F.regexp_extract(first, HEADING, 2).alias("heading"))
        off, line = s["off"] + F.length(p) + 1, s["line"] + F.size(F.split(p, "\n"))
        make = lambda stack, done: F.struct(off.alias("off"), line.alias("line"), stack.alias("stack"), done.alias("done"))
        section = lambda stack: F.struct(
            F.transform(stack, lambda h: h["heading"]).alias("hierarchy"), p.alias("text"), s["off"].alias("char_start"), (s["off"] + F.length(p)).alias("char_end"), s["line"].alias("line_no"), level.alias("level")
        )
        pushed = F.concat(F.filter(s["stack"], lambda h: h["level"] < level), F.array(own))
        return F.when(level > 0, let(pushed, lambda stack: make(stack, F.concat(s["done"], F.array(section(stack)))))).otherwise(make(s["stack"], s["done"]))

    start = F.struct(F.lit(0).alias("off"), F.lit(0).alias("line"), F.array().cast("array<struct<level:int,heading:string>>").alias("stack"), F.array().cast(f"array<{_SECTION}>").alias("done")).cast(_STATE)
    return F.aggregate(pieces, start, step, lambda s: s["done"])


def headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, line_no, offset, level, heading)`` of every heading line."""
    rows = docs.select(F.col(id_col), F.explode(section_array(F.col(text_col))).alias("s"))
    return rows.select(id_col, "s.line_no", F.col("s.char_start").alias("offset"), "s.level", F.element_at("s.hierarchy", -1).alias("heading"))


def _sections_or_whole(text: Column) -> Column:
    whole = F.struct(F.array(F.lit("Document")).alias("hierarchy"), text.alias("text"), F.lit(0).alias("char_start"), F.length(text).alias("char_end"), F.lit(0).alias("line_no"), F.lit(0).alias("level")).cast(_SECTION)
    return let(section_array(text), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(whole)))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, section, hierarchy, text, char_start, char_end)``: a section runs from its heading to the next.

    ``hierarchy`` is the stack of headings above it and its own. Text before the first heading is in
    no section; a document without headings is one section named ``Document``. Null texts give none.
    """
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(_sections_or_whole(F.col(text_col))).alias("section", "s"))
    return rows.select(id_col, "section", "s.hierarchy", "s.text", "s.char_start", "s.char_end")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\n+"), lambda p: strip(p)), lambda p: p != "")


def _closed(s: Column, last: Column, least: int) -> Column:
    """A fold's finished chunks and, if it is long enough, the one it was at. (As the fold's last step: outside, the fold would run once per mention.)"""
    return F.when(F.length(s["cur"]) >= max(least, 1), F.concat(s["done"], F.array(last))).otherwise(s["done"])


def pack(parts: Column, limit: int, glue: str = "\n\n") -> Column:
    """Parts joined greedily while they fit; a part above the limit stays whole."""
    state = "struct<done:array<string>,cur:string>"
    return F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur")).cast(state),
        lambda s, p: F.when(s["cur"] == "", F.struct(s["done"].alias("done"), p.alias("cur")))
        .when(F.length(s["cur"]) + F.length(p) + len(glue) > limit, F.struct(F.concat(s["done"], F.array(s["cur"])).alias("done"), p.alias("cur")))
        .otherwise(F.struct(s["done"].alias("done"), F.concat(s["cur"], F.lit(glue), p).alias("cur"))),
        lambda s: _closed(s, s["cur"], 1),
    )


def split_at_paragraphs(text: Column, limit: int) -> Column:
    """A text within the limit as it is, else its paragraphs packed."""
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(pack(paragraphs(text), limit))


def with_overlap(text: Column, previous: Column, pct: float) -> Column:
    """The text after the tail of the previous one. A tail of no characters means the whole of it."""
    n = F.floor(F.length(previous) * pct).cast("int")
    tail = F.regexp_replace(F.when(n == 0, previous).otherwise(F.right(previous, n)), r"^\s+", "")
    return F.when(previous.isNull(), text).otherwise(F.concat(tail, F.lit("\n\n"), text))


def _raw_chunks(text: Column, limit: int) -> Column:
    """The packed paragraphs of all sections, in order, with their section's hierarchy and start."""
    cut = lambda s: F.transform(split_at_paragraphs(s["text"], limit), lambda r: F.struct(r.alias("raw"), s["hierarchy"].alias("hierarchy"), s["char_start"].alias("char_start")))
    return F.flatten(F.transform(_sections_or_whole(clean_markdown(text)), cut))


def coarse_array(text: Column, limit: int = 2500, pct: float = 0.1) -> Column:
    """The coarse chunks of a text as ``array<struct<text, hierarchy, char_start>>``; the overlap crosses sections."""
    lap = lambda raws: F.transform(
        raws, lambda c, i: F.struct(with_overlap(c["raw"], F.when(i > 0, F.get(raws, i - 1)["raw"]), pct).alias("text"), c["hierarchy"].alias("hierarchy"), c["char_start"].alias("char_start"))
    )
    return let(_raw_chunks(text, limit), lap)


def _chunk_rows(docs: DataFrame, id_col: str, chunks: Column, overlaps: Column) -> DataFrame:
    # each element takes the total along: the array itself must not stay beside its exploded rows
    counted = let(chunks, lambda all_: F.transform(all_, lambda c: F.struct(c.alias("c"), F.size(all_).alias("n"))))
    rows = docs.filter(F.col("_t").isNotNull()).select(id_col, F.posexplode(counted).alias("chunk_index", "x")).select(id_col, "chunk_index", F.col("x.n").alias("total_chunks"), F.col("x.c").alias("c"))
    return rows.select(
        id_col, "chunk_index", "total_chunks", "c.text", F.col("c.hierarchy").alias("section_hierarchy"), "c.char_start",
        (F.col("c.char_start") + F.length("c.text")).alias("char_end"), overlaps.alias("overlap_with_previous"),
    )


def coarse_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2500, pct: float = 0.1) -> DataFrame:
    """``(id, chunk_index, total_chunks, text, section_hierarchy, char_start, char_end, overlap_with_previous)``."""
    docs = docs.select(id_col, F.col(text_col).alias("_t"))
    return _chunk_rows(docs, id_col, coarse_array(F.col("_t"), limit, pct), F.col("chunk_index") > 0)


def fine_chunks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 450, pct: float = 0.2, coarse_limit: int = 2500, coarse_pct: float = 0.1
) -> DataFrame:
    """Coarse chunks cut again; the overlap starts anew in each coarse chunk, the index runs through the document."""

    def cut(c: Column) -> Column:
        lap = lambda raws: F.transform(
            raws, lambda r, i: F.struct(with_overlap(r, F.when(i > 0, F.get(raws, i - 1)), pct).alias("text"), c["hierarchy"].alias("hierarchy"), c["char_start"].alias("char_start"), (i > 0).alias("lap"))
        )
        return let(pack(paragraphs(c["text"]), limit), lap)

    docs = docs.select(id_col, F.col(text_col).alias("_t"))
    return _chunk_rows(docs, id_col, F.flatten(F.transform(coarse_array(F.col("_t"), coarse_limit, coarse_pct), cut)), F.col("c.lap"))


def fixed_windows(text: Column, size: int = 1024, overlap: int = 100, least: int = 100) -> Column:
    """Windows of one size, those below ``least`` left out."""
    if size <= overlap or overlap < 0:
        raise ValueError("the overlap must lie below the size")
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.filter(F.transform(starts, lambda i: text.substr(i + 1, F.lit(size))), lambda c: F.length(c) >= least)


def overlap_text(text: Column, n: int) -> Column:
    """The last ``n`` characters, from the first sentence that begins in them."""
    tail = F.right(text, F.lit(n))
    at = F.locate(". ", tail)
    return F.when(F.length(text) <= n, text).when(at > 0, tail.substr(at + 2, F.length(tail))).otherwise(tail)


def split_long(text: Column, size: int) -> Column:
    """Sentences joined greedily; sizes leave the blank between them out of account."""
    state = "struct<done:array<string>,cur:string>"
    return F.aggregate(
        F.split(text, r"(?<=[.!?])\s+"),
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur")).cast(state),
        lambda s, p: F.when(
            F.length(s["cur"]) + F.length(p) > size,
            F.struct(F.when(s["cur"] != "", F.concat(s["done"], F.array(strip(s["cur"])))).otherwise(s["done"]).alias("done"), p.alias("cur")),
        ).otherwise(F.struct(s["done"].alias("done"), F.when(s["cur"] != "", F.concat(s["cur"], F.lit(" "), p)).otherwise(p).alias("cur"))),
        lambda s: _closed(s, strip(s["cur"]), 1),
    )


def semantic_chunks(text: Column, size: int = 1024, overlap: int = 100, least: int = 100) -> Column:
    """Paragraphs joined up to the size, with a sentence overlap; a paragraph above one and a half
    sizes is cut by sentences. Only the last chunk must have ``least`` characters."""
    state = "struct<done:array<string>,cur:string,n:int>"
    make = lambda done, cur, n: F.struct(done.alias("done"), cur.alias("cur"), n.cast("int").alias("n"))
    flushed = lambda s: F.when(s["cur"] != "", F.concat(s["done"], F.array(strip(s["cur"])))).otherwise(s["done"])

    def step(s: Column, p: Column) -> Column:
        tail = overlap_text(s["cur"], overlap)
        started = make(flushed(s), F.concat(tail, F.lit("\n\n"), p), F.length(tail) + F.length(p)) if overlap > 0 else make(flushed(s), p, F.length(p))
        return (
            F.when(F.length(p) > size * 1.5, make(F.concat(flushed(s), split_long(p, size)), F.lit(""), F.lit(0)))
            .when(s["n"] + F.length(p) > size, started)
            .otherwise(make(s["done"], F.when(s["cur"] != "", F.concat(s["cur"], F.lit("\n\n"), p)).otherwise(p), s["n"] + F.length(p)))
        )

    parts = F.filter(F.transform(F.split(text, "\n\n"), lambda p: strip(p)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n")).cast(state)
    return F.aggregate(parts, start, step, lambda s: _closed(s, strip(s["cur"]), least))


# Fixed value: the order in which separators are tried.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def _recursive_parts(text: Column, separators: tuple[str, ...], size: int) -> Column:
    if not separators:
        return F.array(text)
    first, rest = separators[0], separators[1:]
    parts = F.split(text, first.replace(".", r"\."))
    deeper = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > size, _recursive_parts(p, rest, size)).otherwise(F.array(F.concat(p, F.lit(first))))))
    return F.when(F.size(parts) == 1, _recursive_parts(text, rest, size)).otherwise(deeper)


def recursive_chunks(text: Column, size: int = 1024, least: int = 100, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Pieces between separators, finer ones only where a piece is too large, joined up to the size."""
    state = "struct<done:array<string>,cur:string>"
    return F.aggregate(
        _recursive_parts(text, separators, size),
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur")).cast(state),
        lambda s, p: F.when(
            F.length(s["cur"]) + F.length(p) > size,
            F.struct(F.when(s["cur"] != "", F.concat(s["done"], F.array(strip(s["cur"])))).otherwise(s["done"]).alias("done"), p.alias("cur")),
        ).otherwise(F.struct(s["done"].alias("done"), F.concat(s["cur"], p).alias("cur"))),
        lambda s: _closed(s, strip(s["cur"]), least),
    )


def chunk_rows(docs: DataFrame, chunks: Column, id_col: str = "doc_id") -> DataFrame:
    """``(id, chunk_index, text, length, word_count)`` from an array of chunks per document."""
    rows = docs.select(id_col, F.posexplode(chunks).alias("chunk_index", "text"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return rows.select(id_col, "chunk_index", "text", F.length("text").alias("length"), words.alias("word_count"))

"""Texts over a size limit, cut at natural boundaries with an overlap.

The tokens' sizes are summed to offsets once per text; boundaries are sorted arrays of offsets,
one per kind (paragraph, line, sentence, clause, word). The end of a piece is the last boundary
within the limit, found by binary search in the best kind that has one in the later half of the
piece, then in any; without one the cut is hard. A text costs time in proportion to its length: each
piece leaves with its own text only. The next piece starts ``overlap`` before that end,
moved to the next word's start where there is one. Texts within the limit never leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = [re.compile(p) for p in (r"\n[^\S\n]*\n\s*", r"\n\s*", r"(?<=[.!?])[\"')\]]*\s+", r"(?<=[;:,])\s+", r"\s+")]
_TOKEN = re.compile(r"\S+\s*|\s+")


def line_feeds(c: str | Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """``[start, end)`` of each piece; the pieces cover the text, and none is longer than ``limit``."""
    if len(text) <= limit:
        return [(0, len(text))]
    ends = np.cumsum([len(t) for t in _TOKEN.findall(text)])
    starts = np.concatenate([[0], ends[:-1]])  # a word never starts inside a token
    bounds = [np.array([m.end() for m in k.finditer(text)], np.int64) for k in _KINDS[:-1]] + [ends]
    out, at = [], 0
    while len(text) - at > limit:
        end = 0
        for least in (at + max(limit // 2, overlap + 1), at + overlap + 1):
            for b in bounds:
                i = np.searchsorted(b, at + limit, side="right") - 1
                if i >= 0 and b[i] >= least:
                    end = int(b[i])
                    break
            if end:
                break
        end = end or at + limit
        out.append((at, end))
        back = max(at + 1, end - overlap)
        i = np.searchsorted(starts, back, side="left")
        at = int(starts[i]) if overlap and i < len(starts) and starts[i] < end else back if overlap else end
    out.append((at, len(text)))
    return out


_BATCH = 8_000_000  # characters of pieces that are handed on at once


def split_oversized(
    chunks: DataFrame,
    limit: Column,
    overlap: Column,
    id_col: str = "chunk_id",
    text_col: str = "text",
    hierarchy_col: str = "section_hierarchy",
    start_col: str = "char_start",
    flag_col: str = "overlap_with_previous",
) -> DataFrame:
    """``(id, piece, n_pieces, text, section_hierarchy, char_start, char_end, overlap_with_previous)``.

    One row per piece, ``piece`` counting from 0; a text within its limit is its own only piece.
    Line ends become LF first. ``char_start`` is the input's plus the piece's place in the text,
    ``char_end`` is exact, both null where the input's is. ``overlap_with_previous`` of the first
    piece is the input's, of a later piece whether it repeats text of the one before. A null text
    gives no row, an empty one an empty piece; a null limit cuts nothing. An overlap below 0 or of
    the limit or more is taken as the nearest overlap that makes progress. Repeated rows are kept.
    """
    rows = chunks.select(
        F.col(id_col).alias("id"),
        line_feeds(text_col).alias("t"),
        F.col(hierarchy_col).alias("h"),
        F.col(start_col).alias("s"),
        F.col(flag_col).alias("f"),
        limit.cast("int").alias("lim"),
        overlap.cast("int").alias("lap"),
    ).filter("t is not null")
    over = F.col("lim").isNotNull() & (F.length("t") > F.col("lim"))
    fit = rows.filter(~over).select("id", "h", "s", "f", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.lit(0).alias("a"), F.length("t").alias("b"), F.lit(0).alias("before"), F.col("t").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["id", "h", "s", "f", "piece", "n_pieces", "a", "b", "before", "text"]
        out, size = [], 0
        for b in batches:
            for i, h, s, f, t, lim, lap in zip(b["id"], b["h"], b["s"], b["f"], b["t"], b["lim"], b["lap"].fillna(0).astype(int)):
                cuts = cut_points(t, max(1, lim), min(max(0, lap), max(1, lim) - 1))
                before = 0
                for piece, (x, y) in enumerate(cuts):  # each piece with its own text only
                    out.append((i, h, s, f, piece, len(cuts), x, y, before, t[x:y]))
                    before, size = y, size + y - x
                    if size > _BATCH:
                        yield pd.DataFrame(out, columns=columns).astype({"s": "Int64"})
                        out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=columns).astype({"s": "Int64"})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "h", "s", "f")}
    cuts = rows.filter(over).mapInPandas(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", piece int, n_pieces int, a int, b int, before int, text string")
    return fit.unionByName(cuts).select(
        F.col("id").alias(id_col),
        "piece",
        "n_pieces",
        "text",
        F.col("h").alias("section_hierarchy"),
        (F.col("s") + F.col("a")).cast("int").alias("char_start"),
        (F.col("s") + F.col("b")).cast("int").alias("char_end"),
        F.when(F.col("piece") == 0, F.col("f")).otherwise(F.col("a") < F.col("before")).alias("overlap_with_previous"),
    )

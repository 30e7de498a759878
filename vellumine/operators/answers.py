"""Structured answers: a summary's bullet points and an analysis' subsections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions.text import strip

# The two parts of an answer, up to the heading that follows.
_SUMMARY = r"(?is)(#{0,2}\s*Executive Summary.*?)(?=#{1,2}\s*Detailed Analysis|Detailed Analysis|\z)"
_DETAILS = r"(?is)(#{0,2}\s*Detailed Analysis.*?)(?=#{1,2}\s*(?:Key References|References)|\z)"


def summary_points(answer: Column) -> Column:
    """The summary's bullet points, or the whole summary as one; empty where there is none."""
    text = F.regexp_extract(answer, _SUMMARY, 1)
    lines = F.filter(F.split(text, "\n"), lambda x: strip(x).rlike("^[-•]"))
    points = F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^[\s\-•*]+", ""))), lambda x: x != "")
    whole = strip(F.regexp_replace(text, r"(?i)#{0,2}\s*Executive Summary", ""))
    return F.when(F.size(points) > 0, points).otherwise(F.filter(F.array(whole), lambda x: x != ""))


def detail_sections(answer: Column) -> Column:
    """``(title, content)`` of the analysis' subsections, or the whole analysis as one."""
    text = F.regexp_extract(answer, _DETAILS, 1)
    parts = F.slice(F.split(text, r"###?\s+"), F.lit(2), F.greatest(F.size(F.split(text, r"###?\s+")) - 1, F.lit(0)))
    first = lambda p: F.coalesce(F.nullif(strip(F.substring_index(p, "\n", 1)), F.lit("")), F.lit("Analysis"))
    rest = lambda p: F.when(p.contains("\n"), strip(F.regexp_replace(p, r"^[^\n]*\n", ""))).otherwise(F.lit(""))
    sections = F.filter(F.transform(parts, lambda p: F.struct(first(p).alias("title"), rest(p).alias("content"))), lambda s: s["content"] != "")
    whole = strip(F.regexp_replace(text, r"(?i)#{0,2}\s*Detailed Analysis", ""))
    one = F.filter(F.array(F.struct(F.lit("Detailed Analysis").alias("title"), whole.alias("content"))), lambda s: s["content"] != "")
    return F.when(F.size(sections) > 0, sections).otherwise(one)

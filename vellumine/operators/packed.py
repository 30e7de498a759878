"""Fields that pack several values into one text: one row per value.

Every field is parsed under each candidate dialect (a set of delimiters and a way of quoting). A
parse's description length is the bits its values cost under a code learned from the whole
corpus, plus the bits for its separators and its dialect; the cheapest parse wins. The code is a
second-order Markov chain over atom classes (capitalised word, initial, particle, scheme, digits,
each punctuation mark), so its size is bounded by the alphabet, not by the data: at most
``len(ALPHABET) ** 3`` counts per field. Counts are summed inside each task, then across tasks.

How a field is parsed and what its values cost depend on its form alone: which words are
capitalised, suffixes, conjunctions or schemes, its marks and its blanks. Fields are therefore counted
by form first, the code is learned from the forms with their numbers, and a task scores each form
once; only the chosen dialect is then applied to the field as written.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.session import cut
from vellumine.sources.tables import spread

# Name suffixes that belong to the name before them, and list conjunctions.
SUFFIXES = ("Jr", "Sr", "II", "III", "IV", "PhD", "MD")
CONJUNCTIONS = ("and", "und", "et", "y")

_NO_SUFFIX = rf"(?!\s*(?:{'|'.join(SUFFIXES)})\b)"
_AND = rf"(?:{'|'.join(CONJUNCTIONS)}|&)"
#: Delimiter sets by name, as patterns.
DELIMITERS = {
    "pipe": r"\|",
    "double pipe": r"\|\|",
    "semicolon": r";",
    "semicolon blank": r";\s+|;$",
    "comma": rf",{_NO_SUFFIX}",
    "comma blank": rf",\s+{_NO_SUFFIX}|,$",
    "prose": rf",?\s+{_AND}\s+|,{_NO_SUFFIX}",
    "pipe or semicolon": r"\||;",
    "pipe or comma": rf"\||,{_NO_SUFFIX}",
    "semicolon or comma": rf";|,{_NO_SUFFIX}",
    "tab": r"\t",
    "newline": r"\r?\n",
    "slash": r"\s/\s",
    "backslash": r"\\",
    "blank": r"\s+",
}
_BY_NAME = {name: re.compile(p) for name, p in DELIMITERS.items()}
#: Of each group of signs a text must have one, for the dialect to differ from the plainer ones.
_NEEDS = {
    "pipe": ("|",), "double pipe": (("||",),), "semicolon": (";",), "semicolon blank": (";",), "comma": (",",), "comma blank": (",",), "prose": ((*CONJUNCTIONS, "&"),), "pipe or semicolon": ("|", ";"), "pipe or comma": ("|", ","),
    "semicolon or comma": (";", ","), "tab": ("\t",), "newline": ("\n",), "slash": ("/",), "backslash": ("\\",), "blank": (),
}
_EMPTY = "|;,/\\\"'[]<>& \t\r\n"
QUOTES = ("none", "doubled", "escaped")
_TRIED = [(name, re.compile(p), quote) for name, p in DELIMITERS.items() for quote in QUOTES]

START, END = "^", "$"
MARKS = "|;,/\\\"'<>[](){}&-.:=?_\t\n"
#: Every atom class; all other characters count as ``o``.
ALPHABET = (START, END, "U", "I", "C", "l", "S", "A", "d", "o", *MARKS)
_ATOM = re.compile(r"https?://|[^\W\d_]\.(?!\w)|[^\W\d_]+|\d+|[\t\n]|\S")


def atoms(text: str) -> list[str]:
    out = []
    for a in _ATOM.findall(text):
        if a[0].isalpha():
            if a.endswith("://"):
                out.append("U")
            elif a.endswith("."):
                out.append("I")
            elif a in SUFFIXES:
                out.append("S")
            elif a in CONJUNCTIONS:
                out.append("A")
            else:
                out.append("C" if a[0].isupper() else "l")
        elif a[0].isdigit():
            out.append("d")
        else:
            out.append(a if a in MARKS else "o")
    return out


def _split(text: str, delimiter: re.Pattern, quote: str) -> list[str] | None:
    """The items between delimiters, quotes honoured and undone; None where the quoting does not fit."""
    if quote == "none":
        return delimiter.split(text)
    body = re.compile(r'\s*"((?:[^"]|"")*)"\s*' if quote == "doubled" else r'\s*"((?:[^"\\]|\\.)*)"\s*', re.S)
    items, at = [], 0
    while True:
        m = body.match(text, at)
        if m:
            items.append(m[1].replace('""', '"') if quote == "doubled" else re.sub(r"\\(.)", r"\1", m[1]))
            if m.end() == len(text):
                return items
            d = delimiter.match(text, m.end())
            if not d:  # white space before the delimiter may be part of it
                d = delimiter.match(text, len(text[: m.end()].rstrip()))
            if not d:
                return None
        else:
            d = delimiter.search(text, at)
            if not d:
                items.append(text[at:])
                return items
            items.append(text[at : d.start()])
        at = d.end()


def parses(text: str) -> dict[tuple[str, ...], tuple[str, float]]:
    """Each different parse of a text with the name and separator bits of the plainest dialect that gives it."""
    if not text.strip(_EMPTY):  # delimiters, brackets and quotes around nothing
        return {}
    out: dict[tuple[str, ...], tuple[str, float]] = {(text.strip(),): ("whole", 0.0)}

    def add(items, name, bits):
        found = tuple(x for x in (x.strip() for x in items) if x)
        cost = bits * max(0, len(items) - 1) + 1.0 * (len(items) - len(found))
        if found and (found not in out or out[found][1] > cost):
            out[found] = (name, cost)

    s = text.strip()
    if s[:1] == "[" and s[-1:] == "]":
        try:
            got = json.loads(s)
            if isinstance(got, list) and all(x is None or isinstance(x, str) for x in got):
                add([x or "" for x in got], "json", 0.5)
        except ValueError:
            pass
    if s[:1] == "<" and re.fullmatch(r"<[^<>]*>(?:[\s;,|]*<[^<>]*>)*[\s;,|]*", s):
        add(re.findall(r"<([^<>]*)>", s), "angle", 0.5)
    for name, delimiter, quote in _TRIED:
        if not all(any(c in text for c in some) for some in _NEEDS[name]):
            continue  # no such delimiter, or the same parse as under a plainer dialect
        if quote != "none" and '"' not in text or quote == "escaped" and "\\" not in text or quote == "none" and not delimiter.search(text):
            continue
        items = _split(text, delimiter, quote)
        if items is not None:
            add(items, name if quote == "none" else f"{name}, {quote}", 1.0 + 0.5 * (" or " in name or name == "prose") + 0.5 * (quote != "none"))
    return out


def form(value: Column) -> Column:
    """The field with each word and number replaced by one of its kind; fields with quotes, brackets or escapes stay as they are."""
    kept = "|".join((*SUFFIXES, *CONJUNCTIONS))
    word = rf"(?<!\p{{L}})(?!(?:{kept}|https?(?=://))(?!\p{{L}}))"
    out = F.regexp_replace(value, rf"{word}\p{{Lu}}\p{{L}}+", "Xx")
    out = F.regexp_replace(out, rf"{word}[\p{{Ll}}\p{{Lo}}\p{{Lt}}\p{{Lm}}]\p{{L}}+", "xx")
    return F.when(value.rlike(r'["\[<\\]'), value).otherwise(F.regexp_replace(out, r"\d+", "0"))


def _trigrams(values: Counter) -> Counter:
    """What the chain counts of values ``(field, value): weight``."""
    counts: Counter = Counter()
    for (field, value), weight in values.items():
        a, b = START, START
        for c in (*atoms(value), END):
            counts[field, a, b, c] += weight
            a, b = b, c
    return counts


class ValueCode:
    """Bits of a value: order 2, backing off to order 1 and to a uniform code."""

    def __init__(self, rows: list[tuple[str, str, str, str, float]]):
        self.three, self.two, self.one, self.over = Counter(), Counter(), Counter(), Counter()
        for field, a, b, c, n in rows:
            self.three[field, a, b, c] += n
            self.two[field, a, b] += n
            self.one[field, b, c] += n
            self.over[field, b] += n
        self.known: dict[tuple, float] = {}
        self.values: dict[tuple[str, str], float] = {}

    def bits(self, field: str, value: str) -> float:
        got = self.values.get((field, value))
        if got is None:
            if len(self.values) > _KEPT:
                self.values.clear()
            got = self.values[field, value] = self._bits(field, value)
        return got

    def _bits(self, field: str, value: str) -> float:
        total, a, b = 0.0, START, START
        for c in (*atoms(value), END):
            key = (field, a, b, c)
            if key not in self.known:
                low = (self.one[field, b, c] + 1.0 / len(ALPHABET)) / (self.over[field, b] + 1.0)
                self.known[key] = -math.log2((self.three[key] + 2.0 * low) / (self.two[field, a, b] + 2.0))
            total += self.known[key]
            a, b = b, c
        return total


def cheapest(text: str, field: str, code: ValueCode) -> tuple[tuple[str, ...], str]:
    """The parse of least description length; ties go to fewer items, then to the dialect's name."""
    return _least([(items, name, extra) for items, (name, extra) in parses(text).items()], field, code)


def _least(found: list[tuple], field: str, code: ValueCode) -> tuple[tuple[str, ...], str]:
    best = min(((sum(code.bits(field, x) for x in items) + extra, len(items), name, items) for items, name, extra in found), default=None)
    return (best[3], best[2]) if best else ((), "none")


# a form's parses as one text, so that they are found once and read in every round
_ITEM, _PART, _PARSE = "\x1f", "\x1e", "\x1d"


def _written(text: str) -> str:
    return _PARSE.join(_PART.join((name, repr(extra), _ITEM.join(items))) for items, (name, extra) in parses(text).items())


def _read(parsed: str) -> list[tuple]:
    out = []
    for one in parsed.split(_PARSE) if parsed else ():
        name, extra, items = one.split(_PART)
        out.append((tuple(items.split(_ITEM)), name, float(extra)))
    return out


_KEPT = 500_000  # values and forms that a task remembers the result of; a speed setting
_COUNTS = "field_name string, a string, b string, c string, n double"


def _learn(forms: DataFrame, code: ValueCode | None) -> ValueCode:
    """Counts over all fields, of every parse in equal shares or, with a code, of the cheapest one."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values: Counter = Counter()
        counts: Counter = Counter()
        for batch in batches:
            for field, parsed, n in zip(batch["field_name"], batch["parsed"], batch["n"]):
                found = _read(parsed)
                if code is None:
                    for items, name, _ in found:
                        if name != "whole" or len(found) == 1:  # a text that some dialect splits teaches nothing unsplit
                            for x in items:
                                values[field, x] += n / len(found) ** 2  # clear-cut fields teach more
                else:
                    for x in _least(found, field, code)[0]:
                        values[field, x] += n
            if len(values) > _KEPT:
                counts.update(_trigrams(values))
                values.clear()
        counts.update(_trigrams(values))
        yield pd.DataFrame([(*k, v) for k, v in counts.items()], columns=["field_name", "a", "b", "c", "n"])

    # at most len(ALPHABET) ** 3 rows per field, whatever the input's size
    total = forms.mapInPandas(count, _COUNTS).groupBy("field_name", "a", "b", "c").agg(F.sum("n").alias("n"))
    return ValueCode([tuple(r) for r in total.collect()])


def parsed_as(text: str, name: str) -> tuple[str, ...] | None:
    """The text's parse under a dialect by its name; None where it does not fit."""
    if name == "whole":
        return (text.strip(),)
    if name in ("json", "angle"):
        return next((items for items, (found, _) in parses(text).items() if found == name), None)
    base, _, quote = name.partition(", ")
    items = _split(text, _BY_NAME[base], quote or "none")
    return None if items is None else tuple(x for x in (x.strip() for x in items) if x)


def split_packed(rows: DataFrame, key: str, fields: list[str], rounds: int = 3) -> DataFrame:
    """``(key, field_name, pos, item, dialect)``: one row per value packed in ``fields`` of ``rows``.

    ``pos`` counts from 0 over the non-empty values of a field; ``item`` is the value as written,
    without surrounding blanks and enclosing quotes, with the quoting's escapes undone. Null, empty
    and blank fields, and lists of nothing but delimiters, give no row. Repeated rows count once;
    rows with a null key are kept under the null key. Other columns are ignored.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])
    long = rows.select(F.col(key).alias("_key"), F.inline(pairs)).filter("value is not null and trim(value) <> ''").distinct()
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(parsed=[_written(x) for x in batch["form"]])[["field_name", "parsed", "n"]]

    clean = F.translate(form(F.col("value")), _ITEM + _PART + _PARSE, "   ")
    counted = long.groupBy("field_name", clean.alias("form")).agg(F.count("*").alias("n"))
    forms = cut(spread(counted).mapInPandas(parse, "field_name string, parsed string, n long"))
    code = None
    for _ in range(rounds):
        code = _learn(forms, code)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chosen: dict[tuple[str, str], str] = {}
        for batch in batches:
            dialects, items = [], []
            for text, field, shape in zip(batch["value"], batch["field_name"], batch["form"]):
                name = chosen.get((field, shape))
                if name is None:
                    if len(chosen) > _KEPT:
                        chosen.clear()
                    name = chosen[field, shape] = cheapest(shape, field, code)[1]
                found = () if name == "none" else parsed_as(text, name)
                if found is None:
                    found, name = cheapest(text, field, code)
                dialects.append(name)
                items.append(list(found))
            yield batch[["_key", "field_name"]].assign(dialect=dialects, items=items)

    kind = rows.schema[key].dataType.simpleString()
    out = long.withColumn("form", form(F.col("value"))).mapInPandas(emit, f"_key {kind}, field_name string, dialect string, items array<string>")
    return out.select(F.col("_key").alias(key), "field_name", F.posexplode("items").alias("pos", "item"), "dialect")

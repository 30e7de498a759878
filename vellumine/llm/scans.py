"""Noise of scanned pages: found per unit of text, and repaired into paragraphs.

Two passes over the texts and a few joins of small tables. The first pass counts words inside
each task and notes line-end breaks, lone numbers and lines that may be running headers. In SQL,
rare words then meet frequent confusable variants: a word's anagram value is the sum of the fifth
powers of its characters' codes, a misread changes it by a known difference, so an equi-join on
``value + difference`` finds every candidate, which is then checked letter by letter; the most
frequent candidate ranks first. Breaks are judged by how often the corpus writes the joined word
and the hyphenated one. Lone numbers are page numbers where they move with the pages. Running
headers are lines that start the paper's title, or recur in the paper, at a page's edge or beside a
page number. The second pass names the units that hold a misread word, leaving headers and page numbers aside.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.session import cut, written

# What a scanner reads, and what was printed.
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("0", "o"), ("1", "i"), ("1", "l"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"),
    ("ii", "u"), ("u", "ii"), ("rn", "m"), ("m", "rn"), ("q", "g"), ("g", "q"), ("li", "h"), ("h", "li"), ("vv", "w"), ("w", "vv"), ("ç", "c"), ("†", "t"), ("y", "v"),
    ("v", "y"), ("l", "i"), ("i", "l"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
)
# What may be noise at all; each is a bound on a form, none on a number of rows, and all hold at every size.
MOST_MISREADS = 3  # in one word
LONGEST_EDGE_LINE = 110  # characters of a line that holds a header or a page number; without the number LONGEST_HEADER
LONGEST_HEADER = 90
LONGEST_PAGE_LINE = 30
MOST_PAGE_DIGITS = 5
LONGEST_WORD = 64  # longer strings are no words; misreads are sought in words up to LONGEST_MISREAD
LONGEST_MISREAD = 40
LONGEST_HALF = 80  # characters at a unit's end in which a broken word's first half is sought
AHEAD_ON_PAGE, AHEAD_ON_NEXT = 6, 4  # layout elements in which a word broken at a unit's end may go on
AHEAD_IN_CHUNKS = 2
PAGES_OFF = 50  # pages by which a number may break the order of those around it (misread digits, repeated text)
#: Bits of the filter of known anagram values. A shift that leads to no known value is dropped before the
#: join; a speed setting that changes no result.
FILTER_BITS = 1 << 24
#: The second pass skips sound words that make up more than one part in so many of all words. There can be no
#: more of them than this number, whatever the corpus; a speed setting that changes no result.
SKIPPED_WORDS = 200_000
#: A half of a broken word is a word of its own if it is at least one in so many of all words, whatever the corpus.
WORD_PARTS = 500_000

_FIRST_HALF = re.compile(r"(?:[^\W_]+-)*[^\W_][^\W_\d]*$")
_SECOND_HALF = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_SIGNS = ("-", "‐", "¬", "­")
_SIGN_AT_LINE_END = re.compile(r"[-‐¬­][ \t]*\n[ \t]*")
BREAK_AT_END = re.compile(r"([^\W\d_]+)[-‐¬­]\s*$")
_LINES = re.compile(r"\r\n?")
_NOT_TEXT = re.compile(r"<[^<>]*>|!\[[^\]]*\]\([^)]*\)|\$[^$\n]*\$|\\[a-z]+|[a-z]_\{[^}]*\}")
_STRIP = ".,;:()[]{}\"'“”‘’!?*#|<>=+$^_/\\—–-"
_N = r"[\dlIOo](?:[\dlIOo]| (?=[\dlIOo]))*"
PAGE_LINE = re.compile(rf"^(?:[-—–]\s*)?(?:p\.|pp\.|page|seite|página|S\.)?\s*\[?({_N})\]?(?:\s*(?:of|von|de|/)\s*[\dlIOo]+)?(?:\s*[-—–])?$", re.I)
NUMBER_MISREAD = re.compile(r"^(?=[^\d]*\d)(?=.*[OoIlSB])[\dOoIlSB]+(?:[.,][\dOoIlSB]+)*$")
_ODD = re.compile(r"[\d†çﬁﬂﬀﬃﬄ]")
_SELF = re.compile(r"^[a-z]*(?:[a-z][015†][a-z]+|[a-z]+[015†][a-z])[a-z015†]*$|^[05†1][a-z]{3,}$|^[a-z]{4,}[05†]$")
_ORDINAL = re.compile(r"^\d+(?:st|nd|rd|th|s|er|e|a|o|d|sls|x|k)$")
_LEADING = re.compile(rf"^({_N})\s+(?=\D|[0-9][^\W\d])")
_TRAILING = re.compile(rf"(?:\s*\|\s*|\s{{2,}})(?:p\.\s*)?({_N})$")
_AUTHORS = re.compile(r"^[A-ZÀ-Þ0-9][\w'’-]+(?: (?:and|&|und|et|y) [A-ZÀ-Þ][\w'’-]+)?,? (?:et al\.?|and others|u\. a\.|ET AL\.?|AND OTHERS)$")
_SERIES = re.compile(
    r"^(?:(?:[\w'’-]+ ){0,4}(?:Journal|JOURNAL|Review|REVIEW|Papers|PAPERS|Letters|LETTERS|Bulletin|BULLETIN|Quarterly|QUARTERLY|Annals|ANNALS|Proceedings|Transactions|Discussion Series|DISCUSSION SERIES|Paper Series|Zeitschrift|Revue|Revista)"
    r"(?: (?:of|in|on|for|and|des|de|für|OF|IN|ON|FOR|AND) [\w ,&'’-]{3,60}?|\b)"
    r"|(?:[\w'’-]+ ){0,3}(?:Discussion|Working|Technical|Policy|Research|DISCUSSION|WORKING) [Pp](?:aper|APER)s?(?: [Ss]eries)?)(?:,? (?:[Vv]ol\.?|[Nn]o\.?|NO\.?|VOL\.?|Nr\.?|Band)?\s?[\dlO]+)?(?:,? ?(?:[Nn]o\.?)? ?\([\dlO]{1,4}\))?$"
)
_ZERO_IN_WORD = re.compile(r"(?<=[^\W\d_])0(?=[^\W\d_])|(?<![\w.,])0(?=[^\W\d_])|(?<=[^\W\d_])0(?!\w)")


def tidy(text: str) -> str:
    return _LINES.sub("\n", text) if "\r" in text else text


def breaks_in(text: str) -> Iterator[tuple[int, int, str, str]]:
    """``(start, end, first, second)`` of each word that a line end cuts in two, found from the sign at the line's end."""
    done = 0
    for m in _SIGN_AT_LINE_END.finditer(text):
        at = m.start()
        line = max(done, text.rfind("\n", done, at) + 1)
        word = max(line, text.rfind(" ", line, at) + 1)
        if (a := _FIRST_HALF.search(text, word, at)) and (b := _SECOND_HALF.match(text, m.end())):
            yield a.start(), b.end(), a[0], b[0]
            done = b.end()


def mend_breaks(text: str, mended: Callable[[str, str], str]) -> str:
    parts, at = [], 0
    for a, b, first, second in breaks_in(text):
        parts += [text[at:a], mended(first, second)]
        at = b
    return "".join([*parts, text[at:]]) if parts else text


def fold(text: str) -> str:
    """A line with case, spacing and the common misreads set aside."""
    s = " ".join(text.lower().split())
    for a, b in (("0", "o"), ("1", "i"), ("l", "i"), ("5", "s"), ("rn", "m"), ("vv", "w"), ("ri", "n"), ("ii", "u"), ("ci", "d"), ("c", "e"), ("ç", "e"), ("†", "t"), ("q", "g"), ("iu", "h"), ("ih", "h"), ("h", "ii"), ("ﬁ", "fi"), ("ﬀ", "ff")):
        s = s.replace(a, b)
    return s


def digits(s: str) -> int | None:
    d = re.sub(r"\D", "", s.replace("l", "1").replace("I", "1").replace("O", "0").replace("o", "0"))
    return int(d) if d and len(d) <= MOST_PAGE_DIGITS else None


_folded = lru_cache(maxsize=4096)(fold)


def without_page(line: str) -> tuple[str, int | None]:
    """A line without the page number that stands before or after it."""
    s = " ".join(line.split()) if "|" in line else line.strip()
    if not (s[-1:].isdigit() or s[-1:] in "lIOo" or s[:1].isdigit() or s[:1] in "lIOo"):
        return s, None
    if m := _TRAILING.search(s):
        return s[: m.start()].strip(), digits(m[1])
    if (m := _LEADING.match(s)) and len(m[1]) <= 4:
        return s[m.end() :].strip(), digits(m[1])
    if (m := re.search(rf"\s\|\s({_N})$", s)) or (m := re.match(rf"({_N})\s\|\s", s)):
        return (s[: m.start()] + s[m.end() :]).strip(), digits(m[1])
    return s, None


def may_be_edge(bare: str) -> bool:
    """A cheap test that every page number and running header passes, and most lines of running text do not."""
    first = bare[0]
    return not first.islower() and (bare[-1] not in ".,;:" or bare[-2:] == "l." or bare[-2:] in ("L.", "a.")) or len(bare) <= LONGEST_PAGE_LINE and any(map(str.isdigit, bare)) or first in "lo"


def header_kind(core: str, title: str | None) -> str | None:
    """``sure`` where a line is the start of the title, ``form`` where it reads like authors or a series,
    ``maybe`` where it could be a running header; None where it is running text. Of the last two see ``_headers``."""
    line = _ZERO_IN_WORD.sub("o", " ".join(core.split()))
    line = line[:1].upper() + line[1:]
    if not line or len(line) > LONGEST_HEADER or line[0] in "#-*|>!$<" or not (core[0].isupper() or core[0] in "015"):
        return None
    if _AUTHORS.match(line) or _SERIES.match(line):
        return "form"
    if line[-1] in ".!;,:" and not line.isupper():
        return None
    words = line.split()
    if title and len(words) >= 3 and len(line) >= 12 and _folded(title).startswith(fold(line).rstrip("?")):
        return "sure"
    return "maybe" if 2 <= len(words) <= 9 else None


# ---- the first pass -------------------------------------------------------------------------
_NOTES = "note string, unit_id string, paper_id string, kind string, page int, place int, key string, key2 string, n long, edge boolean"


def word_of(token: str) -> str:
    return token.strip(_STRIP).lower()


def _first_word(text: str) -> str | None:
    """The first word of a text of several words; no page number and no formula has one."""
    m = re.match(r"\s*([^\W\d_]{2,})[ ,;.:)-]+\S+\s\S+", text)
    return m[1] if m and not PAGE_LINE.match(text[:40].strip()) else None


def _units_of(batch: pd.DataFrame):
    return zip(batch["unit_id"], batch["paper_id"], batch["kind"], batch["page"], batch["place"], batch["edge"], batch["title"], batch["text"])


def _note_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word counts of the task, and what each unit's lines may be."""
    columns = [c.split()[0] for c in _NOTES.split(", ")]
    tokens: Counter = Counter()

    def words() -> pd.DataFrame:
        counts: Counter = Counter()
        for t, n in tokens.items():
            w = word_of(t)
            if 1 < len(w) <= LONGEST_WORD:
                counts[w] += n
        tokens.clear()
        return pd.DataFrame([("word", None, None, None, 0, 0, w, None, n, False) for w, n in counts.items()], columns=columns)

    for b in batches:
        out = []
        for unit, paper, kind, page, place, edge, title, text in _units_of(b):
            if not text:
                continue
            text = tidy(text)
            lines = text.split("\n")
            body = lines if "\n" in text else None
            if len(lines) == 1 and kind == "element" and edge is False:
                lines = []  # a single line in the middle of a page is neither
            for i, line in enumerate(lines):
                if len(line) > LONGEST_EDGE_LINE or not (bare := line.strip()) or not may_be_edge(bare):
                    continue
                if len(bare) <= LONGEST_PAGE_LINE and (m := PAGE_LINE.match(bare)):
                    if any(c.isdigit() for c in m[1]) or len(lines) == 1:
                        out.append(("number", unit, paper, kind, page, place, bare, None, digits(m[1]), bool(edge) and len(lines) == 1))
                        if body:
                            body = [x for x in body if x != line]
                    continue
                core, number = without_page(bare)
                what = header_kind(core, title)
                if what == "maybe" and number is None and not edge and (kind != "element" and title or 0 < i < len(lines) - 1 and kind == "element"):
                    continue  # a line of running text
                if what:
                    out.append((what, unit, paper, kind, page, place, fold(core), bare, number, bool(edge) and len(lines) == 1))
                    if what in ("sure", "form") and body:
                        body = [x for x in body if x != line]
            if body:
                text = "\n".join(body)
            if text.rstrip()[-1:] in _SIGNS and (m := BREAK_AT_END.search(text, max(0, len(text) - LONGEST_HALF))):
                out.append(("end", unit, paper, kind, page, place, m[1].lower(), None, None, False))
            if (w := _first_word(text)) and w[0].islower():
                out.append(("start", unit, paper, kind, page, place, w.lower(), None, None, False))
            if "\n" in text and _SIGN_AT_LINE_END.search(text):
                for _, _, first, second in breaks_in(text):
                    out.append(("break", unit, paper, kind, page, place, first.lower(), second.lower(), None, False))
                text = mend_breaks(text, lambda first, second: " ")
            tokens.update(_NOT_TEXT.sub(" ", text).split() if any(c in text for c in "<$\\!") else text.split())
        if len(tokens) > 500_000:
            yield words()
        if out:
            yield pd.DataFrame(out, columns=columns).astype({"n": "Int64"})
    yield words()


# ---- rare words and their frequent variants -------------------------------------------------
def anagram_value(w: Column) -> Column:
    """The sum of the fifth powers of the characters' codes (reduced below 1000, so that it cannot overflow)."""
    return F.aggregate(F.split(w, ""), F.lit(0).cast("long"), lambda s, c: s + F.pow(F.ascii(c) % 997, F.lit(5)).cast("long"))


def _value(s: str) -> int:
    return sum((ord(c) % 997) ** 5 for c in s)


def differences(word: str) -> list[int]:
    """Every change of the anagram value by up to ``MOST_MISREADS`` misreads that the word's letters allow."""
    found = [(word.count(a), _value(b) - _value(a)) for a, b in CONFUSIONS if a in word]
    total: set[int] = set()
    ranges = [range(min(n, MOST_MISREADS) + 1) for n, _ in found]

    def grow(i: int, left: int, value: int) -> None:
        if i == len(found):
            total.add(value)
            return
        for k in ranges[i]:
            if k > left:
                break
            grow(i + 1, left - k, value + k * found[i][1])

    grow(0, MOST_MISREADS, 0)
    return sorted(total - {0})


def misreads(word: str, right: str) -> int:
    """The fewest confusions that turn ``right`` into ``word``; 0 if none do."""
    best = {(0, 0): 0}
    for i, j in product(range(len(word) + 1), range(len(right) + 1)):
        if (i, j) not in best:
            continue
        n = best[i, j]
        if i < len(word) and j < len(right) and word[i] == right[j]:
            best[i + 1, j + 1] = min(best.get((i + 1, j + 1), 99), n)
        for a, b in CONFUSIONS:
            if word.startswith(a, i) and right.startswith(b, j):
                best[i + len(a), j + len(b)] = min(best.get((i + len(a), j + len(b)), 99), n + 1)
    return best.get((len(word), len(right)), 0)


def _value_filter(known: DataFrame):
    """A bitmap of ``FILTER_BITS`` bits, sent to the tasks: which anagram values some known word may have."""
    at = known.select(F.pmod("av", F.lit(FILTER_BITS)).alias("at"))
    per = at.groupBy(F.shiftright("at", 3).alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(at % 8 as int)))").alias("bits"))
    rows = per.groupBy(F.shiftright("byte", 12).alias("part")).agg(F.collect_list(F.struct("byte", "bits")).alias("x"))
    table = np.zeros(FILTER_BITS >> 3, np.uint8)
    for r in rows.toLocalIterator():  # FILTER_BITS / 2^15 rows of at most 4,096 bytes
        for byte, value in r.x:
            table[byte] = value
    return known.sparkSession.sparkContext.broadcast(table)


def corrections(vocabulary: DataFrame, ratio: float = 8.0, least: int = 10) -> DataFrame:
    """``(word, right, n, n_right)``: the most frequent variant that each misread word stands for.

    ``vocabulary(word, n)``. A word of letters only needs four letters and a variant at least
    ``ratio`` times as frequent, met ``least`` times; one with a sign no word has in its middle
    needs any more frequent variant. No vocabulary gives no corrections.
    """

    known = vocabulary.filter((F.col("n") >= 2) & F.col("word").rlike(r"^[\p{L}'’-]+$")).select(F.col("word").alias("right"), F.col("n").alias("n_right"), anagram_value(F.col("word")).alias("av"))
    bits = _value_filter(known)

    @F.pandas_udf("array<long>")
    def candidates(words: pd.Series, values: pd.Series) -> pd.Series:
        """The anagram values that a misread of some known word would have had to start from."""
        out = []
        for w, v in zip(words, values):
            a = np.array(differences(w), np.int64) + v
            b = a % FILTER_BITS
            out.append(a[(bits.value[b >> 3] >> (b & 7)) & 1 == 1])
        return pd.Series(out)

    @F.pandas_udf("int")
    def checked(words: pd.Series, rights: pd.Series) -> pd.Series:
        return pd.Series([misreads(w, r) for w, r in zip(words, rights)], dtype="int32")

    letters = F.col("word").rlike(r"^[\p{L}†-]+$") & ~F.col("word").rlike("[†çﬁﬂﬀﬃﬄ]")
    rare = vocabulary.filter(F.col("word").rlike(r"\p{L}") & (~letters | (F.length("word") >= 4)) & (F.length("word") <= LONGEST_MISREAD))
    # a variant that is not more frequent than the word can never win, so the most frequent words need no candidates
    top = vocabulary.agg(F.max("n").alias("top"))
    rare = rare.crossJoin(F.broadcast(top)).filter(F.col("n") * F.when(letters, ratio).otherwise(1.0) <= F.col("top")).drop("top")  # top is one row
    rare = rare.select("word", "n", letters.alias("letters"), F.explode(candidates("word", anagram_value(F.col("word")))).alias("av"))
    good = F.when(F.col("letters"), (F.col("n_right") >= F.greatest(F.lit(least), F.col("n") * ratio))).otherwise(F.col("n_right") > F.col("n"))
    pairs = rare.join(known, "av").filter(good & (F.col("word") != F.col("right"))).select("word", "right", "n", "n_right").distinct()
    pairs = pairs.withColumn("misreads", checked("word", "right")).filter("misreads between 1 and 3")
    ranked = F.max(F.struct("n_right", (-F.col("misreads")).alias("m"), "right", "n")).alias("b")
    return pairs.groupBy("word").agg(ranked).select("word", F.col("b.right").alias("right"), F.col("b.n").alias("n"), F.col("b.n_right").alias("n_right"))


# ---- the parts ------------------------------------------------------------------------------
def _breaks(notes: DataFrame) -> DataFrame:
    """``(unit_id, first, second, next_id)`` of every word cut at a line's or the unit's end; ``next_id`` is the unit that goes on with it."""
    breaks = notes.filter("note = 'break'").select("unit_id", F.col("key").alias("first"), F.col("key2").alias("second"), F.lit(None).cast("string").alias("next_id"))
    ends = notes.filter("note = 'end'").select("unit_id", "paper_id", "kind", "page", "place", F.col("key").alias("first")).distinct()
    starts = notes.filter("note = 'start'").select("paper_id", "kind", F.col("page").alias("p2"), F.col("place").alias("q2"), F.struct(F.col("key").alias("second"), F.col("unit_id").alias("next_id")).alias("start"))
    # the text goes on in the next unit, or after a few lines that are no text, or on the next page
    page = F.when(F.col("kind") == "element", F.array([F.lit(0)] * AHEAD_ON_PAGE + [F.lit(1)] * AHEAD_ON_NEXT)).otherwise(F.array([F.lit(0)] * AHEAD_IN_CHUNKS))
    step = F.when(F.col("kind") == "element", F.array([F.lit(i) for i in (*range(1, AHEAD_ON_PAGE + 1), *range(AHEAD_ON_NEXT))])).otherwise(F.array([F.lit(i + 1) for i in range(AHEAD_IN_CHUNKS)]))
    ahead = ends.select("*", F.posexplode(F.arrays_zip(page.alias("a"), step.alias("b"))).alias("rank", "to"))
    ahead = ahead.withColumn("p2", F.col("page") + F.col("to.a")).withColumn("q2", F.when(F.col("to.a") == 1, F.col("to.b")).otherwise(F.col("place") + F.col("to.b")))
    met = ahead.join(starts, ["paper_id", "kind", "p2", "q2"], "left")
    met = met.groupBy("unit_id", "first").agg(F.min_by("start", F.when(F.col("start").isNotNull(), F.col("rank"))).alias("s"))
    return breaks.unionByName(met.select("unit_id", "first", "s.second", "s.next_id")).distinct()


def _kept_hyphen(firsts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(first)``: those that are rather the first part of a compound than the beginning of a longer word.

    A compound is cut at its hyphen; a word may be cut at any of its letters, so each counts for one part in as many
    as it has places to be cut. Both grow alike with the corpus.
    """
    longer = vocabulary.filter(F.col("word").rlike(r"^[^\W\d_]{2,}$")).select("n", F.length("word").alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))).alias("first"))
    words = longer.join(firsts, "first", "left_semi").groupBy("first").agg(F.sum(F.col("n") / (F.col("len") - 1)).alias("words"))
    compounds = vocabulary.filter(F.col("word").rlike(r"^[^\W\d_]+-[^\W_]")).groupBy(F.substring_index("word", "-", 1).alias("first")).agg(F.sum("n").alias("compounds"))
    return firsts.join(compounds, "first").join(words, "first", "left").filter(F.col("compounds") > F.coalesce("words", F.lit(0.0))).select("first")


def _hyphens(notes: DataFrame, vocabulary: DataFrame, total: int) -> DataFrame:
    """``(unit_id, first, second, next_id)`` of the broken words; the rest of the breaks are compounds. ``total`` is the number of all words."""
    both = _breaks(notes)
    pairs = both.select("first", "second").distinct()
    # what stands at a unit's end or goes on from one is no word of its own, though it was counted as one
    halves = notes.filter("note = 'end'").select(F.col("key").alias("word"))
    goes_on = both.filter("next_id is not null").select(F.col("next_id").alias("unit_id")).distinct()
    halves = halves.union(notes.filter("note = 'start'").join(goes_on, "unit_id", "left_semi").select("key"))
    halves = halves.groupBy("word").agg(F.count("*").alias("cut"))
    free = vocabulary.join(halves, "word", "left").select("word", (F.col("n") - F.coalesce("cut", F.lit(0))).alias("free"), "n")
    words = pairs.filter("second is not null").select("first", "second", F.explode(F.array(
        F.struct(F.lit("joined").alias("as"), F.concat("first", "second").alias("word")),
        F.struct(F.lit("compound").alias("as"), F.concat("first", F.lit("-"), "second").alias("word")),
        F.struct(F.lit("a").alias("as"), F.col("first").alias("word")),
        F.struct(F.lit("b").alias("as"), F.col("second").alias("word")),
    )).alias("w")).select("first", "second", "w.as", "w.word")
    count = F.when(F.col("as").isin("a", "b"), F.col("free")).otherwise(F.col("n"))
    counted = words.join(free, "word", "left").withColumn("count", F.coalesce(count, F.lit(0))).groupBy("first", "second").agg(*[F.max(F.when(F.col("as") == x, F.col("count")).otherwise(0)).alias(f"n_{x}") for x in ("joined", "compound", "a", "b")])
    own = lambda x: (F.col(f"n_{x}") > 0) & (F.col(f"n_{x}") * WORD_PARTS >= total)
    whole = F.when((F.col("n_joined") > 0) | (F.col("n_compound") > 0), F.col("n_joined") > F.col("n_compound")).otherwise(~(own("a") & own("b")))
    counted = counted.select("first", "second", whole.alias("whole"))
    # a half that nothing goes on from is judged by the other breaks after it, and without any by the words that begin with it
    alone = pairs.filter("second is null").select("first")
    votes = both.join(counted, ["first", "second"]).join(alone, "first", "left_semi").groupBy("first").agg(F.sum(F.when(F.col("whole"), 1).otherwise(-1)).alias("votes"))
    kept = _kept_hyphen(alone, vocabulary).withColumn("kept", F.lit(True))
    votes = alone.join(votes, "first", "left").join(kept, "first", "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    alone = votes.filter((F.col("votes") > 0) | (F.col("votes") == 0) & F.col("kept").isNull()).select("first", F.lit(None).cast("string").alias("second"))
    counted = counted.filter("whole").select("first", "second").unionByName(alone)
    return both.join(counted, both["first"].eqNullSafe(counted["first"]) & both["second"].eqNullSafe(counted["second"]), "left_semi")


def _page_numbers(notes: DataFrame) -> DataFrame:
    """``(unit_id, key)`` of the lines that are page numbers: those that move with the pages of their paper."""
    lines = notes.filter("note = 'number' and n is not null")
    votes = notes.filter("note in ('number', 'sure', 'form') and kind = 'element' and n is not null")
    votes = votes.groupBy("paper_id", (F.col("n") - F.col("page")).alias("offset")).agg(F.sum(F.when(F.col("edge"), 2).otherwise(1)).alias("votes"))
    offset = votes.groupBy("paper_id").agg(F.max(F.struct("votes", F.col("offset"))).alias("b")).filter("b.votes >= 2").select("paper_id", F.col("b.offset").alias("offset"))
    paged = lines.filter("kind = 'element'").join(offset, "paper_id").filter(F.col("n") - F.col("page") == F.col("offset"))
    # a chunk has no page; its numbers rise with its place in the paper, so one far off those before and after it, which agree, is none
    order = Window.partitionBy("paper_id", "kind").orderBy("place", "n")
    placed = lines.filter("kind <> 'element'").groupBy("paper_id", "kind", "place", "n").agg(F.collect_set(F.struct("unit_id", "key")).alias("x"))
    before, after = F.lag("n").over(order), F.lead("n").over(order)
    against = (before <= after) & ((F.col("n") < before - PAGES_OFF) | (F.col("n") > after + PAGES_OFF))
    rising = placed.withColumn("against", F.coalesce(against, F.lit(False))).filter("not against or paper_id is null").select(F.inline("x"))
    return paged.select("unit_id", "key").union(rising.select("unit_id", "key")).distinct()


def _headers(notes: DataFrame, titles: DataFrame) -> DataFrame:
    """``(unit_id, key2)``: the units and their lines that are running headers or footers."""
    lines = notes.filter("note in ('sure', 'form', 'maybe')").select("note", "unit_id", "paper_id", "kind", "page", "key", "key2", "n", "edge")
    sure = (F.col("note") == "sure") & ((F.col("kind") != "element") | F.col("edge") | F.col("n").isNotNull())
    known = lines.filter(sure | (F.col("edge") & (F.col("kind") == "element"))).select("paper_id", "key").distinct()
    # authors and series prove nothing by their form: they recur in the paper, at an edge, or with a page number
    formed = lines.filter("note = 'form'").groupBy("paper_id", "key").agg(F.countDistinct("unit_id").alias("units"), F.max(F.coalesce(F.col("edge"), F.lit(False)) | F.col("n").isNotNull()).alias("placed"))
    known = known.union(formed.filter("units > 1 or placed").select("paper_id", "key"))
    again = lines.filter("n is not null").groupBy("paper_id", "key").agg(F.countDistinct("n").alias("pages")).filter("pages > 1").select("paper_id", "key")
    titled = lines.filter("note = 'maybe'").join(titles, "paper_id").filter(F.expr("startswith(title, key) and length(key) >= 12")).select("paper_id", "key")
    known = known.union(again).union(titled).distinct()
    return lines.join(known, ["paper_id", "key"], "left_semi").select("unit_id", "key2").distinct()


def _titles(units: DataFrame) -> DataFrame:
    """``(paper_id, title)``: a paper's title, folded like the lines that may repeat it."""

    @F.pandas_udf("string")
    def folded(titles: pd.Series) -> pd.Series:
        return titles.map(fold)

    return units.filter("title is not null").groupBy("paper_id").agg(F.max("title").alias("title")).withColumn("title", folded("title"))


def _rare_words(units: DataFrame, skip: list[str], breaks_apart: bool = True) -> DataFrame:
    """``(unit_id, word, line)`` of every word that is not in ``skip``, with the line it stands on where that may be no text."""
    skipped = frozenset(skip)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, str | None] = {}
        for b in batches:
            out = []
            for unit, _, _, _, _, _, _, text in _units_of(b):
                if not text:
                    continue
                text = tidy(text)
                if "\n" in text and _SIGN_AT_LINE_END.search(text):
                    text = mend_breaks(text, lambda first, second: f"{first}{second}\n")
                if any(c in text for c in "<$\\!"):
                    text = _NOT_TEXT.sub(" ", text)
                rare = set()
                for t in text.split():
                    if t not in memo:
                        if len(memo) > 1_000_000:
                            memo.clear()
                        w = word_of(t)
                        memo[t] = None if len(w) < 2 or len(w) > LONGEST_WORD or w in skipped or not (w.isalnum() or any(c.isalnum() for c in w)) else (t.strip(_STRIP) if NUMBER_MISREAD.match(t.strip(_STRIP)) else w)
                    if memo[t]:
                        rare.add(t)
                if rare:
                    for line in text.split("\n"):
                        found = rare.intersection(line.split())
                        if found:
                            bare = line.strip()
                            edge = len(bare) <= LONGEST_EDGE_LINE and may_be_edge(bare)
                            if not (edge and len(bare) <= LONGEST_PAGE_LINE and PAGE_LINE.match(bare)):
                                out += [(unit, memo[t], bare if edge else None) for t in found]
            if out:
                yield pd.DataFrame(out, columns=["unit_id", "word", "line"])

    return units.mapInPandas(run, "unit_id string, word string, line string")


def scan_units(elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """Layout elements and chunks as one table of units in reading order."""
    y = F.col("bbox.y1")
    title = F.when((F.col("label") == "sec_0") & (F.col("page_number") == 1), F.col("text"))
    e = elements.select(
        F.col("element_id").alias("unit_id"), "paper_id", F.lit("element").alias("kind"), F.col("page_number").alias("page"), F.col("reading_order").alias("place"),
        ((y < 60) | (y > 840)).alias("edge"), title.alias("title"), "text",
    )
    c = chunks.select(F.col("chunk_id").alias("unit_id"), "paper_id", F.col("chunk_type").alias("kind"), F.lit(0).alias("page"), F.col("chunk_index").alias("place"), F.lit(False).alias("edge"), F.col("paper_title").alias("title"), "text")
    return e.unionByName(c).filter("unit_id is not null")


def find_noise(units: DataFrame) -> dict[str, DataFrame]:
    """The noise in units of text, as small tables.

    ``units(unit_id, paper_id, kind, page, place, edge, title, text)``; see ``scan_units``. ``edge``
    says whether a layout element lies at a page's edge, null where that is unknown. Gives
    ``hyphen(unit_id, first, second, next_id)``, ``glyph(unit_id, word, right)``, ``header(unit_id, line)`` and ``page_no(unit_id, line)``. Null and empty texts
    have no noise; repeated rows count once in the results; a unit without a paper has no running
    header and no page number; without units the tables are empty.
    """
    units = units.select(
        "unit_id", "paper_id", "kind", F.coalesce(F.col("page"), F.lit(0)).cast("int").alias("page"), F.coalesce(F.col("place"), F.lit(-9)).cast("int").alias("place"), "edge", "title", "text",
    )
    notes = cut(units.mapInPandas(_note_pass, _NOTES))
    vocabulary = cut(notes.filter("note = 'word'").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("n")))
    right = cut(corrections(vocabulary))
    header = _headers(notes, _titles(units)).withColumnRenamed("key2", "line")
    page_no = _page_numbers(notes).withColumnRenamed("key", "line")
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    hyphen = _hyphens(notes, vocabulary, total)
    frequent = vocabulary.filter(F.col("n") * SKIPPED_WORDS > total).filter(~F.col("word").rlike(r"[\d†ﬁﬂﬀﬃﬄ]")).join(right, "word", "left_anti")
    skip = [r.word for r in frequent.select("word").collect()]  # bounded by SKIPPED_WORDS
    words = _rare_words(units, skip)
    alone = F.col("word").rlike(_SELF.pattern) & ~F.col("word").rlike(_ORDINAL.pattern) | F.col("word").rlike(NUMBER_MISREAD.pattern) & ~F.col("word").rlike(r"^\d+s$")
    glyph = words.join(right.select("word", "right"), "word", "left").filter(F.col("right").isNotNull() | alone)
    # a number, and a word that is met nowhere in its right form, have no variant to rank: the sign itself is set right
    number = F.col("word").rlike(NUMBER_MISREAD.pattern)
    glyph = glyph.withColumn("right", F.coalesce("right", F.when(number, F.translate("word", "OoIlSB", "001158")).otherwise(F.translate("word", "015†", "olst"))))
    glyph = glyph.join(header, ["unit_id", "line"], "left_anti").select("unit_id", "word", "right").distinct()
    return {"hyphen": hyphen, "glyph": glyph, "header": header, "page_no": page_no}


# ---- the repaired text ----------------------------------------------------------------------
_WORD = re.compile(r"[^\s.,;:()\[\]{}\"“”‘’!?*#|<>=+$^_/\\—–-]+")
_AS_DIGIT = str.maketrans("OoIlSB", "001158")


def like(right: str, seen: str) -> str:
    """A correction in the case of the word it replaces."""
    return right.upper() if len(seen) > 1 and seen.isupper() else right.capitalize() if seen[:1].isupper() else right


def repair(text: str, drop: list[str], broken: list[tuple[str, str]], words: dict[str, str | None], tail: str | None, headless: bool) -> str:
    """A unit's text without its edge lines, with its broken and misread words mended, as one flowing line per paragraph."""
    lines = [x for x in tidy(text).split("\n") if x.strip() not in drop]
    s = "\n".join(lines)
    whole = set(broken)
    s = mend_breaks(s, lambda first, second: first + second if (first.lower(), second.lower()) in whole else f"{first}-{second}")
    if tail is not None:
        s = re.sub(r"[-‐¬\u00ad]\s*$", tail, s)
    if headless:
        s = re.sub(r"^\s*[^\W\d_]+", "", s)

    def mend(m: re.Match) -> str:
        w = m[0].lower()
        if w not in words and m[0] not in words:
            return m[0]
        right = words.get(w, words.get(m[0]))
        if right:
            return like(right, m[0])
        return m[0].translate(_AS_DIGIT) if NUMBER_MISREAD.match(m[0]) else m[0]

    if words:
        s = _WORD.sub(mend, s)
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", s)]
    return "\n\n".join(p for p in paragraphs if p)


def repaired_units(units: DataFrame, noise: dict[str, DataFrame]) -> DataFrame:
    """``units`` with ``text`` repaired; units of nothing but running headers and page numbers have an empty text.

    A word cut at a unit's end is completed there, and its second half leaves the next unit. Repeated
    rows are repaired alike; null texts stay null.
    """
    lines = noise["header"].union(noise["page_no"]).groupBy("unit_id").agg(F.collect_set("line").alias("drop"))
    inner = noise["hyphen"].filter("next_id is null and second is not null").groupBy("unit_id").agg(F.collect_set(F.struct("first", "second")).alias("broken"))
    tail = noise["hyphen"].filter("next_id is not null").groupBy("unit_id").agg(F.first("second").alias("tail"))
    headless = noise["hyphen"].filter("next_id is not null").select(F.col("next_id").alias("unit_id")).distinct().withColumn("headless", F.lit(True))
    words = noise["glyph"].groupBy("unit_id").agg(F.collect_set(F.struct("word", "right")).alias("words"))
    out = units
    for part in (lines, inner, tail, headless, words):
        out = out.join(part, "unit_id", "left")

    @F.pandas_udf("string")
    def mended(text: pd.Series, drop: pd.Series, broken: pd.Series, tail: pd.Series, headless: pd.Series, words: pd.Series) -> pd.Series:
        listed = lambda x: [] if x is None else list(x)
        return pd.Series(
            [
                None if t is None else repair(t, listed(d), [(x["first"], x["second"]) for x in listed(b)], {x["word"]: x["right"] for x in listed(w)}, e if isinstance(e, str) else None, h is True)
                for t, d, b, e, h, w in zip(text, drop, broken, tail, headless, words)
            ],
            dtype=object,
        )

    return out.withColumn("text", mended("text", "drop", "broken", "tail", "headless", "words")).select(*units.columns)


def without_overlap(text: str | None, previous: str | None) -> str | None:
    """A chunk's text after the tail of the previous chunk that it repeats; the two are parted by a blank line."""
    if not text or not previous:
        return text
    text, previous = tidy(text), tidy(previous)
    return next((text[m.end() :] for m in reversed(list(re.finditer(r"\n\n", text))) if m.start() and previous.endswith(text[: m.start()])), text)


_PIECE = r"(?<=\n)(?=\s*\n)|(?<=[.!?]\s)"  # where a text is cut into sentences and paragraphs, each with the blanks after it
RUN = 4  # words


def _pieces_of(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), _PIECE)


def _bare(piece: Column) -> Column:
    return F.btrim(F.regexp_replace(piece, r"\s+", " "))


def word_runs(papers: pd.Series, texts: pd.Series, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size the ``(row, run)`` of every run of so many words: the row's place and a hash of paper and words."""
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = np.array([x for w in words for x in w], object)
    hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    of_paper = pd.util.hash_array(np.array(["" if p is None else p for p in papers], object), categorize=False) if len(papers) else hashes
    row = np.repeat(np.arange(len(n)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(flat))  # words from here to the row's end
    for size in sizes:
        at = np.flatnonzero(left >= size)
        run = of_paper[row[at]]
        for i in range(size):
            run = (run ^ hashes[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            run = run ^ (run >> np.uint64(29))
        yield row[at], run.view(np.int64)


def _not_in_coarse(coarse: DataFrame, finer: DataFrame) -> DataFrame:
    """``(chunk_id, lost)``: the finer chunks with text that no coarse chunk of their paper holds, and the keys of those pieces.

    A piece is held if the paper's coarse chunks have it as a piece or, where their pieces are cut elsewhere, have each of its
    runs of ``RUN`` words (all its words, if there are fewer).
    """
    pieces = lambda df: df.select("chunk_id", "paper_id", F.explode(_pieces_of(F.col("text"))).alias("p")).select("chunk_id", "paper_id", _bare(F.col("p")).alias("p")).filter("p <> ''").withColumn("k", F.xxhash64("paper_id", "p"))
    missed = cut(pieces(finer).join(pieces(coarse).select("k").distinct(), "k", "left_anti"))

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["p"].map(lambda p: len(p.split()))
            for size in range(1, RUN + 1):
                some = b[n == size] if size < RUN else b[n >= size]
                for row, run in word_runs(some["paper_id"], some["p"], (size,)):
                    yield pd.DataFrame({"k": some["k"].to_numpy()[row], "run": run})

    runs = cut(missed.select("k", "paper_id", "p").distinct().mapInPandas(asked, "k long, run long"))
    bits = _value_filter(runs.select(F.col("run").alias("av")))

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["text"].notna()]
            for _, run in word_runs(b["paper_id"], b["text"], tuple(range(1, RUN + 1))):
                at = run % FILTER_BITS
                yield pd.DataFrame({"run": run[(bits.value[at >> 3] >> (at & 7)) & 1 == 1]})

    there = coarse.select("paper_id", "text").mapInPandas(met, "run long").distinct()
    lost = runs.join(there, "run", "left_anti").select("k").distinct()
    return cut(missed.join(lost, "k", "left_semi").groupBy("chunk_id").agg(F.collect_set("k").alias("lost")))


def _read_once(source: DataFrame) -> DataFrame:
    """Each chunk once, without the start that it repeats of the chunk before; ``first`` where there is none before it."""
    read = source.groupBy("chunk_id", "paper_id", "chunk_type", "chunk_index").agg(
        F.first("paper_title", ignorenulls=True).alias("paper_title"), F.first("text", ignorenulls=True).alias("text"), F.first("overlap", ignorenulls=True).alias("overlap"), F.first("lost").alias("lost")
    )
    before = read.select("paper_id", "chunk_type", (F.col("chunk_index") + 1).alias("chunk_index"), F.col("text").alias("previous"))
    before = before.groupBy("paper_id", "chunk_type", "chunk_index").agg(F.max("previous").alias("previous"))

    @F.pandas_udf("string")
    def own(text: pd.Series, previous: pd.Series) -> pd.Series:
        return pd.Series([without_overlap(t, p) for t, p in zip(text, previous)], dtype=object)

    met = read.join(before, ["paper_id", "chunk_type", "chunk_index"], "left")
    met = met.withColumn("text", own("text", F.when(F.coalesce("overlap", F.lit(True)), F.col("previous"))))
    return met.withColumn("first", F.col("previous").isNull()).drop("previous", "overlap")


def reading_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The chunks that hold each paper's text once: the coarse ones, or all where it has none; overlaps left out. What other
    chunks hold that the coarse ones do not (None if there is no such text); ``anew`` where it does not go on from the one before. And the rest.

    Chunks ingested twice count once. Only a flag that says there is no overlap keeps a repeated start.
    """
    flag = F.col("overlap_with_previous") if "overlap_with_previous" in chunks.columns else F.lit(None).cast("boolean")
    chunks = chunks.withColumn("overlap", flag).withColumn("lost", F.lit(None).cast("array<bigint>"))
    coarse, finer = chunks.filter("chunk_type = 'coarse'"), chunks.filter("chunk_type is null or chunk_type <> 'coarse'")
    bare = cut(finer.select("paper_id").distinct().join(coarse.select("paper_id").distinct(), "paper_id", "left_anti"))
    source, others = coarse, finer
    if not bare.isEmpty():
        source, others = coarse.unionByName(finer.join(bare, "paper_id", "left_semi")), finer.join(bare, "paper_id", "left_anti")
    more = _not_in_coarse(coarse, others)
    if more.isEmpty():
        return _read_once(source).drop("lost", "first"), None, others
    rest = _read_once(others.drop("lost").join(more, "chunk_id"))
    kept = lambda p: F.array_contains("lost", F.xxhash64("paper_id", _bare(p)))
    pieces = F.filter(_pieces_of(F.col("text")), lambda p: _bare(p) != "")
    anew = F.col("first") | ~F.coalesce(kept(F.get(pieces, F.lit(0))), F.lit(False))
    text = F.array_join(F.filter(_pieces_of(F.col("text")), lambda p: (_bare(p) == "") | kept(p)), "")
    rest = rest.select("chunk_id", "paper_id", "chunk_type", "chunk_index", "paper_title", text.alias("text"), anew.alias("anew"))
    return _read_once(source).drop("lost", "first"), written(rest), others.join(more, "chunk_id", "left_anti")


def paper_paragraphs(elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(paper_id, page, place, part, label, text)``: each paper's clean paragraphs in reading order.

    The text of layout elements and that of chunks are both given, since a paper's chunks do not
    repeat its elements. Of the chunks see ``reading_chunks``: text that stands only in fine chunks is given as
    well, only its own sentences. A row from a chunk has no page, the
    chunk's index as ``place``, the paragraph's number in the chunk as ``part`` and the chunk's type
    as ``label``. A paragraph that goes on in a later element or chunk (on the same page or the
    next, past figures and footnotes) is one row at the place where it begins. Elements parsed
    twice count once. The numbering that joins the parts runs in blocks, so one large paper is
    spread over tasks.
    """
    from vellumine.llm.prefix import running_sum

    read, more, others = reading_chunks(chunks)  # the others are evidence only: their text is in the coarse chunks
    state = lambda df, read, anew: df.withColumn("read", F.lit(read)).withColumn("anew", F.lit(anew))
    none = elements.filter("false")
    units = state(scan_units(elements, read), True, False).unionByName(state(scan_units(none, others), False, False))
    for anew in (True, False) if more is not None else ():
        units = units.unionByName(state(scan_units(none, more.filter(F.col("anew") == anew)), True, anew))
    units = written(units)
    noise = {kind: cut(found) for kind, found in find_noise(units).items()}  # small tables, each read several times
    labels = elements.groupBy(F.col("element_id").alias("unit_id")).agg(F.first("label", ignorenulls=True).alias("label"))
    one = units.filter("kind = 'element'").groupBy("unit_id", "paper_id", "kind", "page", "place").agg(F.first("text", ignorenulls=True).alias("text"), F.lit(False).alias("anew"))
    own = units.filter("read and (kind is null or kind <> 'element')").select(*one.columns)
    clean = repaired_units(one.unionByName(own), noise).filter("text <> ''").join(labels, "unit_id", "left")
    parted = F.posexplode(F.when(F.col("kind") == "element", F.array("text")).otherwise(F.split("text", "\n\n"))).alias("part", "text")
    clean = clean.select("unit_id", "paper_id", "kind", F.when(F.col("kind") == "element", F.col("page")).alias("page"), "place", F.when(F.col("kind") == "element", F.col("label")).otherwise(F.col("kind")).alias("label"), "anew", parted)
    layout = F.col("kind") == "element"
    text = F.col("text").rlike(r"\p{L}\S*\s+\S+\s+\S")  # a lone number or reference is no prose
    flows = F.coalesce(F.when(layout, F.col("label").isin("para", "half_para")).otherwise(~F.col("text").rlike(r"^(?:#{1,6} |[-*+|>!$<]|\d+[.)] )")), F.lit(True)) & text
    clean = written(clean.withColumn("flows", flows).withColumn("new", F.when(F.col("text").rlike(r"^[\p{Ll}.,;:)]") & ~(F.col("anew") & (F.col("part") == 0)), 0).otherwise(1)).drop("anew"))  # tested once
    prose = clean.filter("flows").withColumn("stream", F.struct("paper_id", "kind"))
    size = prose.agg(F.count("*").alias("n"), F.max("page").alias("p"), F.max(F.when(layout, F.col("place"))).alias("q"), F.max(F.when(~layout, F.col("place"))).alias("c"), F.max("part").alias("s")).first()
    place = F.greatest(F.coalesce("place", F.lit(0)), F.lit(0))
    on_page = (F.coalesce("page", F.lit(0)) + place / F.lit(float((size.q or 0) + 1))) / F.lit(float((size.p or 0) + 2))
    in_chunks = (place + F.col("part") / F.lit(float((size.s or 0) + 1))) / F.lit(float((size.c or 0) + 1))
    prose = prose.withColumn("at", F.greatest(F.lit(0.0), F.when(layout, on_page).otherwise(in_chunks)))
    prose = running_sum(prose, "stream", "at", "new", "before", size.n).withColumn("number", F.col("before") + F.col("new"))
    parts = F.sort_array(F.collect_list(F.struct("page", "place", "part", "unit_id", "label", "text"))).alias("x")
    columns = ["page", "place", "part", "label"]
    joined = prose.groupBy("stream", "number").agg(parts).select("stream.paper_id", *[F.get("x", 0)[c].alias(c) for c in columns], F.btrim(F.array_join(F.transform("x", lambda u: F.concat(F.when(u["text"].rlike("^[.,;:)]"), "").otherwise(" "), u["text"])), "")).alias("text"))
    return joined.unionByName(clean.filter("not flows").select("paper_id", *columns, "text"))

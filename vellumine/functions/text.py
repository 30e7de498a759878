"""String functions on columns. All stay inside the JVM; offsets and lengths are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions.binding import let

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: ColumnOrName) -> Column:
    """Without white space of any kind at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def normalise_lf(x: ColumnOrName) -> Column:
    return F.regexp_replace(_c(x), r"\r\n?", "\n")


def word_count(x: ColumnOrName) -> Column:
    return F.size(F.filter(F.split(_c(x), r"\s+"), lambda w: w != ""))


def sentences(x: ColumnOrName) -> Column:
    """Cut after ``.``, ``!`` or ``?`` where white space follows."""
    return F.split(_c(x), r"(?<=[.!?])\s+")


def truncate(x: ColumnOrName, limit: int = 60) -> Column:
    return F.when(F.length(_c(x)) > limit, F.concat(F.left(_c(x), F.lit(limit - 3)), F.lit("..."))).otherwise(_c(x))


# The three forms of citation markers.
CITATION_MARKERS = (r"\$\^\{\d+\}\$", r"\[\d+\]", r"\(\d+\)")


def citation_count(x: ColumnOrName) -> Column:
    """Markers of the forms ``$^{53}$``, ``[1]`` and ``(1)``."""
    return sum((F.regexp_count(_c(x), F.lit(p)) for p in CITATION_MARKERS), F.lit(0))


def token_estimate(x: ColumnOrName) -> Column:
    return F.floor(F.length(_c(x)) / 4).cast("int")


def safe_filename(x: ColumnOrName, limit: int = 200) -> Column:
    """Illegal characters and white space as single underscores, cut to the limit, ``untitled`` if nothing is left."""
    s = F.regexp_replace(_c(x), r'[<>:"/\\|?*]', "_")
    s = F.btrim(F.regexp_replace(s, r"[_\s]+", "_"), F.lit(" _"))
    return F.coalesce(F.nullif(F.left(s, F.lit(limit)), F.lit("")), F.lit("untitled"))


def pdf_filename(index: ColumnOrName, work_id: ColumnOrName, title: ColumnOrName, limit: int = 200) -> Column:
    prefix = F.format_string("%05d_%s_", _c(index), _c(work_id))
    room = F.lit(limit) - F.length(prefix) - 4
    stem = safe_filename(F.coalesce(F.nullif(_c(title), F.lit("")), F.lit("untitled")), 10_000)
    return F.concat(prefix, F.left(stem, room), F.lit(".pdf"))


def human_bytes(x: ColumnOrName) -> Column:
    n = _c(x).cast("double")
    out = F.format_string("%.2f PB", n / 1024.0**5)
    for i, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(n < 1024.0 ** (i + 1), F.format_string(f"%.2f {unit}", n / 1024.0**i)).otherwise(out)
    return out


def human_duration(x: ColumnOrName) -> Column:
    s = _c(x).cast("double")
    m, rest = F.floor(s / 60).cast("int"), F.floor(s % 60).cast("int")
    long = F.format_string("%dh %dm %ds", F.floor(m / 60).cast("int"), (m % 60).cast("int"), rest)
    return F.when(s < 60, F.format_string("%.1fs", F.bround(s, 1))).when(m < 60, F.format_string("%dm %ds", m, rest)).otherwise(long)


def human_age(x: ColumnOrName) -> Column:
    s = F.floor(_c(x)).cast("long")
    part = lambda a: F.floor(a).cast("long")
    return (
        F.when(s < 60, F.format_string("%d seconds", s))
        .when(s < 3600, F.format_string("%d minutes", part(s / 60)))
        .when(s < 86400, F.format_string("%d hours %d minutes", part(s / 3600), part(s % 3600 / 60)))
        .otherwise(F.format_string("%d days %d hours", part(s / 86400), part(s % 86400 / 3600)))
    )


def document_id(path: ColumnOrName) -> Column:
    """The first two ``_`` parts of a file's stem."""
    return F.substring_index(F.replace(F.element_at(F.split(_c(path), "/"), -1), F.lit(".pdf"), F.lit("")), "_", 2)


def output_key(path: ColumnOrName, prefix: str) -> Column:
    return F.concat(F.lit(prefix), document_id(path), F.lit("/document.md"))


def short_id(url: ColumnOrName) -> Column:
    return F.element_at(F.split(_c(url), "/"), -1)


def normalise_doi(x: ColumnOrName) -> Column:
    s = F.regexp_replace(strip(F.coalesce(_c(x), F.lit(""))), r"(?i)^doi:\s*", "")
    s = F.when(s.rlike(r"(?i)doi\.org/."), F.regexp_extract(s, r"(?i)doi\.org/(.+)", 1)).otherwise(s)
    s = F.substring_index(F.substring_index(s, "?", 1), "#", 1)
    return F.btrim(strip(s), F.lit("/"))


def valid_url(x: ColumnOrName) -> Column:
    """The URL, or null if it does not begin with http; an empty text passes."""
    return F.when(_c(x).rlike("^https?://") | (_c(x) == ""), _c(x))


def tables_of_html(x: ColumnOrName) -> Column:
    found = F.regexp_extract_all(_c(x), F.lit(r"(?s)<table.*?>.*?</table>"), F.lit(0))
    return F.array_join(F.transform(found, lambda t: F.regexp_replace(t, r"<table[^>]*>", "<table>")), "\n")


# ---- Markdown of layout elements ------------------------------------------------------------
# The macro replacements, in their order.
MACROS = (
    ("\\bm", "\\mathbf "), ("\\eqno", "\\quad "), ("\\quad", "\\quad "), ("\\leq", "\\leq "), ("\\pm", "\\pm "),
    ("\\varmathbb", "\\mathbb "), ("\\in fty", "\\infty"), ("\\mu", "\\mu "), ("\\cdot", "\\cdot "), ("\\langle", "\\langle "),
)
CJK = "[一-鿿]"


def macros(x: ColumnOrName) -> Column:
    s = F.replace(_c(x), F.lit("\\upmu"), F.lit("\\mu"))
    for a, b in MACROS:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def rejoin_lines(x: ColumnOrName) -> Column:
    """Lines of a paragraph joined: hyphens at line ends removed, a blank between lines unless both
    sides are CJK, empty lines kept as breaks."""
    lines = F.transform(F.split(F.replace(strip(x), F.lit("-\n"), F.lit("")), "\n"), lambda s: strip(s))
    return let(lines, _join_lines)


def _join_lines(lines: Column) -> Column:
    n = F.size(lines)
    joined = F.transform(
        lines,
        lambda s, i: F.when(i == n - 1, s)
        .when(s == "", F.lit("\n"))
        .when(F.get(lines, i + 1) == "", F.concat(s, F.lit("\n")))
        .when(s.rlike(f"{CJK}$") & F.get(lines, i + 1).rlike(f"^{CJK}"), s)
        .otherwise(F.concat(s, F.lit(" "))),
    )
    return F.array_join(joined, "")


def heading_line(x: ColumnOrName) -> Column:
    return F.when(_c(x).rlike(CJK), F.replace(_c(x), F.lit("\n"), F.lit(""))).otherwise(F.replace(_c(x), F.lit("\n"), F.lit(" ")))


def element_markdown(label: ColumnOrName, text: ColumnOrName, index: ColumnOrName) -> Column:
    """One layout element as Markdown; null for an empty one."""
    return let(strip(text), lambda t: _element(_c(label), t, _c(index)))


def _element(label: Column, t: Column, index: Column) -> Column:
    plain = rejoin_lines(macros(t))
    heading = F.concat(F.when(label == "sec_0", "#").when(label == "sec_1", "##").otherwise("###"), F.lit(" "), rejoin_lines(macros(heading_line(t))), F.lit("\n\n"))
    number = F.concat(F.lit("![Figure "), index.cast("string"), F.lit("]("))
    uri = F.when(t.startswith("data:image/") | (t.contains(";") & t.contains(",")), t).otherwise(F.concat(F.lit("data:image/png;base64,"), t))
    figure = F.when(t.startswith("!["), F.concat(t, F.lit("\n\n"))).otherwise(F.concat(number, uri, F.lit(")\n\n")))
    formula = F.concat(F.lit("$$"), macros(F.rtrim(F.btrim(t, F.lit("$")), F.lit("\\ "))), F.lit("$$\n\n"))
    out = (
        F.when(label.rlike("^sec_[0-5]$"), heading)
        .when(label == "fig", figure)
        .when(label == "tab", F.concat(tables_of_html(t), F.lit("\n\n\n")))
        .when(label == "equ", formula)
        .when(label == "list", F.concat(F.lit("- "), t, F.lit("\n")))
        .when(label == "code", F.concat(F.lit("```bash\n"), t, F.lit("\n```\n\n")))
        .otherwise(F.concat(plain, F.lit("\n\n")))
    )
    return F.when(t != "", out)

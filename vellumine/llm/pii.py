"""Personal information in free text: typed spans, and the text with placeholders.

Patterns propose spans; each span has a score that starts from its shape, rises where its kind's
checksum holds and falls where it fails, and moves with the context words before and after it. A
number whose checksum holds needs no label; one whose checksum fails needs a label right before it;
one of a kind without a checksum needs a label near it; words that say it is something else rule out
all of them. Spans that reach ``THRESHOLD`` are kept; where two overlap, the kind listed first in
``KINDS`` wins. Every text is scanned whole, in one pass over the rows, without a shuffle; the
context of a proposal is ``NEAR`` characters (names: ``NEAR_NAME``, around an ``@``: ``NEAR_AT``),
before and after.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "card", "id_number", "address", "phone", "name")
THRESHOLD = 0.6
#: Characters of context, before and after.
NEAR, NEAR_NAME, NEAR_AT = (48, 24), (90, 60), (80, 160)
#: What a number's score is made of.
SHAPE, HOLDS, FAILS, LABEL, LABEL_NEAR, VETO = 0.3, 0.35, -0.15, 0.5, 0.3, -0.7

# ---- emails: plain, disguised, or broken over a line ---------------------------------------
_AT = r"(?:@\n?|\s?[\[({]\s?(?:at|arroba|at-sign)\s?[\])}]\s?|\sAT\s)"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punkt|punto|point)\s?[\])}]\s?|\sDOT\s)"
EMAIL = re.compile(rf"(?<![\w.+@-])[A-Za-z0-9][\w.+'-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w@])")
_AT_HINTS = ("@", "[at", "(at", "{at", "[ at", "( at", "[AT", "(AT", " AT ", "arroba")

# ---- phones and identity numbers ------------------------------------------------------------
NUMBER = re.compile(
    r"(?<![\w./+-])(?<!\d[ ,])(?:"
    r"(?P<intl>(?:\+|00)[1-9]\d{0,2}[ .\-/]?(?:\(0\)[ .\-]?)?(?:\(\d{1,4}\)[ .\-]?)?\d(?:[ .\-/]?\d){5,12})"
    r"|(?P<trunk>\(\d{2,5}\)[ .\-]{0,3}\d{3,4}(?:[ ]?[-. ][ ]?\d{3,6})?|0\d(?:[ .]\d{2}){4}|0\d{2,4}[ /]\d{3,6}(?:[ \-]\d{3,6})?|(?:1[-. ])?\d{3}([-.])\d{3}\3\d{4})"
    r"|(?P<id>\d{3}[- ]\d{2}[- ]\d{4}|(?:19|20)?\d{6}[-+]\d{4}|\d{2} ?\d{3} ?\d{3} ?\d{3}|\d{9}|\d{11}"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|[A-Z]{1,2}\d{6,8}|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?)"
    r")(?![\w]|[-/.]\d)"
)
# Words that say whose number it is, that it is a phone's, or that it is neither.
ID_WORDS = re.compile(
    r"(?i)\b(?:SSN|social[ -]security|national[ -]insurance|NI (?:number|no)|NINO|passport|passeport|pasaporte|reisepass|pass(?:-?nr|nummer)|identity card|id card|personal identity|identification number|"
    r"national id|ausweis\w*|personalausweis|DNI|NIE|NIF|tax(?:payer)? (?:id|number|identification)|TIN|ITIN|steuer-?(?:id|nummer|identifikationsnummer)|sozialversicherungs\w*|versicherungs\w*|personnummer|"
    r"carte d'identité|sécurité sociale|num[ée]ro (?:fiscal|de sécurité sociale|d'identité)|seguridad social|documento de identidad|carné|insurance (?:number|no))(?:\s*(?:no\.?|nr\.?|number|numéro|número|nummer|n[º°]))?[\s:#.]{0,3}$"
)
_LABELS = ID_WORDS.pattern[: ID_WORDS.pattern.rindex("[")].removeprefix("(?i)")
#: A label with a few words between it and the number, in the same sentence, or right after it in brackets.
ID_NEAR = re.compile(rf"(?i){_LABELS}(?:[ ,:(]+(?:(?!or\b|and\b)[a-zà-ÿ]+[ ,:(]+){{1,4}}|\s*\(\s*)$")
ID_AFTER = re.compile(rf"(?i)\s*[(,]\s*(?:(?:my|his|her|the|a|sein|ihr|son|su)\s)?{_LABELS}")
PHONE_WORDS = re.compile(r"(?i)\b(?:tel|tél|phone|téléphone|teléfono|telefon|telephone|mobile|mobil|móvil|portable|call|llame al?|ring|text|fax|appel\w*|anruf\w*|unter|contact|fon|dial|reach\w*|or|au)\b[\s.:|]{0,4}\+?$")
NOT_PERSONAL = re.compile(r"(?i)\b(?:lots?|lot numbers?|grant|award|application|serial|patent|participant|codes?|doi|ISSN|ISBN|budgets? of|report no\.|invoice|order|version|sample|batch|version|items?|article)(?:[\w /:-]|\.(?=\d)){0,24}$")

CARD = re.compile(r"(?<![\w.+-])(?:\d{4}[ -]?){3}\d{1,7}(?![\w-])|(?<![\w.+-])3\d{3}[ -]?\d{6}[ -]?\d{5}(?![\w-])")
IBAN = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])")
CARD_WORDS = re.compile(r"(?i)\b(?:card|visa|mastercard|amex|kreditkarte\w*|carte|tarjeta)(?:\s*(?:no\.?|nr\.?|number|numéro|número|nummer))?[\s:#.]{0,3}$")
IBAN_WORDS = re.compile(r"(?i)\b(?:IBAN|account|konto|compte|cuenta)[\s:#.]{0,3}$")

# ---- addresses ------------------------------------------------------------------------------
_C = r"[A-ZÀ-Þ][^\W\d_]+"
_ROAD = r"(?:Street|St\b\.?|Road|Rd\b\.?|Avenue|Ave\b\.?|Drive|Dr\b\.?|Lane|Ln\b\.?|Terrace|Gardens|Close|Court|Ct\b\.?|Crescent|Square|Sq\b\.?|Boulevard|Blvd\b\.?|Way|Place|Pl\b\.?|Grove|Hill|Mews|Row|Walk|Park|Quay|Parade|Highway)"
#: House number first (English and French), street first, and street names with the kind at their end.
_HOUSE = re.compile(
    rf"[0-9][0-9]{{0,4}}(?:[A-Za-z]?\s(?:{_C}\s){{1,3}}{_ROAD}(?:,\s(?:Apt\.?|Flat|Unit)\s\w+)?"
    rf"|(?:\s?(?:bis|ter|quater|[a-d]))?,?\s(?:rue|avenue|av\.|boulevard|bd|place|allée|chemin|impasse|quai|cours|route)\s(?:(?:de la|de l'|du|des|de|d')\s?)?{_C}(?:[ -]{_C})*)"
)
_STREET = re.compile(rf"(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrera|Via|Viale|Piazza)\s(?:(?:de la|de los|de las|del|de)\s)?{_C}(?:\s{_C})*,?\s(?:n[º°]\s?)?\d{{1,4}}")
_KINDS_LAST = tuple("straße strasse str. weg gasse allee platz ufer ring damm steig Straße Strasse Str. Weg Allee Platz Ufer Ring Damm".split())
_NUMBER_AFTER = re.compile(r" [0-9][0-9]{0,3}(?: ?[a-z]\b)?(?!\w)")
_FLAT = re.compile(r"(?:Flat|Apartment|Apt\.?|Unit|Suite|Room)\s\d+[A-Za-z]?,\s$")
_NAME_OF_STREET = re.compile(rf"(?<!\w){_C}(?:\.|\s(?:Straße|Strasse|Str\.|Weg|Allee|Platz|Ufer|Ring|Damm))?$")
NOT_ADDRESS = re.compile(r"(?i)^[\s,]*(?:district|cluster|corridor|line|project|programme|scheme|plant|site trips)")
ROUTE = re.compile(r"(?i)\b(?:route|table|figure|section|line|panel|chapter)\s$")

# ---- names ----------------------------------------------------------------------------------
# Particles, courtesy titles, and words that make a capitalised run no person.
_P = r"(?:(?:[Dd]e la|[Vv]an der|[Vv]an den|[Vv]on der|[Vv]on|[Vv]an|[Dd]i|[Aa]f|[Tt]er|[Dd]el|[Dd]e|[Dd]a|[Dd]os|VAN DER|DE LA|VON|AF|TER|DI) )"
_S = rf"{_P}?{_C}(?:-{_C})?"
_TITLE = r"(?:Dr|Prof|Professor|Professorin|Professeur|Mr|Mrs|Ms|Miss|Mme|Mlle|Herrn?|Frau|Sra?|Srta|Señora?|Don|Doña|Dra|Profa|Sir|Dame)"
_INIT = r"[A-ZÀ-Þ]\."
FULL = rf"(?:{_C}(?:-{_C})?|{_INIT})(?: (?:{_INIT}|[\"“][^\W\d_]+[\"”]))* {_S}"
INVERTED = rf"{_S}, (?:{_C}(?: {_INIT})*|{_INIT}(?: {_INIT})*)"
NAME = re.compile(rf"(?<![\w@.\-'’/])(?!(?<=\d ){_INIT})(?:(?P<title>(?:{_TITLE}\.?\s)+)(?P<titled>{FULL}|{INVERTED}|{_S})|(?P<inverted>{INVERTED})|(?P<full>{FULL}))(?![\w@+]|[-.]\w)")
#: What every name begins with, by a cheap scan; a particle may stand before it.
_PAIR = re.compile(r"[A-ZÀ-Þ](?:\.|[^\W\d_]+(?:-[A-ZÀ-Þ][^\W\d_]+)?[.,]?)\s(?:[\"“]?[A-ZÀ-Þ]|(?:de|van|von|di|af|ter|del|da|dos)\s)")
_LEAD = re.compile(rf"(?<!\w){_P}$")
_CAPS = re.compile(rf"{_C}|{_INIT}")
FUNCTION_WORDS = frozenset(
    "The A An In On At Of For From To By With As And Or But If When While Since Because Although However Overall Our We This That These Those Their Its It He She They Using Only Once After Before Between Under Over"
    " Der Die Das Ein Eine Einen Im Am Nach Für Und Oder Wenn Zwischen Wir Mit Bei Von Vom Zum Zur Den Dem Des Als Auf In Zu"
    " Le La Les Un Une Des Du De En Et Au Aux Nous Selon Entre Pour Dans Sur Avec Par Si L"
    " El Los Las Una Unos Según Con Por Para Del Al Y Se Su"
    " Section Table Figure Panel Chapter Application Appendix Part Page Equation Grant Calle Flat Apt Contact Contacto Kontakt Correspondence Author Tel Call Questions Payments Fieldwork".split()
)
NOT_PERSON = frozenset(
    "Institute Institut Instituto Foundation Stiftung Fondation Fundación University Universität Université Universidad Academy Akademie Académie School College Department Ministry Agency Council Commission Committee"
    " Act Avenue Street Road Gardens Terrace Close Court Drive Lane Boulevard Square Place Way Crescent Ave Rd St Blvd Hospital Museum Bank Group Company Inc Ltd GmbH AG SA Corp Sons Brothers Partners Holdings Laboratory Laboratories Lab Centre"
    " Center Zentrum Press Verlag Journal Review Letters Report Reports Series Programme Program Project Index Prize Award Medal Test Score Model Method Strategy Setting Implications Results Methods Data Introduction Conclusion Discussion"
    " Background Theory Robustness Appendix District Region Valley Island River Lake Port Airport Station Bridge Reform Dataset Corridor".split()
)
NAME_BEFORE = re.compile(
    r"(?i)(?:\bthanks?\b|\bdanken\b|\bdankt\b|\bremercions\b|\bagradecemos\b|\binterview(?:s|ed)?\b|\bgespräch mit\b|\bentrevista con\b|\bentretien avec\b|\bcontacto?\b|\bkontakt\b|\bansprechpartner\w*\b|\bcorrespondence\b|\bsigned\b|\bled by\b|\blists\b"
    r"|\breads\b|\btranscript\b|\bbelonged to\b|\bform of\b|\bantrag von\b|\bexpediente de\b|\bdossier de\b|\bpayments to\b|\bsent to\b|\brückfragen an\b|\bnote:|\btogether with\b|\basked\b|\bextract,|\bAs\b|\bappears?\b|\bwith\b|\bby\b|\bnamed\b|\bemployee\b"
    r"|\bparticipant\b|\bauthor:|\bautor\w*:|\bname:|\bnom:|\bnombre:|\bvon\b\s?$|\ban\b\s?$|\bavec\b|\bcon\b)(?:\b[A-Z]\.|\b(?:Dr|Prof|Mrs?|Ms)\.|[^.!?\n]){0,60}[ \t|:;,(<]*$"
)
NAME_ABOVE = re.compile(r"(?i)\b(?:signed|contacto?|kontakt|ansprechpartner\w*|regards|sincerely|grüßen)[ :.,]*\n\s*$")
NAME_AFTER = re.compile(
    r"(?i)^(?:,?\s?(?:jr|sr|phd|md|ii|iii|iv)\b\.?)?\s?(?:[;|]|,?\s?[(<]{0,2}(?:mailto:)?[\w.+'-]+(?:@|\s?[\[(]at[\])]|\sAT\s)|,?\s(?:joined|coded|put it|had asked|appears|shows|who|told|said|wrote|erklärte|sagte|tuvo|fand|incluye|steht|porte|a eu lieu|hat|y a\s|and\s+[A-Z]\S+ [A-Z]|und\s+[A-Z])|\s;|$|\n)"
)
#: What people do, by the form of the word that follows; and endings that names rarely have but nouns do.
_DOES = re.compile(r"^,?\s(?:(?:[a-z]{2,}(?:ed|ied)|said|says|met|left|gave|took|came|went|wrote|told|spoke|held|began|chose|grew|ran|sat|stood|thought|brought|lives?|works?|knows?|was|is|has|had|will|would|can|could)\b(?! (?:by|to be|in the)\b)"
    r"|(?:war|ist|wohnt|arbeitet|kam|ging|schrieb|sprach|[a-zäöü]{3,}te)\s|(?:était|est|vit|travaille|[a-z]{3,}(?:ait|a))\s|(?:era|es|vive|trabaja|[a-zñ]{3,}(?:ó|ía|aba))\s)")  # fmt: skip
_NOUN = re.compile(r"(?:tion|sion|ment|ity|ness|ance|ence|ics|ing|ship|ism|ure|logy|graphy|ung|heit|keit|schaft|tät|ción|dad|ité|ies|ers|ors|als|ants|ents|ions|ysis|ory|ary|ive|ial|ical|ous|able|ible)$")
_PLAIN_PARTICLE = re.compile(r"\s(?:von|van|de|da|di|del)\s")
_PREPOSITION = re.compile(r"(?:de|von|du|da|del|di)\s(?!la\b|der\b|den\b)")
OF_FILE = re.compile(r"(?i)\b(?:expediente|dossier|antrag|akte|carpeta|carta|lettre|brief|solicitud|demande)\s$")
CITED = re.compile(r"^(?:\s+(?:et al\.?|and|und|et|y|&)(?:\s+[A-Z][\w-]+)?)?\s*\(?\d{4}[a-z]?\)")
_BREAK = re.compile(r"(?:[.!?:]\s+|\n[\s>*#-]*|^[\s>*#-]*|\|\s)$")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return bool(digits) and total % 10 == 0


def mod97(digits: str) -> bool:
    """A 15-digit number whose last two are the complement of the rest to 97."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def mod11_10(digits: str) -> bool:
    """The hybrid check of ISO 7064 over all digits."""
    p = 10
    for d in digits[:-1]:
        p = ((int(d) + p) % 10 or 10) * 2 % 11
    return (11 - p) % 10 == int(digits[-1])


def iban_holds(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def card_holds(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    return 13 <= len(digits) <= 19 and digits[0] in "3456" and luhn(digits)


def check(text: str) -> bool | None:
    """Whether an identity number's own check holds; None where its kind has none."""
    s = re.sub(r"[^0-9A-Z]", "", text)
    digits = re.sub(r"\D", "", s)
    if re.fullmatch(r"[XYZ]\d{7}[A-Z]|\d{8}[A-Z]", s):
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:-1].replace("X", "0").replace("Y", "1").replace("Z", "2")) % 23] == s[-1]
    if not s.isdigit():
        return None
    if len(digits) in (10, 12) and text[-5] in "-+":  # a day of birth and a Luhn digit; the day may be raised by 60
        month, day = int(digits[-8:-6]), int(digits[-6:-4])
        return 1 <= month <= 12 and 1 <= day % 60 <= 31 and luhn(digits[-10:])
    if len(digits) == 15:
        return mod97(digits)
    if len(digits) == 11:
        most = max(map(digits[:10].count, "0123456789"))
        return digits[0] != "0" and 2 <= most <= 3 and mod11_10(digits)
    if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", text):  # no checksum, but numbers that are never given out
        return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    return None


def checked(text: str) -> bool:
    return check(text) is True


def _near(text: str, hints: tuple[str, ...], back: int, ahead: int) -> list[tuple[int, int]]:
    """Merged stretches of the text around every occurrence of a hint: a literal search is far cheaper than the patterns."""
    at = []
    for h in hints:
        i = text.find(h)
        while i >= 0:
            at.append(i)
            i = text.find(h, i + 1)
    out: list[tuple[int, int]] = []
    for i in sorted(at):
        a, b = max(0, i - back), min(len(text), i + ahead)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


_RUN = re.compile(r"[+(0-9][\d ().\-/+]{5,}")


def _numbers(text: str, out: list) -> None:
    stretches: list[tuple[int, int]] = []
    for r in _RUN.finditer(text):
        if sum(map(str.isdigit, r[0])) >= 6:
            a, b = max(0, r.start() - 3), min(len(text), r.end() + 3)
            if stretches and a <= stretches[-1][1]:
                a = stretches.pop()[0]
            stretches.append((a, b))
    for a, b in stretches:
        _numbers_in(text, a, b, out)


def _score(holds: bool | None, label: bool, near: bool, veto: bool) -> float:
    check_part = 0.0 if holds is None else HOLDS if holds else FAILS
    return SHAPE + check_part + (LABEL if label else LABEL_NEAR if near else 0.0) + VETO * veto


def _numbers_in(text: str, start: int, stop: int, out: list) -> None:
    for m in NUMBER.finditer(text, start, stop):
        a, b = m.span()
        before = text[max(0, a - NEAR[0]) : a]
        veto = bool(NOT_PERSONAL.search(before))
        if m["id"]:
            holds = check(m[0])
            label = bool(ID_WORDS.search(before))
            near = not label and holds is not False and bool(ID_NEAR.search(before) or ID_AFTER.match(text[b : b + NEAR[1]]))
            out.append(("id_number", a, b, _score(holds, label, near, veto)))
            if not re.fullmatch(r"0\d(?: \d\d){4}", m[0]):
                continue
        n = sum(c.isdigit() for c in m[0])
        score = (0.7 if m["intl"] else 0.6) if 9 <= n <= 15 else 0.3
        score += 0.2 * bool(PHONE_WORDS.search(before)) - 0.8 * veto - 0.6 * bool(re.search(r"\d to $", before))
        out.append(("phone", a, b, score))
    if sum(map(str.isdigit, text[start:stop])) >= 10:
        for kind, pattern, words, holds in (("card", CARD, CARD_WORDS, card_holds), ("iban", IBAN, IBAN_WORDS, iban_holds)):
            for m in pattern.finditer(text, max(0, start - 12) if kind == "iban" else start, min(len(text), stop + 30)):
                before = text[max(0, m.start() - NEAR[0]) : m.start()]
                out.append((kind, *m.span(), _score(holds(m[0]), bool(words.search(before)), False, bool(NOT_PERSONAL.search(before)))))


def _addresses(text: str, out: list) -> None:
    found = [(m.start(), m.end()) for p in (_HOUSE, _STREET) for m in p.finditer(text) if not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in ".,/-"))]
    for i, (a, b) in enumerate(found):
        if flat := _FLAT.search(text, max(0, a - 20), a):
            found[i] = (flat.start(), b)
    for m in _NUMBER_AFTER.finditer(text):
        if text.endswith(_KINDS_LAST, 0, m.start()) and (name := _NAME_OF_STREET.search(text, max(0, m.start() - 40), m.start())):
            found.append((name.start(), m.end()))
    for a, b in found:
        score = 0.7 - 0.6 * bool(NOT_ADDRESS.search(text[b : b + 24])) - 0.6 * bool(ROUTE.search(text[max(0, a - 12) : a]))
        out.append(("address", a, b, score))


def _names(text: str, out: list) -> None:
    at = 0
    while c := _PAIR.search(text, at):
        a = c.start()
        at = c.end() - 1
        lead = _LEAD.search(text, max(0, a - 9), a)
        m = lead and NAME.match(text, lead.start()) or NAME.match(text, a)
        if not m:
            continue
        a, b = m.span()
        if m["title"]:
            out.append(("name", m.start("titled"), b, 0.9 - 0.6 * bool(CITED.match(text[b : b + 40]))))
            at = b
            continue
        words = _CAPS.findall(m[0])
        if words[0] in FUNCTION_WORDS:  # a sentence's or phrase's first word: the name may start after it
            continue
        before, after = text[max(0, a - NEAR_NAME[0]) : a], text[b : b + NEAR_NAME[1]]
        if OF_FILE.search(before) and (p := _PREPOSITION.match(m[0])):  # "the file of Surname, Given": no particle
            a += p.end()
            before += p[0]
        last = re.split(r"[\s-]", m[0])[-1]
        following = re.match(r"\s([^\W\d_]+)", after)
        if words[-1] in NOT_PERSON or last in NOT_PERSON or following and following[1] in NOT_PERSON or words[0] in NOT_PERSON:
            continue
        line = text[text.rfind("\n", 0, a) + 1 : a]
        if line.lstrip("> ").startswith("#") or CITED.match(after):
            continue
        score = 0.2 if m["inverted"] else 0.6
        score -= 0.4 * bool(_BREAK.search(before)) * (not m["inverted"])
        cues = bool(NAME_BEFORE.search(before) or NAME_ABOVE.search(before)) + bool(NAME_AFTER.search(after))
        if not cues and m["full"] and _DOES.match(after) and not any(w in FUNCTION_WORDS or _NOUN.search(w) or len(w) > 2 and re.search(rf"\b{w.lower()}\b", text) for w in words):
            cues = 1  # nothing but its shape and what follows: no noun's ending, and never written small in this text
        score += 0.2 * bool(re.search(_INIT, m[0])) + 0.4 * cues
        if not cues and m["full"] and any(_NOUN.search(w) for w in words):
            score -= 0.3
        if not cues and m["full"] and _PLAIN_PARTICLE.search(m[0]):  # "Mobility of Engineers" in another language
            score -= 0.3
        if score >= THRESHOLD:
            out.append(("name", a, b, score))
            at = b


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` of the kept spans in order; offsets in code points."""
    proposed: list[tuple[str, int, int, float]] = []
    for a, b in _near(text, _AT_HINTS, *NEAR_AT):
        proposed += [("email", *m.span(), 0.9) for m in EMAIL.finditer(text, a, b)]
    _numbers(text, proposed)
    _addresses(text, proposed)
    _names(text, proposed)
    kept: list[tuple[int, int, str, float]] = []
    for kind in KINDS:
        for k, a, b, score in sorted(x for x in proposed if x[0] == kind and x[3] >= THRESHOLD - 1e-9):
            i = bisect_right(kept, (a, -1, "", 0.0))
            if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or kept[i][0] >= b):
                kept.insert(i, (a, b, k, score))
    return [(k, a, b, score) for a, b, k, score in kept]


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, kind, char_start, char_end, score)``: one row per item found, offsets 0-based in code points.

    Null and empty texts give no row; a row repeated in the input is repeated in the output; a null
    id is kept. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *span) for i, text in zip(b["id"], b["text"]) if text for span in find_spans(text)]
            yield pd.DataFrame(rows, columns=["id", "kind", "char_start", "char_end", "score"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, kind string, char_start int, char_end int, score double")
    return found.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", out_col: str = "redacted") -> DataFrame:
    """The rows with a column in which every item is replaced by ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``,
    ``[CARD]``, ``[IBAN]``, ``[ADDRESS]`` or ``[NAME]``. Null stays null. An existing column of that name is replaced."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if not t else replace(t))

    return docs.withColumn(out_col, clean(text_col))


def replace(text: str) -> str:
    parts, at = [], 0
    for kind, a, b, _ in find_spans(text):
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])

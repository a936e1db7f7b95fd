"""Text functions: Column in, Column out, all within code generation."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and their bases, by Unicode's own decomposition.
_ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFD", c)[0] != c and ord(unicodedata.normalize("NFD", c)[0]) < 128)
_BASE = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)

#: Words of a line that tell nothing apart.
LINE_STOPWORDS = (
    "about after afternoon again around back before day early evening free from get getting have here into late maybe morning "
    "need night over some somewhere take that them then there this time today wake walk want well will with your"
).split()
#: Role words that an audit identity leaves out.
AUDIT_WORDS = "at the a an guided guide tour visit optional breakfast lunch dinner meal fly flight".split()

#: Patterns of lines that are document plumbing, and of planning costs.
BOILERPLATE = [
    r"(?i)^=+\s*page\s+\d+\s*=*$",
    r"(?i)^page\s+\d+(?:\s+of\s+\d+)?$",
    r"(?i)^order\s+(?:summary|number|total)\b",
    r"(?i)^(?:booking|reservation|ticket)\s+(?:reference|number|code)\s*:",
]
PLANNING_COST = [
    r"(?i)^costs?$",
    r"(?i)^(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}(?:st|nd|rd|th)?\s*,?\s+[a-zà-ÿ .'-]+[-–—]\s*\$\d",
    r"(?i)\bbudget:?\s*\$?\d",
    r"(?i)^[a-zà-ÿ' /&-]{2,40}:\s*\$\d[\d,.]*(?:\s*\(|\s*\+|\s*$)",
    r"^\+?\s*\$\d[\d,.]*\b",
    r"\(\s*\$\d[\d,.]*\s*[-–]\s*\$\d[\d,.]*\s*\)\s*$",
]
#: Fixed value: the pattern of a price.
PRICE = r"(?i)\b\d+(?:[.,]\d+)?\s*(?:eur(?:os?)?|czk|kc|korunas?|huf|ft|forints?|usd|dollars?|gbp|pounds?)\b|[€$£]\s?\d"


def fold(c: Column) -> Column:
    """Lower case without accents; null is empty."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, _ACCENTED, _BASE))


def normalize(c: Column) -> Column:
    """Folded text with ``&`` as `` and `` and every run of other than a-z0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.replace(fold(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    """Runs of a-z0-9 of the folded text, repeated ones too."""
    return F.filter(F.split(F.regexp_replace(fold(c), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def distinctive_tokens(c: Column) -> Column:
    """Tokens of four characters or more that are no number and no stop word."""
    stop = F.array(*[F.lit(w) for w in LINE_STOPWORDS])
    return F.filter(tokens(c), lambda x: (F.length(x) >= 4) & ~x.rlike("^[0-9]+$") & ~F.array_contains(stop, x))


def audit_identity(c: Column) -> Column:
    words = F.array(*[F.lit(w) for w in AUDIT_WORDS])
    return F.array_join(F.filter(F.split(normalize(c), " "), lambda x: ~F.array_contains(words, x) & (x != "")), " ")


def squeeze(c: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " "))


def strip_decorations(c: Column) -> Column:
    """Without leading bullets, then without a leading list number."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s*[-*•●▪◦>·]+\s*", ""), r"^[0-9]{1,2}[.)]\s+", "")


def any_of(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def one_edit(a: Column, b: Column) -> Column:
    """Exactly one insertion, deletion or substitution apart."""
    return F.levenshtein(a, b, 1) == 1


#: Patterns of a clock time and of a date with a time, in lower case.
CLOCK = r"^(?:at\s*)?(\d{1,2})(?:[:.](\d{2}))?\s*(am|pm)?$"
CLOCK_ISO = r"^\d{4}-\d{2}-\d{2}[t\s](\d{1,2}):(\d{2})(?::\d{2}(?:\.\d+)?)?(?:z|[+-]\d{2}:?\d{2})?$"


def clock(c: Column) -> Column:
    """``HH:mm`` of ``at 9``, ``at9``, ``9:30 pm``, ``14.30`` or a date with a time; null where it is none.
    Hours go from 0 to 23; ``pm`` adds twelve to those before noon, ``am`` makes 12 midnight."""
    text = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    is_clock = text.rlike(CLOCK)
    part = lambda i: F.when(is_clock, F.regexp_extract(text, CLOCK, i)).when(text.rlike(CLOCK_ISO), F.regexp_extract(text, CLOCK_ISO, i))
    h, m = part(1).try_cast("int"), F.coalesce(F.nullif(part(2), F.lit("")).try_cast("int"), F.lit(0))
    half = F.when(is_clock, F.regexp_extract(text, CLOCK, 3)).otherwise("")
    h24 = F.when((half == "pm") & (h < 12), h + 12).when((half == "am") & (h == 12), 0).otherwise(h)
    pad = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.when((h <= 23) & (m <= 59), F.concat(pad(h24), F.lit(":"), pad(m)))


def trip_date(c: Column) -> Column:
    """ISO, or day-first then month-first with one separator, two-digit years in this century; null if no date."""
    text = F.trim(c)
    iso = F.try_to_date(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    p = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})$"
    a, b, y = F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 3), F.regexp_extract(text, p, 4)
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    as_date = lambda d, m: F.try_to_date(F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), iso).when(text.rlike(p), F.coalesce(as_date(a, b), as_date(b, a)))


_MONTH_NAME = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
#: Patterns of dates within a text.
DATE_NUMERIC = r"\b(\d{1,2})([./])(\d{1,2})\2(\d{2}|\d{4})\b"
DATE_MONTH_FIRST = rf"(?i)\b{_MONTH_NAME}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?\b"
DATE_DAY_FIRST = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+{_MONTH_NAME}(?:,?\s+(\d{{4}}))?\b"


def written_date(c: Column) -> Column:
    """Struct of ``iso``, the day that a text names, and ``md`` (MM-dd) where it names one by month and day without a year.

    ISO if that is all; else the first numeric date, day first and, if that is none, month first; else a month's name with a day, before
    it or after.  An impossible day is none."""
    text = F.regexp_replace(c, r"^\s+|\s+$", "")
    part = lambda p, i: F.regexp_extract(text, p, i)
    day = lambda y, m, d: F.date_format(F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")
    p = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    year = F.when(F.length(part(DATE_NUMERIC, 4)) == 2, F.concat(F.lit("20"), part(DATE_NUMERIC, 4))).otherwise(part(DATE_NUMERIC, 4))
    numeric = F.coalesce(day(year, part(DATE_NUMERIC, 3), part(DATE_NUMERIC, 1)), day(year, part(DATE_NUMERIC, 1), part(DATE_NUMERIC, 3)))
    first = text.rlike(DATE_MONTH_FIRST)
    pick = lambda i, j: F.when(first, part(DATE_MONTH_FIRST, i)).otherwise(part(DATE_DAY_FIRST, j))
    month = ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.left(pick(1, 2), F.lit(3)))) + 2) / 3).cast("int").cast("string")
    # a year may stand in either order's match
    named_year = F.coalesce(F.nullif(part(DATE_MONTH_FIRST, 3), F.lit("")), F.nullif(part(DATE_DAY_FIRST, 3), F.lit("")))
    named = first | text.rlike(DATE_DAY_FIRST)
    iso = F.when(text.rlike(p), day(part(p, 1), part(p, 2), part(p, 3))).when(text.rlike(DATE_NUMERIC), numeric).when(named, day(named_year, month, pick(2, 1)))
    md = F.when(text.rlike(p) | text.rlike(DATE_NUMERIC), None).when(named & named_year.isNull(), F.right(day(F.lit("2000"), month, pick(2, 1)), F.lit(5)))
    return F.struct(iso.alias("iso"), md.alias("md"))


def dates_match(a: Column, b: Column, a_text: Column, b_text: Column) -> Column:
    """Are two written dates the same day?  One without a year takes the other's; where a day is missing the normalised texts must agree."""
    whole = F.when(a["iso"].isNotNull() & b["iso"].isNotNull(), a["iso"] == b["iso"])
    half = F.when(a["iso"].isNotNull() & b["md"].isNotNull(), F.right(a["iso"], F.lit(5)) == b["md"]).when(b["iso"].isNotNull() & a["md"].isNotNull(), F.right(b["iso"], F.lit(5)) == a["md"])
    return F.coalesce(whole, F.when(half, F.lit(True)), (a_text != "") & (a_text == b_text), F.lit(False))


def truncate(c: Column, n: int) -> Column:
    """White space squeezed; over n characters the first n and dots."""
    text = squeeze(c)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


#: Words and patterns of a heading that names a day.
_MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_WEEKDAY = "(?:mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)"
_ORDINAL = r"\d{1,2}(?:st|nd|rd|th)?"
DAY_HEADING = rf"(?i)^{_WEEKDAY},?\s+{_MONTH}\s+{_ORDINAL}\b|^day\s+\d+\b.*\b{_MONTH}\s+{_ORDINAL}\b|^{_MONTH}\s+{_ORDINAL}\b|^\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{2,4}}\b"


def is_day_heading(c: Column) -> Column:
    """Is a line, without list and emphasis marks, a heading of at most 140 characters that begins with a day?"""
    bare = c
    for pattern, new in ((r"\s+", " "), (r"^[-*•●▪◦>·]+\s*", ""), (r"^#+\s*", ""), ("[*_`]", "")):
        bare = F.regexp_replace(bare, pattern, new)
    bare = F.trim(bare)
    return (bare != "") & (F.length(bare) <= 140) & bare.rlike(DAY_HEADING)

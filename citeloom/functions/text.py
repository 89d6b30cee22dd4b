"""Scalar text functions as native column expressions.

Patterns start with (?U) or (?iuU) where Unicode letters, digits or spaces are meant, since
Java's classes are ASCII otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Latin letters with a canonical decomposition, and their base letters."""
    source, target = [], []
    for code in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFKD", chr(code))
        base = "".join(c for c in parts if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


ACCENTED, BASE = _accent_table()
#: Marks on the section sign's abbreviations and dashes, fixed values.
DASHES = "–—"


def ascii_fold(text: Column) -> Column:
    """Letters without their accents; combining marks are dropped. Other characters stay."""
    return F.regexp_replace(F.translate(text, ACCENTED, BASE), r"\p{Mn}+", "")


def compact_key(text: Column) -> Column:
    """Upper-case letters and digits of the folded text; dashes, underscores and spaces do not count."""
    return F.regexp_replace(F.upper(ascii_fold(text)), "[^A-Z0-9]+", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fuzzy_text(text: Column) -> Column:
    return F.translate(F.upper(squeeze(ascii_fold(text))), DASHES + "_\\", "--//")


def normalize(text: Column) -> Column:
    """Text for matching: no zero-width characters, line breaks inside words joined, white space squeezed."""
    plain = F.regexp_replace(F.translate(text, "\u00a0\r", " \n"), "[\u200b-\u200d\u2060\ufeff\u00ad]", "")
    return squeeze(F.regexp_replace(plain, r"(?U)(?<=\p{L})-[ \t]*\n\s*(?=\p{L})", ""))


def reasoning_part(text: Column) -> Column:
    """Between the first spaced heading of the reasoning and the last instruction on appeals; all where they are not in that order."""
    start, end = r"(?iuU)O\s*d\s*ů\s*v\s*o\s*d\s*n\s*ě\s*n\s*í", r"(?iuU)P\s*o\s*u\s*č\s*e\s*n\s*í"
    parts = F.regexp_extract(text, rf"(?s){start}(.*){end}", 1)
    return F.when(F.length(parts) > 0, parts).otherwise(text)


def drop_page_lines(text: Column) -> Column:
    """Without lines that hold a continuation notice, a page number or a roman numeral only."""
    return F.regexp_replace(text, r"(?miuU)^\s*(?:pokračování.*|-?\s*\d{1,4}\s*-?|[IVXLC]+\.)\s*$\n?", "")


def repair_cp1250(text: Column, least: int = 3, within: int = 2000) -> Column:
    """Undoes CP1250 text that was read as Latin-1, where enough such characters stand in the first part."""
    pairs = [(bytes([b]).decode("latin-1"), bytes([b]).decode("cp1250", "ignore")) for b in range(0x80, 0x100)]
    pairs = [(a, b) for a, b in pairs if b and a != b]
    wrong = "".join(a for a, _ in pairs)
    signs = F.length(F.substring(text, 1, within)) - F.length(F.translate(F.substring(text, 1, within), wrong, ""))
    return F.when(signs >= least, F.translate(text, wrong, "".join(b for _, b in pairs))).otherwise(text)


def law_id(text: Column) -> Column:
    """'40/64 Sb.' -> '40/1964 Sb.'; two-digit years up to 30 are of this century, and numbers have any length. Others are squeezed."""
    plain = squeeze(text)
    number, year = (F.regexp_extract(plain, r"^(\d+)/(\d{2}|\d{4})\s*Sb\.$", i) for i in (1, 2))
    century = F.when(year.cast("int") <= 30, "20").otherwise("19")
    full = F.when(F.length(year) == 2, F.concat(century, year)).otherwise(year)
    return F.when(F.length(number) > 0, F.concat(number, F.lit("/"), full, F.lit(" Sb."))).otherwise(plain)


#: Values of roman numerals, fixed.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman(number: Column) -> Column:
    out, rest = F.lit(""), number.cast("int")
    parts = []
    for value, numeral in ROMAN:
        parts.append(F.repeat(F.lit(numeral), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.concat(out, *parts)


#: Words that say nothing about a law's topic, fixed values. Tokens are folded before they meet the
#: list, so its accented words, which are part of the published list, remove nothing.
STOPWORDS = frozenset(
    "a ale anebo ani bez by byl byla byly co do i jako je jej jejich jen jsou k která které který mezi na nad nebo o od po pod podle pro při "
    "s se si tak také to u v ve z za ze zákon zákona zákonem zákoník zákoníku vyhláška vyhlášky nařízení předpis předpisu část hlava oddíl "
    "odst odstavec písm pism čl cl paragraf sb".split()
)


def tokens(text: Column) -> Column:
    """Folded lower-case words of three characters or more that are no numbers and no stop words."""
    words = F.regexp_extract_all(F.lower(ascii_fold(text)), F.lit("[a-z0-9á-ž]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$") & ~w.isin(*sorted(STOPWORDS)))


def context(text: Column, start: Column, end: Column, radius: int) -> Column:
    """The characters around [start, end), with line breaks as spaces."""
    low = F.greatest(F.lit(0), start - radius)
    return F.translate(F.substr(text, low + 1, end + radius - low), "\n", " ")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def quality_features(text: Column) -> dict[str, Column]:
    """Counts and ratios that tell readable text from extraction artifacts. Strings count as code points."""
    n = F.length(text)
    lines = F.transform(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"), lambda x: F.trim(x))
    lines = F.when(n > 0, lines).otherwise(F.array().cast("array<string>"))
    full = F.filter(lines, lambda x: F.length(x) > 0)
    count = F.size(full)

    def those(test) -> Column:
        return F.size(F.filter(full, test))

    return {
        "char_count": n.cast("long"),
        "token_count": F.regexp_count(text, F.lit(r"(?U)\w+")).cast("long"),
        "alnum_ratio": _ratio(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), n),
        "whitespace_ratio": _ratio(n - F.length(F.regexp_replace(text, r"(?U)\s", "")), n),
        "control_ratio": _ratio(F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")), n),
        "replacement_char_ratio": _ratio(F.regexp_count(text, F.lit("\ufffd")), n),
        "mojibake_hits_per_10k": _ratio(F.regexp_count(text, F.lit(r"[ÃÂÄÅ](?U:\S{0,3})")) * 10_000, n),
        "hyphen_breaks_per_10k": _ratio(F.regexp_count(text, F.lit(r"(?U)\w-\s*\n\s*\w")) * 10_000, n),
        "line_count": F.size(lines).cast("long"),
        "nonempty_line_count": count.cast("long"),
        "avg_line_length": _ratio(F.aggregate(full, F.lit(0), lambda a, x: a + F.length(x)), count),
        "short_line_ratio": _ratio(those(lambda x: F.length(x) <= 20), count),
        "tiny_line_ratio": _ratio(those(lambda x: F.length(x) <= 3), count),
        "page_artifact_line_ratio": _ratio(those(lambda x: x.rlike(r"(?i)^(?:\d+|strana\s+\d+|-\s*\d+\s*-)$")), count),
        "duplicate_line_ratio": _ratio(count - F.size(F.array_distinct(full)), count),
    }


#: Limits of the quality classes: feature, test, limit, reason; fixed values.
SEVERE = (
    ("replacement_char_ratio", ">", 0.001, "replacement characters"),
    ("mojibake_hits_per_10k", ">", 8.0, "encoding artifacts"),
    ("control_ratio", ">", 0.002, "control characters"),
    ("alnum_ratio", "<", 0.45, "low alphanumeric share"),
    ("duplicate_line_ratio", ">", 0.45, "many repeated lines"),
    ("page_artifact_line_ratio", ">", 0.25, "many page-number lines"),
)
MODERATE = (
    ("replacement_char_ratio", ">", 0.0, "some replacement characters"),
    ("mojibake_hits_per_10k", ">", 0.0, "some encoding artifacts"),
    ("hyphen_breaks_per_10k", ">", 12.0, "many line-break hyphenations"),
    ("short_line_ratio", ">", 0.35, "many short lines"),
    ("duplicate_line_ratio", ">", 0.20, "repeated lines"),
    ("page_artifact_line_ratio", ">", 0.08, "page-number lines"),
    ("whitespace_ratio", ">", 0.30, "high whitespace share"),
)


def quality_class() -> tuple[Column, Column]:
    """(category, reasons) over the columns of ``quality_features``: empty_or_short, artifacts or readable."""

    def fired(rules) -> Column:
        tests = [F.when(F.col(f) > x if op == ">" else F.col(f) < x, why) for f, op, x, why in rules]
        return F.array_compact(F.array(*tests))

    severe = F.concat(fired(SEVERE), F.when((F.col("avg_line_length") < 18) & (F.col("short_line_ratio") > 0.55), F.array(F.lit("fragmented line layout"))).otherwise(F.array().cast("array<string>")))
    moderate = fired(MODERATE)
    short = (F.col("char_count") < 500) | (F.col("token_count") < 50)
    category = F.when(short, "empty_or_short").when((F.size(severe) > 0) | (F.size(moderate) > 0), "artifacts").otherwise("readable")
    reasons = F.when(short, F.array(F.lit("very short or nearly empty text"))).when(F.size(severe) > 0, F.transform(severe, lambda r: F.concat(F.lit("severe signal: "), r))).otherwise(moderate)
    return category, reasons


from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and what they stand for; answers that mean nothing.
TYPOGRAPHIC, PLAIN = "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0", "''\"\"-- "
NULL_MARKERS = ["n/a", "na", "none", "unknown", "tbd", "-", "\u2014"]
ELLIPSIS = "\u2026"


def trimmed(c) -> Column:
    """Without white space at either end; null becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def has_value(c) -> Column:
    """neither null nor blank."""
    return trimmed(c) != ""


def or_default(c, default: str) -> Column:
    return F.when(has_value(c), trimmed(c)).otherwise(default)


def substantive(c) -> Column:
    """[F8] two characters or more that are no null marker."""
    t = trimmed(c)
    return (F.length(t) >= 2) & ~F.lower(t).isin(NULL_MARKERS)


def tokenize(c) -> Column:
    """[X1] runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def normalize(c) -> Column:
    """[X2] typographic characters made plain, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(c, TYPOGRAPHIC, PLAIN), r"(?U)\s+", " "))


def is_verbatim(quote, source) -> Column:
    """[X3] the normalised quote stands in the normalised source, whatever the case; an empty side never does."""
    q, s = F.lower(normalize(quote)), F.lower(normalize(source))
    return F.coalesce((F.length(quote) > 0) & (F.length(source) > 0) & s.contains(q), F.lit(False))


def verbatim_pattern(quote) -> Column:
    """A regular expression for the quote in raw text: typographic variants and any white space."""
    escaped = F.regexp_replace(normalize(quote), r"([\\\[\](){}.*+?^$|#&~])", r"\\$1")
    for plain, variants in (("'", "['\u2018\u2019]"), ('"', '["\u201c\u201d]'), ("-", "[-\u2013\u2014]")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(variants))
    return F.concat(F.lit("(?iu)"), F.replace(escaped, F.lit(" "), F.lit(r"(?U:\s)+")))


def verbatim_span(quote, source) -> Column:
    """[X4] struct(start, end) of the quote's first place in the raw source, end exclusive, in characters; null without one."""
    found = F.regexp_substr(source, verbatim_pattern(quote))
    start = F.instr(source, found) - 1
    return F.when(F.coalesce(normalize(quote) != "", F.lit(False)) & found.isNotNull(), F.struct(start.alias("start"), (start + F.length(found)).alias("end")))


def strip_section_prefix(c) -> Column:
    """[X5] less one bracketed title and line break at the start."""
    return F.regexp_replace(c, r"^\[[^\]\n]{1,120}\]\s*\n+", "")


def raw_excerpt(c, most: int = 400) -> Column:
    """[X6] at most ``most`` characters of the body, cut after a sentence beyond character 100, else at a space with an ellipsis; null for an empty body."""
    body = trimmed(strip_section_prefix(c))
    cut = F.left(body, F.lit(most))
    last = F.length(cut) - F.instr(F.reverse(cut), " .") - 1  # place of the last ". " from 0
    sentence = (F.instr(F.reverse(cut), " .") > 0) & (last > 100)
    word = F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit(ELLIPSIS))
    return F.when(body == "", None).when(F.length(body) <= most, body).when(sentence, F.left(cut, last + 1)).otherwise(word)


def slugify(c, default: str = "gap") -> Column:
    """[X8]"""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(s == "", default).otherwise(s)


def first_line(c) -> Column:
    """[X9]"""
    return F.trim(F.split_part(trimmed(c), F.lit("\n"), F.lit(1)))


def truncate_to_words(c, n: int) -> Column:
    """[X9]"""
    words = F.filter(F.split(trimmed(c), r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def word_count(c) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def capped(c, most: int) -> Column:
    """[X11, X12] cut to ``most`` characters with an ellipsis as the last."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.left(c, F.lit(most - 1))), F.lit(ELLIPSIS))).otherwise(c)


def joined_nonblank(columns: list, separator: str) -> Column:
    """[X10, P16, P18] the non-blank values, trimmed, in order."""
    return F.array_join(F.filter(F.array(*[trimmed(c) for c in columns]), lambda x: x != ""), separator)


def word_capped(c, most: int = 500) -> Column:
    """[X10] at most ``most`` characters, cut at a space."""
    return F.when(F.length(c) > most, F.regexp_replace(F.left(c, F.lit(most)), r" [^ ]*$", "")).otherwise(c)


def strip_glyphs(c) -> Column:
    """[X13] without undecoded glyph marks."""
    return F.regexp_replace(F.regexp_replace(c, r"\(cid:\d+\)", " "), r"[ \t]{2,}", " ")


def chapter_number(c) -> Column:
    """[X14] the leading dotted number of a header, else null."""
    n = F.regexp_extract(c, r"(?i)^(?:section\s+)?(\d+(?:\.\d+)*)", 1)
    return F.when(n != "", n)


def format_table(rows) -> Column:
    """[X15] cells joined by bars, rows by line breaks; blank cells and rows left out."""
    line = lambda cells: F.array_join(F.filter(F.transform(cells, trimmed), lambda x: x != ""), " | ")
    return F.array_join(F.filter(F.transform(rows, line), lambda x: x != ""), "\n")


def sentences(c) -> Column:
    """[X16]"""
    return F.split(F.replace(c, F.lit(". "), F.lit(".\n")), "\n")


def response_type(c, known: list[str], default: str) -> Column:
    """[X17]"""
    k = F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), " -", "__")
    return F.when(k.isin(known), k).otherwise(default)


def strip_fence(c) -> Column:
    """[X18] a fenced block's content."""
    t = trimmed(c)
    return F.when(t.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"\n?```\s*$", ""))).otherwise(t)


def retry_delay(c, default: float = 30.0, most: float = 70.0) -> Column:
    """[X19] seconds named by an error text, plus one and clamped."""
    s = F.regexp_extract(c, r"(?i)retry(?:_delay|\s+in|delay)?\D{0,20}(\d+(?:\.\d+)?)", 1)
    return F.least(F.coalesce(F.when(s != "", s.cast("double")) + 1, F.lit(default)), F.lit(most))


def member_key(ids) -> Column:
    """[X22]"""
    return F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), ",")


def estimated_tokens(c) -> Column:
    """[X23]"""
    return F.floor(F.length(c) / 4)


def likely_header(c, known: list[str]) -> Column:
    """a short line that is a known section, a numbered one or all capitals, and no page number."""
    t = F.trim(c)
    skip = t.rlike(r"^\d+$") | t.rlike(r"(?i)^page\s+\d+")
    shape = t.rlike(r"(?i)^(?:section\s+)?\d+(?:\.\d+)*[.:\s]") | t.rlike(r"^[A-Z][A-Z\s\-&,/]{2,}$")
    return F.coalesce((t != "") & (F.length(t) <= 120) & (word_count(t) <= 12) & ~skip & (F.lower(t).isin(known) | shape), F.lit(False))


def section_label(title, page, article) -> Column:
    """[P3] the fullest label that the parts allow; empty counts as missing."""
    t, p, a = has_value(title), page.isNotNull(), has_value(article)
    page_name = F.concat(F.lit("Page "), page.cast("string"))
    return F.when(t & p, F.concat(title, F.lit(" \u2014 "), page_name)).when(t & a, F.concat(title, F.lit(" \u2014 "), article)).when(t, title).when(a, article).when(p, page_name).otherwise("Unknown section")

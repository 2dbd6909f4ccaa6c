"""Texts of tariff documents, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "body_of", "casefold", "chunk_content", "excerpt", "excerpt_again", "heading_kind", "join_lines", "leaders", "normal_words", "outline_line", "page_number", "quote_in", "running_key",
    "suspect_table", "token_estimate", "tokens",
]

# Ligatures of typeset text, dashes, and patterns of headings.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
DASHES = "[\\x{2010}-\\x{2015}\\x{2212}]"
KEYWORD_HEADING = "(?i)^(SECTION|PART|CHAPTER)\\s+([0-9]{1,3})\\.?(\\s+\\S.*)?$"
NUMBERED_HEADING = "^([0-9]{1,3}(\\.[0-9]{1,3})*)\\.?\\s+(\\S.*)$"
DATE_LINE = "(?i)^[0-9]{1,2}(st|nd|rd|th)?\\s+\\p{L}{3,9}\\.?,?\\s+[0-9]{4}$"
PAGE_REFERENCE = "(?<![0-9.,])[0-9]{1,3}(-[0-9]{1,3})?$"
MARGIN = 0.12
# How an excerpt begins and ends, and what stands for one shown before.
EXCERPT_BEGIN = ('<tariff_excerpt chunk_id="', '" section="', '" page="')
EXCERPT_END = "</tariff_excerpt>"
SHOWN_ABOVE = "(shown above)"


def casefold(text: Column) -> Column:
    """Lower case with ligatures spelt out and ß as ss."""
    for mark, plain in {**LIGATURES, "ß": "ss"}.items():
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    """Case-folded runs of letters and digits, in order."""
    return F.regexp_extract_all(casefold(text), F.lit("[\\p{L}\\p{N}]+"), 0)


def normal_words(text: Column) -> Column:
    """The text's words between single spaces, with one at each end; <br> counts as a space."""
    plain = F.regexp_replace(text, "(?i)<br\\s*/?>", " ")
    return F.concat(F.lit(" "), F.array_join(tokens(plain), " "), F.lit(" "))


def quote_in(quote: Column, text: Column) -> Column:
    """Whether the quote's words stand in the text as whole words, in a row. A quote without words is in none."""
    q = normal_words(quote)
    return (q != "  ") & F.contains(normal_words(text), q)


def running_key(text: Column, in_margin: Column) -> Column:
    """What makes two lines the same running line: dashes alike, spaces collapsed, case folded, and in a margin no page number at its ends."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(casefold(text), DASHES, "-"), "\\s+", " "))
    return F.when(in_margin & ~plain.rlike("^[0-9]{1,4}$"), F.trim(F.regexp_replace(plain, "^[0-9]{1,4}\\s+|\\s+[0-9]{1,4}$", ""))).otherwise(plain)


def page_number(text: Column, in_margin: Column) -> Column:
    """The page number that a margin's line is or ends or begins with; null elsewhere."""
    plain = F.trim(text)
    found = F.coalesce(
        F.nullif(F.regexp_extract(plain, "^([0-9]{1,4})$", 1), F.lit("")),
        F.nullif(F.regexp_extract(plain, "\\s([0-9]{1,4})$", 1), F.lit("")),
        F.nullif(F.regexp_extract(plain, "^([0-9]{1,4})\\s", 1), F.lit("")),
    )
    return F.when(in_margin, found)


def leaders(text: Column) -> Column:
    """Dot leaders as one ellipsis between spaces, ligatures spelt out."""
    out = F.regexp_replace(text, "\\s*(?:\\.\\s?){3,}\\s*|\\s*\\x{2026}+\\s*", " … ")
    for mark, plain in LIGATURES.items():
        out = F.replace(out, F.lit(mark), F.lit(plain))
    return out


def heading_kind(text: Column, size: Column, bold: Column, body_size: Column) -> Column:
    """keyword, numbered, unnumbered, or null for a line that is no heading."""
    line = F.trim(text)
    out = F.contains(line, F.lit("…")) | (F.length(line) > 200) | ~line.rlike("\\p{L}") | line.rlike(DATE_LINE)
    set_off = (size >= body_size - 0.1) & (bold | (size >= body_size + 0.5))
    numbered = line.rlike(NUMBERED_HEADING) & F.regexp_extract(line, NUMBERED_HEADING, 3).rlike("\\p{L}")
    alone = bold & (size >= body_size + 1.5) & (F.length(line) <= 120) & ~line.endswith(":")
    return F.when(out | ~set_off, None).when(line.rlike(KEYWORD_HEADING), "keyword").when(numbered, "numbered").when(alone, "unnumbered")


def join_lines(lines: Column) -> Column:
    """Trimmed lines joined by newlines, words that a hyphen splits mended where the next line begins in lower case."""
    return F.regexp_replace(F.array_join(F.transform(lines, lambda x: F.trim(x)), "\n"), "(\\p{L})-\\n(?=\\p{Ll})", "$1")


def suspect_table(markdown: Column) -> Column:
    """Whether a markdown table's rows differ in width, have one column, or leave over half the cells empty; separator rows don't count."""
    rows = F.filter(F.split(markdown, "\n"), lambda r: (F.trim(r) != "") & ~F.trim(r).rlike("^\\|?[\\s:|-]*-[\\s:|-]*$"))
    cells = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(F.trim(r), "^\\||\\|$", ""), "\\|"), lambda x: F.trim(x)))
    widths = F.array_distinct(F.transform(cells, lambda x: F.size(x)))
    flat = F.flatten(cells)
    empty = F.size(F.filter(flat, lambda c: c == ""))
    return (F.size(rows) == 0) | (F.size(widths) > 1) | (F.get(widths, F.lit(0)) <= 1) | (empty * 2 > F.size(flat))


def chunk_content(path: Column, body: Column) -> Column:
    """A chunk as it is searched: its section's breadcrumb, a blank line, the body."""
    return F.concat(path, F.lit("\n\n"), body)


def body_of(content: Column) -> Column:
    """The chunk without its breadcrumb."""
    at = F.locate("\n\n", content)
    return F.when(at > 0, F.substring(content, at + 2, F.length(content))).otherwise(content)


def token_estimate(content: Column) -> Column:
    return F.ceil(F.length(content) / 4).cast("int")


def excerpt(chunk_id: Column, section_ref: Column, page: Column, printed_page: Column, text: Column) -> Column:
    """A chunk as it is shown: a tag with its place, and the text."""
    printed = F.when(F.coalesce(printed_page, F.lit("")) != "", F.concat(F.lit(' printed_page="'), printed_page, F.lit('"'))).otherwise("")
    return F.concat(_excerpt_tag(chunk_id, section_ref, page), printed, F.lit(">\n"), text, F.lit("\n"), F.lit(EXCERPT_END))


def excerpt_again(chunk_id: Column, section_ref: Column, page: Column) -> Column:
    """What stands for a chunk that was shown before."""
    return F.concat(_excerpt_tag(chunk_id, section_ref, page), F.lit(">"), F.lit(SHOWN_ABOVE), F.lit(EXCERPT_END))


def _excerpt_tag(chunk_id: Column, section_ref: Column, page: Column) -> Column:
    tag, section, at = map(F.lit, EXCERPT_BEGIN)
    return F.concat(tag, chunk_id.cast("string"), section, section_ref, at, page.cast("string"), F.lit('"'))


def outline_line(level: Column, ref: Column, title: Column, opening: Column) -> Column:
    """A section in an outline: indented by level, with the first 300 characters of its text."""
    text = F.trim(F.regexp_replace(opening, "\\s+", " "))
    head = F.concat(F.repeat(F.lit("  "), level - 1), F.lit("["), ref, F.lit("] "), title)
    return F.when(text != "", F.concat(head, F.lit(": "), F.substring(text, 1, 300))).otherwise(head)

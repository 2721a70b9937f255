"""Cleaning of extracted text and markup as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Blanks inside a line, by code point: the same class in every dialect.
INLINE = r"[\t\x0b\x0c\r \x1c-\x1f\x85\p{Z}]+"
#: Closing tags that end a line or leave a blank.
LINE_TAGS = r"(?i)</(w:p|a:p|text:p|p|div|li|tr)\b[^>]*>"
BLANK_TAGS = r"(?i)</(w:tab|br|td|si)\b[^>]*>"
# The entities of XML.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def clean(text: Column, limit: int = 1000) -> Column:
    """Runs of blanks as one, at most one empty line, no blanks around lines, cut to ``limit`` characters."""
    spaced = F.regexp_replace(F.regexp_replace(text, INLINE, " "), r"\n{3,}", "\n\n")
    return F.substring(F.regexp_replace(F.regexp_replace(spaced, " ?\n ?", "\n"), r"^[ \n]+|[ \n]+$", ""), 1, limit)


def without_markup(xml: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(xml, BLANK_TAGS, " "), LINE_TAGS, "\n"), r"<[^>]+>", "")
    for entity, char in ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return plain


def html_text(html: Column, limit: int = 1000) -> Column:
    """Text of a page without scripts and styles."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return clean(without_markup(body), limit)


def printable_runs(text: Column, limit: int = 1000) -> Column:
    """Runs of at least six printable ASCII characters, what can be saved of an old binary document."""
    return clean(F.array_join(F.regexp_extract_all(text, F.lit(r"[\x20-\x7e]{6,}"), F.lit(0)), " "), limit)

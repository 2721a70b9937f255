"""Words of names and texts as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that mark a revision, words that say nothing, months.
REVISION = "final finalfinal draft copy copia kopie backup bak old new latest current version ver rev revised revision updated update edited fixed temp tmp duplicate dup real actual use please".split()
GENERIC = (
    "untitled unnamed document doc file scan scanned img image pic picture photo screenshot screen shot capture dsc dscn pxl mvimg vid download downloaded received "
    "export exported output test misc stuff things various other asset item edit fix the and for with from this that pdf docx "
    "at in on of to by is it as an or my a we us be do no so up"
).split()
MONTHS = "jan feb mar apr may jun jul aug sep sept oct nov dec january february march april june july august september october november december".split()
NOISE = REVISION + GENERIC

#: Letters and digits in one dialect for Java, RE2 and Python's own notion of a word character.
SEPARATOR = r"[^\p{L}\p{N}]+"
VERSIONED = r"^([\p{L}\p{Nl}\p{No}]+?)v?(\p{Nd}+)$"
DIGITS = r"^\p{Nd}+$"
HEX = r"^[0-9a-f]{8,}$"
NUMBERED = r"^v\p{Nd}+$"
COPY_NUMBER = r"\(\s*\d+\s*\)\s*$"


def split_words(raw: Column) -> Column:
    """Lower-case words of an identifier: camel case and anything but letters and digits divide."""
    spaced = F.regexp_replace(F.regexp_replace(raw, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z])([A-Z][a-z]{2,})", "$1 $2")
    return F.filter(F.transform(F.split(spaced, SEPARATOR), F.lower), lambda w: w != "")


def unversioned(word: Column) -> Column:
    """final2, finalv2: final, where the bare word marks a revision."""
    bare = F.regexp_extract(word, VERSIONED, 1)
    return F.when(bare.isin(REVISION), bare).otherwise(word)


def name_tokens(stem: Column, drop_noise: bool = True) -> Column:
    def keep(w: Column) -> Column:
        good = (F.length(w) >= 2) & ~w.rlike(DIGITS) & ~w.rlike(HEX) & ~w.rlike(NUMBERED) & ~w.isin(MONTHS)
        return good & ~w.isin(NOISE) if drop_noise else good

    return F.filter(F.transform(split_words(stem), unversioned), keep)


def name_phrase(stem: Column) -> Column:
    return F.array_join(name_tokens(stem), " ")


def content_tokens(text: Column, limit: int = 400) -> Column:
    return F.slice(F.filter(split_words(text), lambda w: (F.length(w) >= 3) & ~w.rlike(DIGITS) & ~w.isin(NOISE)), 1, limit)


def version_markers(stem: Column) -> Column:
    words = split_words(stem)
    marked = F.filter(words, lambda w: unversioned(w).isin(REVISION))
    suffix = F.exists(words, lambda w: w.rlike(NUMBERED)) | stem.rlike(COPY_NUMBER)
    return F.when(suffix, F.concat(marked, F.array(F.lit("version-suffix")))).otherwise(marked)


def base_stem(stem: Column) -> Column:
    """The words that remain without revisions, noise and numbers."""
    return F.array_join(F.filter(F.transform(split_words(stem), unversioned), lambda w: ~w.isin(NOISE) & ~w.rlike(DIGITS) & ~w.rlike(NUMBERED)), " ")

"""Text columns: trimming, defaults and the clean-up chains. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.strip() and what JavaScript's trim() remove.
_SEPARATORS = (
    "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
PYTHON_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85" + _SEPARATORS
JAVASCRIPT_SPACE = "\t\n\x0b\x0c\r \ufeff" + _SEPARATORS
# The same sets as regular-expression classes.
PYTHON_SPACE_CLASS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
JAVASCRIPT_SPACE_CLASS = r"[\t-\r\x{FEFF}\p{Z}]"

UNTITLED = "Untitled"
UNCATEGORIZED = "Uncategorized"


def strip(c: Column) -> Column:
    """Drop Unicode white space at both ends."""
    return F.btrim(c, F.lit(PYTHON_SPACE))


def strip_js(c: Column) -> Column:
    return F.btrim(c, F.lit(JAVASCRIPT_SPACE))


def has_text_sql(c: Column) -> Column:
    """Not null and not only U+0020. A lone tab counts as text here."""
    return c.isNotNull() & (F.trim(c) != "")


def has_text(c: Column) -> Column:
    """Not null and not only Unicode white space."""
    return c.isNotNull() & (strip(c) != "")


def clean_or(c: Column, fallback: str | None = None) -> Column:
    """Stripped text, or the fallback where there is none."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(fallback).cast("string"))


def description_or_title(description: Column, title: Column) -> Column:
    """The description, else the raw title (before any title default)."""
    return F.coalesce(clean_or(description), clean_or(title))


def _replace_all(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, replacement in steps:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def clean_description(c: Column) -> Column:
    """Drop shop boilerplate, outer quotes and brackets, and quote joints of a printed list."""
    space = PYTHON_SPACE_CLASS
    # The phrases that are dropped.
    without_phrases = _replace_all(
        c,
        (r"(?U)\bProduct Description\b", ""),
        (r"(?iU)Amazon\.com\b", ""),
        (r"(?U)\bFrom the Manufacturer\b", ""),
    )
    bare = F.btrim(strip(without_phrases), F.lit("'\"[]"))
    joined = _replace_all(bare, (f"{space}+", " "), (f"'{space}*'", " "), ("'([A-Z])", " $1"))
    return F.coalesce(joined, F.lit(""))


def squash(c: Column) -> Column:
    """Every run of white space becomes one space; lone spaces are left as they are."""
    return F.regexp_replace(c, f"{PYTHON_SPACE_CLASS}{{2,}}|[{PYTHON_SPACE_CLASS}&&[^ ]]", " ")


def spaced_tokens(c: Column) -> Column:
    """Text whose tokens are separated by exactly one space, punctuation standing alone.

    The rules: clause marks before a non-digit, dot runs, symbols, brackets and double dashes stand
    alone; the full stop that ends a sentence leaves its word; six fused verbs are split.
    """
    padded = _replace_all(
        squash(c),
        (r"([:,])([^0-9])", " $1 $2"),
        (r"([:,])\z", " $1 "),
        (r"(\.{2,}|--|[;@#$%&?!()<>])", " $1 "),
        (r"([^. ])\.( |\z)", "$1 . "),
        (r"(?i)\b(can(?=not\b)|(?:gim|lem)(?=me\b)|(?:gon|wan)(?=na\b)|got(?=ta\b))", "$1 "),
        (r" {2,}", " "),
    )
    return F.trim(padded)


def word_tokens(c: Column) -> Column:
    spaced = spaced_tokens(c)
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def clean_text(c: Column) -> Column:
    """Brackets, quotes and written-out ``\\n \\r \\t`` go; tokens end up one space apart."""
    # The signs and written-out breaks that go.
    bare = _replace_all(c, (r"[\[\]{}'\"]", " "), (r"\\[nrt]", " "))
    return F.coalesce(spaced_tokens(bare), F.lit(""))


def clean_display_text(c: Column) -> Column:
    """What a product page shows for a printed list of strings."""
    space = JAVASCRIPT_SPACE_CLASS
    # What the page's clean-up replaces, in its order.
    shown = _replace_all(
        c,
        (r"[\[\]]", ""),
        (f"'([^']*?)'{space}*'", "$1 "),
        (f"'{space}*'", " "),
        (r"^'|'\z", ""),
        (f"{space}+", " "),
    )
    return F.coalesce(strip_js(shown), F.lit(""))


def snippet(c: Column, length: int = 300) -> Column:
    """The first ``length`` characters: a preview for display."""
    return F.substring(c, 1, length)


def sentences(c: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space; no empty items."""
    marked = F.regexp_replace(F.trim(squash(c)), r"([.!?]) ", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")

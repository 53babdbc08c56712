"""Regular-expression dialects as native Columns.

Two dialects occur in the rules.  The response checks use Unicode word classes; the
stop-time and capture rules use ASCII ones.  Both let ``.`` stop at ``\\n`` only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JDK 17 gives \b Unicode semantics even where \w is ASCII, so the ASCII dialect
# spells the boundary out.
_ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def unicode_regex(pattern: str, ignore_case: bool = True) -> str:
    return ("(?iUd)" if ignore_case else "(?Ud)") + pattern


def ascii_regex(pattern: str, ignore_case: bool = True) -> str:
    return ("(?id)" if ignore_case else "(?d)") + pattern.replace(r"\b", _ASCII_BOUNDARY)


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Unicode-dialect search."""
    return text.rlike(unicode_regex(pattern, ignore_case))


def matches_ascii(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """ASCII-dialect search."""
    return text.rlike(ascii_regex(pattern, ignore_case))


def count_matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.regexp_count(text, F.lit(unicode_regex(pattern, ignore_case)))


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def contains_any(text: Column, words: list[str]) -> Column:
    """True when any word occurs literally; an empty list never matches."""
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def column_contains_any(name: str, words: list[str]) -> Column:
    """``contains_any`` over a named column, built from one expression text."""
    quoted = ['"' + w.replace("\\", "\\\\").replace('"', '\\"') + '"' for w in words]
    return F.expr(" OR ".join(f"contains({name}, {q})" for q in quoted))


def any_regex(patterns: list[str]) -> str:
    """One expression that matches where any of the patterns does."""
    return "|".join(f"(?:{p})" for p in patterns)


# Letters that case-insensitive matching equates with ASCII ones but lower() does not.
_FOLD_FROM, _FOLD_TO = "\u0130\u0131\u017f\u212a", "iisk"


def folded(text: Column) -> Column:
    """Lower-case text in which every case-insensitive match shows up literally."""
    special = F.lit(False)
    for letter in _FOLD_FROM:
        special = special | text.contains(letter)
    return F.lower(F.when(special, F.translate(text, _FOLD_FROM, _FOLD_TO)).otherwise(text))

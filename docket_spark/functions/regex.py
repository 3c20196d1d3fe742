"""One place for the regex dialect: patterns written for Unicode-aware matching with '\\n' as the only line end."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dialect(pattern: str, ignore_case: bool = False, dotall: bool = False, first: str | None = None) -> str:
    """``first``: a pattern that holds wherever a match begins; other places are passed over without trying the rest."""
    return f"(?{'i' * ignore_case}{'s' * dotall}Ud)" + (f"(?={first})(?:{pattern})" if first else pattern)


def matches(text: Column, pattern: str, ignore_case: bool = False, dotall: bool = False) -> Column:
    """Null texts do not match."""
    return F.coalesce(text.rlike(dialect(pattern, ignore_case, dotall)), F.lit(False))


def count_matches(text: Column, pattern: str, ignore_case: bool = False, first: str | None = None) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(dialect(pattern, ignore_case, first=first))), F.lit(0))


def captures(text: Column, pattern: str, groups: int, ignore_case: bool = False, first: str | None = None, inner: str | None = None) -> Column:
    """All non-empty captures of groups 1 to ``groups``, as one array.

    Each group takes a pass over the text.  Where a pattern ``inner`` finds in a match just what its groups hold, one pass
    for the matches serves all groups.
    """
    written = F.lit(dialect(pattern, ignore_case, first=first))
    if inner:
        found = F.flatten(F.transform(F.regexp_extract_all(text, written, F.lit(0)), lambda m: F.regexp_extract_all(m, F.lit(dialect(inner)), F.lit(0))))
    else:
        found = F.concat(*(F.regexp_extract_all(text, written, F.lit(g)) for g in range(1, groups + 1)))
    return F.coalesce(F.filter(found, lambda x: x != ""), F.array().cast("array<string>"))


def distinct_captures(text: Column, pattern: str, groups: int = 1, ignore_case: bool = False, first: str | None = None, inner: str | None = None) -> Column:
    return F.size(F.array_distinct(captures(text, pattern, groups, ignore_case, first, inner)))

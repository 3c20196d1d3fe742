"""Null-safe scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MISSING = "__missing__"


def normal_name(c: Column) -> Column:
    """Lower case; every run of other characters than a-z and 0-9 is one blank; trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def normal_doctype(c: Column) -> Column:
    """Lower case with blanks collapsed."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def has_prefix(c: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.coalesce(c.startswith(p), F.lit(False))
    return out


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty; '' if there is none."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def text_id(c: Column) -> Column:
    return c.cast("string")


def leading_number(c: Column, n: int = 3) -> Column:
    """The first n characters as a number, or null."""
    return F.substring(c, 1, n).try_cast("double")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def missing_flag(c: Column) -> Column:
    return c.isNull().cast("int")


def mapped(c: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    """Look-up in a small fixed map."""
    if not mapping:
        return F.lit(default)
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), c)
    return found if default is None else F.coalesce(found, F.lit(default))


def composite_key(*columns: Column) -> Column:
    return F.struct(*(F.coalesce(c.cast("string"), F.lit(MISSING)).alias(f"k{i}") for i, c in enumerate(columns)))


def year_bucket(c: Column, unknown: str = "unknown") -> Column:
    return F.coalesce(F.nullif(F.substring(c, 1, 4), F.lit("")), F.lit(unknown))


def lenient_date(c: Column, fmt: str | None = None) -> Column:
    """Text or timestamp to date; what is no date becomes null."""
    return F.try_to_date(c.cast("string"), fmt) if fmt else F.try_to_date(F.substring(c.cast("string"), 1, 10))


def yes_no(c: Column) -> Column:
    up = F.upper(F.trim(c))
    return F.when(up == "Y", True).when(up == "N", False)


def as_list(c: Column) -> Column:
    return F.coalesce(c, F.array())


def head_of(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def tail_of(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def enough(hits: list[Column], least: int) -> Column:
    """1 if the largest of the counts reaches ``least``."""
    return (F.greatest(*hits, F.lit(0)) >= least).cast("int")

"""Point-in-time aggregates inside arrays: no explode, no shuffle.

Every predicate is null-safe.  A null query date gives counts of 0, null scalars and flags of 1.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.scalars import as_list, has_prefix, mapped, normal_name


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def zipped(*arrays: Column, names: list[str]) -> Column:
    """Index-aligned structs, cut to the shortest array; a null array counts as empty."""
    filled = [F.coalesce(a, F.array()) for a in arrays]
    n = F.least(*(F.size(a) for a in filled)) if len(filled) > 1 else F.size(filled[0])
    cut = [F.slice(a, F.lit(1), n).alias(k) for a, k in zip(filled, names)]
    return F.transform(F.arrays_zip(*cut), lambda z: F.struct(*(z[k].alias(k) for k in names)))


def events_before(codes: Column, dates: Column, t0: Column, categories: dict[str, str], banned: list[str], banned_prefixes: list[str], other: str = "OTHER") -> Column:
    """array<struct<category, date>> of the events strictly before t0 that are not banned."""
    pairs = zipped(codes, dates, names=["code", "date"])
    usable = F.filter(pairs, lambda e: _sure(e["date"] < t0) & _sure(F.trim(e["code"]) != "") & ~has_prefix(e["code"], banned_prefixes))
    named = F.transform(usable, lambda e: F.struct(mapped(e["code"], categories, other).alias("category"), e["date"].alias("date")))
    return F.filter(named, lambda e: ~e["category"].isin(banned)) if banned else named


def count_category(events: Column, category: str) -> Column:
    return F.size(F.filter(events, lambda e: e["category"] == category))


def span_days(dates: Column) -> Column:
    """Days from the first to the last date; null for fewer than two."""
    return F.when(F.size(dates) >= 2, F.datediff(F.array_max(dates), F.array_min(dates)))


def assignments_before(received: Column, recorded: Column, names: Column, t0: Column) -> Column:
    """array<struct<date, names>> of the assignments with a date before t0; the date is the least such one."""
    rows = zipped(received, recorded, names, names=["received", "recorded", "names"])
    dated = F.transform(rows, lambda a: F.struct(F.array_min(F.filter(F.array(a["received"], a["recorded"]), lambda d: _sure(d < t0))).alias("date"), a["names"].alias("names")))
    return F.filter(dated, lambda a: a["date"].isNotNull())


def distinct_names(names_of_rows: Column) -> Column:
    """Distinct normalised names over an array of arrays of names."""
    normal = F.transform(F.flatten(F.transform(names_of_rows, as_list)), normal_name)
    return F.size(F.array_distinct(F.filter(normal, lambda x: _sure(x != ""))))


def recency_days(dates: Column, t0: Column) -> Column:
    """Days from the last date to t0, null if there is none."""
    return F.datediff(t0, F.array_max(dates))


def none_flag(a: Column) -> Column:
    return (F.coalesce(F.size(a), F.lit(0)) == 0).cast("int")


def length_of(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0))


def distinct_prefixes(a: Column, n: int = 4) -> Column:
    return F.size(F.array_distinct(F.transform(F.filter(as_list(a), lambda x: x.isNotNull()), lambda x: F.substring(x, 1, n))))


def first_initial(a: Column) -> Column:
    """Upper-case first letter of the first element that begins with a letter."""
    return F.upper(F.substring(F.try_element_at(F.filter(as_list(a), lambda x: _sure(x.rlike(r"^\p{L}"))), F.lit(1)), 1, 1))


def all_equal_bucket(a: Column, value: str, all_name: str, other_name: str) -> Column:
    """Null for none, ``all_name`` if all elements are ``value``, else ``other_name``."""
    return F.when(F.size(as_list(a)) == 0, None).when(F.forall(as_list(a), lambda x: _sure(x == value)), all_name).otherwise(other_name)

"""One row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.regex import matches
from ..functions.scalars import first_filled, normal_doctype, year_bucket


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key.  The order must be total, so end it with an id; nulls last is up to the caller."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def earliest_per_key(df: DataFrame, key: str, date: str, tie: str) -> DataFrame:
    """One hash aggregate instead of a sort: the row with the least (date, tie); rows without a date come last."""
    rank = F.struct(F.col(date).isNull(), F.col(date), F.col(tie))
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), rank).alias("row")).select("row.*")


def pick_by_cascade(df: DataFrame, key: str, number: str, title: str, name: str, category: str, tie: str, include: str, exclude: str, skipped: list[str], ceiling: int = 10) -> DataFrame:
    """The row with the lowest number of each key among those that pass the filters; keys without one are left out.

    Filters: category not in ``skipped``; number below ``ceiling`` (null and 0 count as 9999); the title (or, if empty,
    the name) matches ``include`` and not ``exclude``.
    """
    paper = F.coalesce(F.nullif(F.col(number).cast("bigint"), F.lit(0)), F.lit(9999))
    shown = first_filled(F.col(title), F.col(name))
    kept = df.where(~F.coalesce(F.col(category), F.lit("")).isin(skipped) & (paper < ceiling) & matches(shown, include, True) & ~matches(shown, exclude, True))
    return first_per_key(kept, [key], [paper, F.col(tie)])


def of_doctype(df: DataFrame, column: str, types: list[str]) -> DataFrame:
    """Rows whose document type, with case and blanks evened out, is one of ``types``."""
    wanted = [" ".join(t.lower().split()) for t in types]
    return df.where(F.coalesce(normal_doctype(F.col(column)).isin(wanted), F.lit(False)))


def without_markers(df: DataFrame, title: str, markers: list[str], only_if: Column | None = None) -> DataFrame:
    """Drops rows whose title holds any marker (case ignored), where ``only_if`` holds."""
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(F.lower(F.coalesce(F.col(title), F.lit(""))), F.lit(m.lower()))
    return df.where(~(found & (F.lit(True) if only_if is None else F.coalesce(only_if, F.lit(False)))))


def terminating_rows(df: DataFrame, key: str, doctype: str, title: str, date: str, tie: str, types: list[str], legacy: str, markers: list[str], columns: dict[str, str]) -> DataFrame:
    """The earliest row of the wanted types per key, amendments of the legacy type left out; ``columns`` renames.

    Columns that are missing come as null.
    """
    for c in columns:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    kept = without_markers(of_doctype(df, doctype, types), title, markers, normal_doctype(F.col(doctype)) == " ".join(legacy.lower().split()))
    return earliest_per_key(kept, key, date, tie).select(key, *(F.col(c).alias(n) for c, n in columns.items()))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct non-blank keys, trimmed."""
    return df.select(F.trim(F.col(key).cast("string")).alias(key)).where(f"`{key}` <> ''").distinct()


def work_list(df: DataFrame, key: str, most: int) -> DataFrame:
    return df.orderBy(key).limit(most)


def candidates(df: DataFrame, doctype: str, phrase: str, uri: str, key: str, date: str) -> DataFrame:
    """Rows whose type holds the phrase (case ignored) and that have a uri and a key, with the year of their date."""
    kept = df.where(F.contains(F.lower(doctype), F.lit(phrase.lower())) & F.col(uri).isNotNull() & F.col(key).isNotNull())
    return kept.withColumn("year", year_bucket(F.col(date).cast("string")))

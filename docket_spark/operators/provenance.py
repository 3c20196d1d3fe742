"""Do features know what happened later?  All facts of the query date or after it are changed; no feature may change.

Which facts are later is told by their own dates, not by column names, so a feature that reads an early column in a wrong
way (all events in place of the earlier ones, a last date, a length) is found as well as one that reads an outcome.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T


@dataclass(frozen=True)
class Facts:
    """Where the dated facts of a row are.

    ``bags``: parallel arrays, (date arrays, arrays that the dates are of); an element is earlier if one of its dates lies
    before the query date.  ``outcomes``: columns that are only known later.
    """

    bags: list[tuple[list[str], list[str]]] = field(default_factory=list)
    outcomes: list[str] = field(default_factory=list)


def _changed(value: Column, kind: T.DataType, salt: Column) -> Column:
    """Another value of the type, by hash; a value where there was none."""
    n = F.pmod(F.xxhash64(value.cast("string") if not isinstance(kind, (T.ArrayType, T.StructType)) else F.to_json(value), salt), F.lit(997)) + 1
    if isinstance(kind, T.StringType):
        return F.concat(F.lit("later "), n.cast("string"))
    if isinstance(kind, T.DateType):
        return F.date_add(F.coalesce(value, F.lit("2100-01-01").cast("date")), n.cast("int"))
    if isinstance(kind, T.TimestampType):
        return F.coalesce(value, F.lit("2100-01-01").cast("timestamp")) + F.make_dt_interval(n.cast("int"))
    if isinstance(kind, T.BooleanType):
        return ~F.coalesce(value, F.lit(False))
    if isinstance(kind, T.NumericType):
        return (F.coalesce(value, F.lit(0).cast(kind)) + n).cast(kind)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.array(F.concat(F.lit("later "), n.cast("string")))
    raise TypeError(f"no other value of type {kind.simpleString()}")


def _bag(column: str, kind: T.DataType, dates: list[str], t0: str, is_date: bool, aligned: Column) -> Column:
    """The array with its later elements changed, and where the bag's arrays are aligned one more; null stays null."""

    def element(x, i):
        before = F.exists(F.array(*(F.get(d, i) for d in dates)), lambda d: F.coalesce(d < F.col(t0), F.lit(False)))
        return F.when(before, x).otherwise(_changed(x, kind, i))

    more = F.date_add(F.coalesce(F.col(t0), F.lit("2100-01-01").cast("date")), 1).cast(kind) if is_date else _changed(F.lit(None).cast(kind), kind, F.lit(-1))
    changed = F.transform(column, element)
    return F.when(aligned, F.concat(changed, F.array(more))).otherwise(changed)


def with_other_future(df: DataFrame, t0: str, facts: Facts) -> DataFrame:
    """The rows with all later facts changed, and one more later element in each bag.

    Elements without a date count as later.  Rows without a query date have later facts only.
    """
    new, was = {}, lambda c: f"__was_{c}"
    for dates, others in facts.bags:
        columns = [*dates, *others]
        aligned = F.coalesce(F.forall(F.array(*(F.size(was(c)) for c in columns)), lambda n: n == F.size(was(columns[0]))), F.lit(False))
        for c in columns:
            new[c] = _bag(was(c), df.schema[c].dataType.elementType, [was(c)] if c in dates else [was(d) for d in dates], t0, c in dates, aligned)
    for c in facts.outcomes:
        new[c] = _changed(F.col(was(c)), df.schema[c].dataType, F.lit(c))
    # within lambdas a name may mean a changed column that stands before; the old ones have names of their own
    return df.withColumns({was(c): F.col(c) for c in new}).withColumns(new).drop(*map(was, new))


def without_facts(df: DataFrame, stage: Callable[[DataFrame], DataFrame], facts: Facts) -> DataFrame:
    """``stage``, a part of a build, run on rows whose dated facts and outcomes have no names there.

    What it makes cannot change with the future, so it may be made once, stored, and shared by all builds that are checked.
    """
    names = list(dict.fromkeys([c for dates, others in facts.bags for c in [*dates, *others]] + facts.outcomes))
    out = stage(df.select(*(c for c in df.columns if c not in names), F.struct(*names).alias("__facts")))
    if "__facts" not in out.columns:
        raise ValueError("the stage has dropped the facts")
    made = [c for c in out.columns if c != "__facts" and c not in df.columns]
    kept = [c for c in df.columns if c in names or c in out.columns]  # in their order
    return out.select(*(F.col("__facts")[c].alias(c) if c in names else F.col(c) for c in kept), *made)


def leaks(df: DataFrame, build: Callable[[DataFrame], DataFrame], key: str, t0: str, facts: Facts) -> DataFrame:
    """(key, columns): rows whose features change with the future, and which do; a row that comes or goes has all columns.

    ``build`` makes features of rows with a unique ``key``; it must give the same for the same rows.
    """
    a, b = build(df), build(with_other_future(df, t0, facts))
    names = [c for c in a.columns if c != key]
    left = a.select(F.col(key).alias("__key"), F.struct(*names).alias("__a"))
    right = b.select(F.col(key).alias("__key"), F.struct(*names).alias("__b"))
    both = left.join(right, "__key", "full_outer")
    whole = F.col("__a").isNull() | F.col("__b").isNull()
    differing = F.array_compact(F.array(*(F.when(whole | ~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")), F.lit(c)) for c in names)))
    return both.select(F.col("__key").alias(key), differing.alias("columns")).where(F.size("columns") > 0)

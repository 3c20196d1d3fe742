"""Holdout splits and forward-walking folds by date."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import Column, DataFrame, Window, functions as F


def mature(df: DataFrame, date: str, today: str, days: int) -> DataFrame:
    """Rows at least ``days`` old; null dates go; days of 0 or less keep all."""
    return df if days <= 0 else df.where(F.col(date) <= F.date_sub(F.lit(today).cast("date"), days))


def time_split(df: DataFrame, date: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(rows before the cutoff, the rest); null dates are in the rest."""
    early = F.coalesce(F.col(date) < F.lit(cutoff).cast("date"), F.lit(False))
    return df.where(early), df.where(~early)


def fold_dates(df: DataFrame, date: str, n: int) -> list[tuple[Date, Date]]:
    """(last training day, last test day) of each fold.

    Rows in order of date fall into n + 1 equal parts (the first takes the remainder); a cut moves forward to the end of
    its day, and folds without test rows are left out.  Only the counts by day are sorted, and 2n dates come back.
    """
    if df.where(F.col(date).isNull()).limit(1).count():
        raise ValueError("folds need a date in every row")
    by_day = df.groupBy(F.to_date(date).alias("day")).agg(F.count("*").alias("n"))
    upto = by_day.withColumn("upto", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    total = by_day.agg(F.sum("n")).first()[0] or 0
    size = total // (n + 1)
    if not size:
        raise ValueError("fewer rows than folds")
    ends = [total - (n - k) * size for k in range(n + 1)]
    cuts = upto.agg(*(F.min(F.when(F.col("upto") >= e, F.col("day"))).alias(f"c{i}") for i, e in enumerate(ends))).first()
    return [(cuts[k], cuts[k + 1]) for k in range(n) if cuts[k] < cuts[k + 1]]


def fold(df: DataFrame, date: str, bounds: tuple[Date, Date]) -> tuple[DataFrame, DataFrame]:
    day = F.to_date(date)
    return df.where(day <= F.lit(bounds[0])), df.where((day > F.lit(bounds[0])) & (day <= F.lit(bounds[1])))


def fold_table(df: DataFrame, date: str, n: int) -> DataFrame:
    """fold, train_end, test_end, n_train, n_test."""
    folds = fold_dates(df, date, n)
    day = F.to_date(date)
    sums: list[Column] = []
    for k, (a, b) in enumerate(folds):
        sums += [F.count_if(day <= F.lit(a)).alias(f"a{k}"), F.count_if((day > F.lit(a)) & (day <= F.lit(b))).alias(f"b{k}")]
    row = df.agg(*sums)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("fold"), F.lit(a).alias("train_end"), F.lit(b).alias("test_end"), F.col(f"a{k}").alias("n_train"), F.col(f"b{k}").alias("n_test")) for k, (a, b) in enumerate(folds))))
    return row.select(each.alias("x")).select("x.*")

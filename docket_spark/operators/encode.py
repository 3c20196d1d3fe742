"""Encoders fitted on the training rows only."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.scalars import MISSING


#: More levels than that are no category: each would be a column.
MOST_LEVELS = 10_000


def one_hot_levels(df: DataFrame, column: str) -> list[str]:
    """Frozen levels in order of name; null is a level of its own.  More than MOST_LEVELS are an error."""
    found = [r[0] for r in df.select(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("v")).distinct().limit(MOST_LEVELS + 1).collect()]
    if len(found) > MOST_LEVELS:
        raise ValueError(f"{column} has more than {MOST_LEVELS} levels")
    return sorted(found)


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """0/1 columns <column>_<level>; a level that was not seen gives zeros only."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    return df.withColumns({f"{column}_{v}": (value == v).cast("int") for v in levels})


def one_hot_stages(columns: list[str]) -> list:
    """The same as pyspark.ml stages over columns filled by fill_categories()."""
    index = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep", stringOrderType="alphabetAsc") for c in columns]
    return [*index, OneHotEncoder(inputCols=[f"{c}__i" for c in columns], outputCols=[f"{c}__v" for c in columns], dropLast=True)] if columns else []


def fill_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns})


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact interpolated medians; columns without a value are left out (and dropped by impute)."""
    row = df.agg(*(F.median(F.col(c).cast("double")).alias(c) for c in columns)).first()
    return {c: float(row[c]) for c in columns if row[c] is not None}


def impute(df: DataFrame, found: dict[str, float], columns: list[str]) -> DataFrame:
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in found.items()})
    return df.drop(*[c for c in columns if c not in found])


def numeric_columns(df: DataFrame, without: list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in without]


def class_weights(df: DataFrame, label: str) -> dict[int, float]:
    """n / (classes * n of the class)."""
    n = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("int")).count().collect()}
    total = sum(n.values())
    return {k: total / (len(n) * v) for k, v in sorted(n.items())}


def weighted(df: DataFrame, label: str, weights: dict[int, float], name: str = "weight") -> DataFrame:
    out = F.lit(1.0)
    for k, v in weights.items():
        out = F.when(F.col(label).cast("int") == k, F.lit(v)).otherwise(out)
    return df.withColumn(name, out)


def preprocessor(categories: list[str], numbers: list[str]) -> Pipeline:
    return Pipeline(stages=[*one_hot_stages(categories), VectorAssembler(inputCols=[*(f"{c}__v" for c in categories), *numbers], outputCol="features", handleInvalid="error")])

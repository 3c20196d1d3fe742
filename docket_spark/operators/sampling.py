"""Stratified samples that are equal on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def stratified(df: DataFrame, strata: list[Column], key: str, n: int, seed: int = 0) -> DataFrame:
    """Round robin over the strata: the first of each, then the second, to n in all; within a stratum by a seeded hash."""
    stratum = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("unknown")) for c in strata))
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    drawn = df.withColumn("stratum", stratum).withColumn("__place", place)
    drawn = drawn.withColumn("turn", F.row_number().over(Window.partitionBy("stratum").orderBy("__place", key)))
    # No stratum gives more than n rows, so the sort for the limit sees that much of each.
    return drawn.where(F.col("turn") <= n).orderBy("turn", F.md5("stratum"), "stratum").limit(n).drop("__place")


def sample_report(df: DataFrame, text: str, least: int = 1000) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(text).isNotNull()).alias("n_ok"), F.count_if(F.coalesce(F.length(text) > least, F.lit(False))).alias("n_long"))

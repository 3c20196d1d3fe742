"""Layered resolution of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.regex import matches
from ..functions.scalars import head_of, lenient_date, tail_of

#: (name, pattern, label); the first that matches decides.
Rules = list[tuple[str, str, int]]


def by_rules(text: Column, rules: Rules, ignore_case: bool = True, dotall: bool = True) -> Column:
    out = None
    for _, pattern, label in rules:
        hit = matches(text, pattern, ignore_case, dotall)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out if out is not None else F.lit(None).cast("int")


def verdict(text: Column, head_rules: Rules, tail_rules: Rules, head: int = 4000, tail: int = 10000) -> Column:
    """The verdict of the head of a text, else that of its tail, else null."""
    return F.coalesce(by_rules(head_of(text, head), head_rules), by_rules(tail_of(text, tail), tail_rules))


def drop_statuses(df: DataFrame, status: str, statuses: list[str]) -> DataFrame:
    """Rows whose status is in the set go; a null status stays."""
    return df.where(~F.coalesce(F.col(status).isin(statuses), F.lit(False)))


def resolve(df: DataFrame, status: str, title: str, zero: list[str], one: list[str], pending: list[str], title_rule: tuple[str, int], texts: DataFrame, text_id: str, text: str, head_rules: Rules, tail_rules: Rules, label: str = "label", source: str = "label_source") -> DataFrame:
    """Labels rows by status, then title, then text; rows that no layer labels go.

    Only the rows that the first layers leave open are joined with the texts, and only the verdict comes back.
    """
    kept = drop_statuses(df, status, pending)
    by_status = F.when(F.col(status).isin(zero), 0).when(F.col(status).isin(one), 1)
    by_title = F.when(matches(F.coalesce(F.col(title), F.lit("")), title_rule[0], True), title_rule[1])
    early = kept.withColumn(label, F.coalesce(by_status, by_title)).withColumn(source, F.when(by_status.isNotNull(), "status").when(by_title.isNotNull(), "title"))
    open_ids = early.where(F.col(label).isNull() & F.col(text_id).isNotNull()).select(text_id).distinct()
    said = texts.select(text_id, text).join(open_ids, text_id, "left_semi").select(text_id, verdict(F.col(text), head_rules, tail_rules).alias("__said")).groupBy(text_id).agg(F.max("__said").alias("__said"))
    out = early.join(said, text_id, "left")
    return out.withColumn(source, F.coalesce(source, F.when(F.col("__said").isNotNull(), "text"))).withColumn(label, F.coalesce(label, "__said")).where(F.col(label).isNotNull()).select(*df.columns, F.col(label).cast("int").alias(label), source)


def resolution_date(*columns: Column) -> Column:
    return F.coalesce(*(lenient_date(c) for c in columns))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows judged by both, rows that agree, rows that neither judges."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.agg(F.count("*").alias("n"), F.count_if(both).alias("n_both"), F.count_if(both & (F.col(a) == F.col(b))).alias("n_agree"), F.count_if(F.col(a).isNull() & F.col(b).isNull()).alias("n_neither"))

"""Joins with audit, gap lists and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.scalars import lenient_date
from .select_one import first_per_key


def left_with_flag(left: DataFrame, right: DataFrame, on: str, flag: str) -> DataFrame:
    """Left join that says whether the right side was there, which its null columns cannot."""
    return left.join(right.withColumn(flag, F.lit(True)), on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def missing_keys(wanted: DataFrame, there: DataFrame, on: str, other: str | None = None) -> DataFrame:
    """Rows of ``wanted`` whose key is not in ``there``; null keys are missing always."""
    keys = there.select(F.col(other or on).alias("__key")).where("__key is not null").distinct()
    return wanted.join(keys, wanted[on] == keys["__key"], "left_anti")


def unmatched(left: DataFrame, right: DataFrame, on: str, other: str | None = None) -> DataFrame:
    """Distinct non-null keys of the left that the right lacks."""
    return missing_keys(left.select(on).where(F.col(on).isNotNull()).distinct(), right, on, other)


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with all the columns non-null, and non-blank where they are text."""
    out = df.na.drop(subset=columns)
    for c in columns:
        if dict(df.dtypes)[c] == "string":
            out = out.where(F.trim(c) != "")
    return out


def gap_list(decisions: DataFrame, trials: DataFrame, texts: DataFrame, key: str, required: list[str], unresolved: Column, tie: str, text_key: str) -> DataFrame:
    """Rows whose label needs a text that is absent.

    Rows lacking a required column go; trials are made unique by key; ``unresolved`` says (over columns of both) which
    rows no other layer can label; of these, the ones without a text stay.
    """
    one = first_per_key(trials, [key], [F.col(c) for c in trials.columns if c != key])
    joined = filled(decisions, required).join(one, key, "inner").where(F.coalesce(unresolved, F.lit(False)))
    return missing_keys(joined, texts, tie, text_key)


def date_mismatches(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two dates are both there and differ."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (lenient_date(F.col(a)) != lenient_date(F.col(b))))


def audited(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """One row of conditional counts, in one pass."""
    return df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()))


def join_all(labelled: DataFrame, petitions: DataFrame, patents: DataFrame, texts: DataFrame, key: str = "trial_number", patent_key: str = "application_number", filing: str = "petition_filing_date", petition_date: str = "petition_filing_date_doc", patent_number: str = "patent_number", text: str = "petition_text") -> tuple[DataFrame, DataFrame]:
    """(joined rows, one-row report).

    Rows without a filing date or patent number go; petitions are joined inner, patents and texts left, with flags that
    tell a match.  The report counts rows in, labelled rows with a petition, rows whose two filing dates differ, labelled
    rows without a petition, and rows out.
    """
    ready = labelled.na.drop(subset=[filing, patent_number])
    slim = petitions.select(F.col(key), F.col(petition_date), *[c for c in petitions.columns if c not in (key, petition_date, *labelled.columns)])
    joined = ready.join(slim, key, "inner")
    joined = joined.withColumn(patent_key, F.col(patent_key).cast("string"))
    if patents is not None:
        right = patents.withColumn(patent_key, F.col(patent_key).cast("string"))
        joined = left_with_flag(joined, right.drop(*[c for c in right.columns if c in joined.columns and c != patent_key]), patent_key, "wrapper_matched")
    if texts is not None:
        joined = joined.join(texts.select(key, text), key, "left")
    flags = labelled.select(key, (F.col(filing).isNotNull() & F.col(patent_number).isNotNull()).alias("ready")).join(slim.select(key, F.lit(True).alias("found")).distinct(), key, "left")
    report = audited(flags, {"n_labelled": F.lit(True), "n_ready": F.col("ready"), "n_without_petition": F.col("found").isNull()})
    dates = audited(joined, {"n_joined": F.lit(True), "n_date_mismatch": F.col(petition_date).isNotNull() & (F.col(petition_date) != F.col(filing))})
    return joined, report.crossJoin(dates)


#: What join_observed counts, by the step that counts it.
OBSERVED = {"labelled": ["n_labelled", "n_ready"], "petitions": ["n_without_petition"], "joined": ["n_joined", "n_date_mismatch", "n_wrapper_matched", "n_text"]}


def join_observed(labelled: DataFrame, petitions: DataFrame, patents: DataFrame, texts: DataFrame, key: str = "trial_number", patent_key: str = "application_number", filing: str = "petition_filing_date", petition_date: str = "petition_filing_date_doc", patent_number: str = "patent_number", text: str = "petition_text") -> tuple[DataFrame, dict[str, Observation]]:
    """(joined rows as join_all, observations): the counts come with whatever job makes the rows, without a second pass.

    After a write of the rows, report() gives the counts.  A query with two jobs over the rows counts in the first.
    """
    seen = {name: Observation(name) for name in OBSERVED}
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    is_ready = F.col(filing).isNotNull() & F.col(patent_number).isNotNull()
    start = labelled.observe(seen["labelled"], F.count(F.lit(1)).alias("n_labelled"), count(is_ready).alias("n_ready"))
    slim = petitions.select(F.col(key), F.col(petition_date), *[c for c in petitions.columns if c not in (key, petition_date, *labelled.columns)])
    with_petition = start.join(slim.withColumn("__found", F.lit(True)), key, "left")
    # a row without a petition is there once, whatever petitions repeat
    with_petition = with_petition.observe(seen["petitions"], count(F.col("__found").isNull()).alias("n_without_petition"))
    joined = with_petition.where(F.col("__found") & is_ready).drop("__found").withColumn(patent_key, F.col(patent_key).cast("string"))
    right = patents.withColumn(patent_key, F.col(patent_key).cast("string"))
    joined = left_with_flag(joined, right.drop(*[c for c in right.columns if c in joined.columns and c != patent_key]), patent_key, "wrapper_matched")
    joined = joined.join(texts.select(key, text), key, "left")
    differs = F.col(petition_date).isNotNull() & (F.col(petition_date) != F.col(filing))
    joined = joined.observe(seen["joined"], F.count(F.lit(1)).alias("n_joined"), count(differs).alias("n_date_mismatch"), count(F.col("wrapper_matched")).alias("n_wrapper_matched"), count(F.col(text).isNotNull()).alias("n_text"))
    return joined, seen


def report(seen: dict[str, Observation]) -> dict[str, int]:
    """The counts of join_observed, once its rows have been made."""
    return {k: int(v) for o in seen.values() for k, v in o.get.items()}


def features_with_labels(features: DataFrame, labelled: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Features of the labelled rows, with label and dates; one label row per key, the least of several."""
    one = first_per_key(labelled.select(key, *columns).where(F.col(key).isNotNull()), [key], [F.col(c) for c in columns])
    return features.drop(*[c for c in columns if c in features.columns]).join(one, key, "inner")


def pending(wanted: DataFrame, cached: DataFrame, key: str, shape: list[str]) -> DataFrame:
    """Distinct wanted keys that are not cached; cached rows that lack a column of their shape count as missing."""
    return missing_keys(wanted.select(key).where(F.col(key).isNotNull()).distinct(), filled(cached, shape), key)

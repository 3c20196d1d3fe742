"""The feature table of a trial, all as of its filing date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import days_between, leading_number, lenient_date, missing_flag
from . import arrays as A
from .text import text_features, usable


def era_of(date: Column, eras: dict[str, str]) -> Column:
    """The last era that began on or before the date; null before the first and for null dates."""
    out = F.lit(None).cast("string")
    for name, start in sorted(eras.items(), key=lambda x: x[1]):
        out = F.when(date >= F.lit(start).cast("date"), F.lit(name)).otherwise(out)
    return out


def with_era(df: DataFrame, date: str, eras: DataFrame, name: str = "era", start: str = "start") -> DataFrame:
    """era_of for a table of eras; of eras that begin on one day the last by name.

    The eras are laid between the distinct dates, so the window without a key sees dates, not rows.
    """
    out = name if name not in df.columns else f"{name}_found"
    began = eras.where(F.col(start).isNotNull()).select(F.col(start).cast("date").alias("__date"), F.struct(F.col(start).cast("date").alias("s"), F.col(name).alias("era")).alias("__began"))
    dates = df.select(F.col(date).cast("date").alias("__date")).where("__date is not null").distinct()
    both = began.unionByName(dates, allowMissingColumns=True).groupBy("__date").agg(F.max("__began").alias("__began"))
    known = both.select("__date", F.max("__began").over(Window.orderBy("__date").rangeBetween(Window.unboundedPreceding, 0))["era"].alias(out))
    return df.join(known, F.col(date).cast("date") == F.col("__date"), "left").drop("__date")


NEEDED = ["trial_number", "petition_filing_date", "group_art_unit", "technology_center", "entity_size", "petitioner_real_party", "owner_real_party", "grant_date", "filing_date", "cpc_codes", "event_codes", "event_dates", "assignment_received_dates", "assignment_recorded_dates", "assignees_per_assignment", "parent_app_numbers", "inventor_country_codes", "petition_text"]


#: Tells rows that had a text where its features stand in its place.
HAD_TEXT = "__had_text"


def with_text_features(df: DataFrame, spec: dict) -> DataFrame:
    """The rows, usable or not, with the features of their texts in place of the texts: the part of build_features that is dear and reads the text only."""
    return text_features(df.withColumn(HAD_TEXT, F.col("petition_text").isNotNull()), "petition_text", spec["text"]).drop("petition_text")


def build_features(df: DataFrame, spec: dict, strict_wrapper: bool = True) -> DataFrame:
    """One row per trial with a usable text (and a matched wrapper); labels and later facts never leave this stage.

    Rows of ``with_text_features`` are taken, too.
    """
    ready = HAD_TEXT in df.columns
    if absent := [c for c in NEEDED + (["wrapper_matched"] if strict_wrapper else ["application_number"]) if c not in df.columns and not (ready and c == "petition_text")]:
        raise ValueError(f"missing columns: {absent}")
    kept = df.where(F.col(HAD_TEXT) & (F.col("petition_text_length") >= spec["least_text"])) if ready else usable(df, "petition_text", spec["least_text"])
    kept = kept.where("wrapper_matched") if strict_wrapper else kept.where("application_number is not null")
    t0 = lenient_date(F.col("petition_filing_date"))
    kept = kept.withColumn("__t0", t0)
    kept = kept if ready else text_features(kept, "petition_text", spec["text"]).drop("petition_text")
    kept = kept.withColumn("__events", A.events_before(F.col("event_codes"), F.col("event_dates"), F.col("__t0"), spec["categories"], spec["banned"], spec["banned_prefixes"]))
    kept = kept.withColumn("__assigned", A.assignments_before(F.col("assignment_received_dates"), F.col("assignment_recorded_dates"), F.col("assignees_per_assignment"), F.col("__t0")))
    t0 = F.col("__t0")
    assigned = F.transform("__assigned", lambda a: a["date"])
    some = lambda c: F.when(t0.isNotNull(), c)
    grant = lenient_date(F.col("grant_date"))
    pendency = some(days_between(t0, grant))
    span = some(A.span_days(F.transform("__events", lambda e: e["date"])))
    text = ["n_grounds", "n_grounds_102", "n_grounds_103", "has_sotera_stipulation", "mentions_fintiv_factors", "petition_text_length"]
    counts = {f"n_{k.lower()}": A.count_category(F.col("__events"), k) for k in spec["counted"]}
    columns = {
        "filing_year": F.year(t0), "filing_month": F.month(t0), "art_unit_group": leading_number(F.col("group_art_unit")),
        "days_grant_to_petition": pendency, "days_grant_to_petition_missing": missing_flag(pendency), "prosecution_span_days": span, "prosecution_span_days_missing": missing_flag(span),
        "days_since_last_assignment": some(A.recency_days(assigned, t0)), "no_recorded_assignment": A.none_flag(F.col("__assigned")),
        **counts, "n_events": F.size("__events"), "n_assignments": F.size("__assigned"), "n_distinct_assignees": A.distinct_names(F.transform("__assigned", lambda a: a["names"])),
        "n_cpc_codes": some_count(t0, A.length_of(F.col("cpc_codes"))), "n_cpc_subclasses": some_count(t0, A.distinct_prefixes(F.col("cpc_codes"))), "n_parent_applications": some_count(t0, A.length_of(F.col("parent_app_numbers"))),
        "cpc_section": some(A.first_initial(F.col("cpc_codes"))), "inventor_geo": some(A.all_equal_bucket(F.col("inventor_country_codes"), "US", "us_only", "any_foreign")), "ptab_era": era_of(t0, spec["eras"]),
    }
    passed = ["technology_center", "entity_size", "petitioner_real_party", "owner_real_party"]
    return kept.select("trial_number", *passed, *(c.alias(k) for k, c in columns.items()), *text)


def some_count(t0: Column, c: Column) -> Column:
    return F.when(t0.isNotNull(), c).otherwise(0)


def admissible(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Leakage guard: only listed columns leave; a listed one that is absent is an error."""
    if absent := [c for c in allowed if c not in df.columns]:
        raise ValueError(f"missing columns: {absent}")
    return df.select(*allowed)

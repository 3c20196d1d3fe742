from datetime import date

import pytest
from pyspark.sql import functions as F

from docket_spark.domain import values as V
from docket_spark.operators import arrays as A, features, labels, select_one, text

TRIAL = dict(
    trial_number="T1", petition_filing_date=date(2022, 5, 23), group_art_unit="2452", technology_center="2400", entity_size="Small", petitioner_real_party="P", owner_real_party="O", grant_date=None, filing_date=date(2015, 1, 1),
    cpc_codes=["H04L 1/00", "H04L 2/00", "G06F 1/00"], event_codes=["DOCK", "OIPE", "WIDS", "M2551", "WHAT", "TRIALPET", "TRIALXX", "CTNF", " "],
    event_dates=[date(2015, 5, 11), date(2016, 1, 1), date(2017, 1, 1), date(2021, 1, 1), date(2018, 1, 1), date(2020, 1, 1), date(2020, 1, 1), date(2022, 5, 23), date(2019, 1, 1)],
    assignment_received_dates=[date(2016, 1, 1), date(2023, 1, 1)], assignment_recorded_dates=[date(2016, 2, 1), None], assignees_per_assignment=[["Apple Inc.", "APPLE INC"], ["X"]], parent_app_numbers=["1", "2"],
    inventor_country_codes=["US", "CN"], petition_text="Ground 1 and Ground 2. " + "x" * 5000, wrapper_matched=True, application_number="1",
)
SCHEMA = "trial_number string, petition_filing_date date, group_art_unit string, technology_center string, entity_size string, petitioner_real_party string, owner_real_party string, grant_date date, filing_date date, cpc_codes array<string>, event_codes array<string>, event_dates array<date>, assignment_received_dates array<date>, assignment_recorded_dates array<date>, assignees_per_assignment array<array<string>>, parent_app_numbers array<string>, inventor_country_codes array<string>, petition_text string, wrapper_matched boolean, application_number string"


def frame(spark, *changes):
    return spark.createDataFrame([tuple((TRIAL | c)[k] for k in TRIAL) for c in changes or [{}]], SCHEMA)


def test_trial_features(spark):
    r = features.build_features(frame(spark), V.FEATURE_SPEC).first()
    assert (r["n_ex"], r["n_pe"], r["n_aa"], r["n_maint"], r["n_other"], r["n_events"]) == (1, 1, 1, 1, 1, 5)
    assert (r["prosecution_span_days"], r["prosecution_span_days_missing"]) == ((date(2021, 1, 1) - date(2015, 5, 11)).days, 0)
    assert (r["n_assignments"], r["n_distinct_assignees"], r["days_since_last_assignment"], r["no_recorded_assignment"]) == (1, 1, (date(2022, 5, 23) - date(2016, 1, 1)).days, 0)
    assert (r["days_grant_to_petition"], r["days_grant_to_petition_missing"], r["cpc_section"], r["n_cpc_subclasses"], r["inventor_geo"], r["ptab_era"], r["art_unit_group"]) == (None, 1, "H", 2, "any_foreign", "vidal", 245.0)
    assert (r["n_grounds"], r["filing_year"], r["filing_month"], r["n_parent_applications"]) == (2, 2022, 5, 2)


def test_rows_that_go_and_rows_that_are_empty(spark):
    empty = dict(trial_number="E", event_codes=None, event_dates=None, assignment_received_dates=None, cpc_codes=None, inventor_country_codes=None, petition_filing_date=None)
    df = frame(spark, dict(trial_number="short", petition_text="x" * 4999), dict(trial_number="null", petition_text=None), dict(trial_number="alone", wrapper_matched=False), empty)
    rows = features.build_features(df, V.FEATURE_SPEC).collect()
    assert [r["trial_number"] for r in rows] == ["E"]
    r = rows[0]
    assert r["n_events"] == r["n_assignments"] == r["n_cpc_codes"] == 0 and r["no_recorded_assignment"] == 1 and r["ptab_era"] is None and r["inventor_geo"] is None
    assert {r["trial_number"] for r in features.build_features(df, V.FEATURE_SPEC, strict_wrapper=False).collect()} == {"E", "alone"}
    with pytest.raises(ValueError):
        features.build_features(df.drop("cpc_codes"), V.FEATURE_SPEC)
    assert "cancelled" not in features.build_features(df.withColumn("cancelled", F.lit(1)), V.FEATURE_SPEC).columns


TEXTS = {
    "Ground 1: x. Ground 2: y. Ground 1": (2, 0, 0, 0, 0),
    "§ 102(e) and § 103(a) and § 103": (0, 1, 2, 0, 0),
    "Petitioner will cease asserting the invalidity": (0, 0, 0, 1, 0),
    "\n".join(f"Factor {i} — {w}" for i, w in enumerate(["stay", "trial date", "investment", "overlap", "petitioner", "other"], 1)): (0, 0, 0, 0, 1),
    "Factor 1: x Factor 2: y": (0, 0, 0, 0, 0),
    "Ground 35 U.S.C. 102": (0, 1, 0, 0, 0),
    "Ground 1A, Ground 1B, Ground 2A": (2, 0, 0, 0, 0),
    "circuit ground 357 and ground\n56": (0, 0, 0, 0, 0),
    "Challenge #1 Challenge #2 Challenge 3": (3, 0, 0, 0, 0),
    "section 103 subtracts": (0, 0, 0, 0, 0),
    "on section 102 and 103 grounds": (0, 1, 1, 0, 0),
    "35 U.S.C. § 102": (0, 1, 0, 0, 0),
    "Grounds 1 and 2: x": (2, 0, 0, 0, 0),
    "§ 103\r 1 103 5": (0, 0, 1, 0, 0),
    "the first Fintiv factor, the second Fintiv factor, Fintiv factors 3 and 4": (0, 0, 0, 0, 0),
    "Factor one is neutral. Factor two. Factor three.": (0, 0, 0, 0, 1),
    "": (0, 0, 0, 0, 0),
}


def test_petition_texts(spark):
    df = spark.createDataFrame([(k,) for k in TEXTS] + [(None,)], "t string")
    for r in text.text_features(df, "t", V.TEXT_SPEC).collect():
        want = TEXTS.get(r["t"] or "")
        assert (r["n_grounds"], r["n_grounds_102"], r["n_grounds_103"], r["has_sotera_stipulation"], r["mentions_fintiv_factors"]) == want, r["t"]


def test_java_patterns_match_as_python_does(spark):
    import re

    samples = [*TEXTS, "a\u0085 1 102 3", "x\n 2 102 1-3, 5", "SECTION 102", "will not, as to any claims, pursue the same\r\ngrounds"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = text.text_features(df, "t", V.TEXT_SPEC).collect()
    for r in got:
        assert r["n_grounds_102"] == len(re.findall(V.TEXT_SPEC["statute_102"], r["t"])), r["t"]
        assert r["has_sotera_stipulation"] == int(any(re.search(p, r["t"], re.I | re.S) for p in V.TEXT_SPEC["stipulation"])), r["t"]


def test_verdicts(spark):
    cases = {
        "Determining All Challenged Claims Unpatentable": 1, "Determining No Claims Unpatentable": 0, "Determining Some Challenged Claims Unpatentable": 0,
        "Determining Challenged Claims 1, 3–11 Unpatentable": 0, "Determining Challenged Claim\nUnpatentable": 1, "x" * 4000 + "Determining All Claims Unpatentable": None,
        "ORDERED that claims 1 are unpatentable; FURTHER ORDERED that claim 2 has not been shown to be unpatentable;": 0, "ORDERED that claims 1-4 are unpatentable": 1, "nothing": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", labels.verdict(F.col("t"), V.HEAD_RULES, V.TAIL_RULES).alias("v")).collect():
        assert r["v"] == cases[r["t"]], r["t"]


def test_layers_of_labels(spark):
    trials = spark.createDataFrame([("a", "Institution Denied", None, None), ("b", "Terminated-Adverse Judgment", None, None), ("c", "FWD", "All Challenged Claims Unpatentable", "d1"), ("d", "FWD", "other", "d2"), ("e", "Pending", None, None), ("f", None, None, "d3"), ("g", None, None, None)], "k string, status string, title string, doc string")
    texts = spark.createDataFrame([("d2", "Determining No Claims Unpatentable"), ("d3", "ORDERED that claim 1 is unpatentable"), ("d9", "x")], "doc string, said string")
    out = labels.resolve(trials, "status", "title", V.STATUS_LABEL_0, V.STATUS_LABEL_1, V.STATUS_PENDING, V.TITLE_RULE, texts, "doc", "said", V.HEAD_RULES, V.TAIL_RULES)
    assert {r["k"]: (r["label"], r["label_source"]) for r in out.collect()} == {"a": (0, "status"), "b": (1, "status"), "c": (1, "title"), "d": (0, "text"), "f": (1, "text")}


PICKS = [
    ([(1, "Petition", "PETITION"), (2, "Power of Attorney", "Paper")], 1), ([(3, "Petition for IPR", "PETITION"), (8, "Corrected Petition", "PETITION")], 3), ([(2, "Inter Partes Review of US 1", "Paper")], 2),
    ([(2, "Request for IPR of X", "Paper")], 2), ([(3, "Petitioner's Petition for Inter Partes Review", "Paper")], 3), ([(2, "Petitioner's Petition Ranking", "Paper")], None), ([(4, "Notice of Filing Date Accorded to Petition", "Paper")], None),
    ([(150, "Petition", "Paper")], None), ([(1, "Petition", "Exhibit")], None), ([(None, "Petition", "Paper"), (0, "Petition", "Paper")], None), ([(5, "", "PETITION")], 5),
]


def test_pick_cascade(spark):
    rows = [(f"k{i}", n, title, "Petition", c, f"id{j}") for i, (docs, _) in enumerate(PICKS) for j, (n, title, c) in enumerate(docs)]
    df = spark.createDataFrame(rows, "k string, n int, title string, name string, cat string, id string")
    out = select_one.pick_by_cascade(df, "k", "n", "title", "name", "cat", "id", V.PETITION_TITLE, V.TITLE_BLACKLIST, V.EXHIBIT_CATEGORIES, V.PAPER_CEILING)
    assert {r["k"]: r["n"] for r in out.collect()} == {f"k{i}": want for i, (_, want) in enumerate(PICKS) if want}


def test_terminating_rows(spark):
    df = spark.createDataFrame([("a", "final  written decision: Original", "x", date(2020, 1, 2), "2"), ("a", "Final Written Decision:  original", "x", date(2020, 1, 2), "1"), ("b", "Final Decision", "Decision On Remand", date(2020, 1, 1), "3"), ("b", "Final Decision", None, None, "4"), ("c", "Order", "x", date(2020, 1, 1), "5")], "k string, type string, title string, d date, id string")
    out = select_one.terminating_rows(df, "k", "type", "title", "d", "id", V.FWD_TYPES, V.LEGACY_FWD_TYPE, V.AMENDMENT_MARKERS, {"id": "doc", "d": "issued", "uri": "uri"})
    assert {r["k"]: (r["doc"], r["uri"]) for r in out.collect()} == {"a": ("1", None), "b": ("4", None)}


def test_arrays_are_cut_to_the_shortest(spark):
    df = spark.sql("SELECT array('a', 'b') AS x, array(date'2020-01-01') AS y, cast(null AS array<date>) AS z, date'2021-01-01' AS t0")
    assert df.select(F.size(A.zipped(F.col("x"), F.col("y"), names=["a", "b"]))).first()[0] == 1
    assert df.select(F.size(A.zipped(F.col("x"), F.col("z"), names=["a", "b"]))).first()[0] == 0


ODD = [
    "Wİll NOT, as to any claims, pursue the same GROUND", "will not ſeek ground", "Stİpulated it wıll not raıse invalidity", "will ceaſe to assert it: invalİdity", "agrees not to bring an INVALIDITY case",
    "stipulates to cease; invalidity", "İ fACTOR 1: a. fActor 2: b. FACTOR 3. c", "1. Stay\n 2. Trial date\n3. Overlap", "\n  1 102 3\n　\n 2 103 4, 5", " 1 102 3", "35 U.S.C. §§ 102, 35 USC 103, 103(a), 42.103(a), Section 103",
    "GROUNDS 1 and ٢. Grounds 3 and 4 U.S.C. Ground ٣A Challenge #9 Ground 12B3 ground 8 Ground 7 U.S.C. GROUND\t10", "section 102 and 103 grounds section 103 ground", "Fintiv factors 1 and 2, the third Fintiv factor, Factor 4.", "Factor one Factor two Factor three", "fACTOR one FACTOR two FACTOR three",
]


def test_what_spares_passes_over_a_text_changes_no_feature(spark):
    from docket_spark.functions.regex import captures

    df = spark.createDataFrame([(s,) for s in [*ODD, *TEXTS, *(a + "\n" + b for a in ODD for b in ODD[::3])]], "t string")
    plain = {k: v for k, v in V.TEXT_SPEC.items() if k not in ("needs", "first", "inner", "without_lines")}
    rows = lambda spec: {r["t"]: r for r in text.text_features(df, "t", spec).collect()}
    got = rows(V.TEXT_SPEC)
    assert got == rows(plain)
    assert {k for k in ODD if got[k]["has_sotera_stipulation"]} == set(ODD[:6]) and sum(r["mentions_fintiv_factors"] for r in got.values()) > 3
    pattern, groups = V.TEXT_SPEC["grounds"]
    for r in df.select("t", F.sort_array(captures(F.col("t"), pattern, groups)).alias("a"), F.sort_array(captures(F.col("t"), pattern, groups, first="[GC]", inner=r"\d+")).alias("b")).collect():
        assert r["a"] == r["b"], r["t"]


def test_texts_of_trials_are_made_once_a_trial(spark):
    from checks import DATA
    from docket_spark.plans.trials import trial_features

    above, below = trial_features(spark, DATA)._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")
    assert "plain words" in above
    assert "plain words" not in below and "length(" not in below

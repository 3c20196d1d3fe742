"""Of a provenance check, what reads no facts is made once for all builds."""

import pytest
from checks import DATA
from pyspark.sql import functions as F

from docket_spark.domain.values import FEATURE_SPEC
from docket_spark.operators import features, provenance
from docket_spark.plans import trials


def test_a_stage_without_facts_sees_none_and_keeps_them(spark):
    facts = provenance.Facts([(["dates"], ["codes"])], ["outcome"])
    df = spark.createDataFrame([("a", "x y", ["2020-01-01"], ["C"], "won"), ("b", None, None, None, None)], "key string, text string, dates array<string>, codes array<string>, outcome string")
    out = provenance.without_facts(df, lambda d: d.withColumn("n", F.length("text")), facts)
    assert out.select(df.columns).collect() == df.collect() and [r["n"] for r in out.collect()] == [3, None]
    for c in ("dates", "codes", "outcome"):
        with pytest.raises(Exception, match=c):
            provenance.without_facts(df, lambda d, c=c: d.withColumn("n", F.col(c)), facts).collect()
    with pytest.raises(ValueError):
        provenance.without_facts(df, lambda d: d.select("key"), facts)


def test_the_order_of_columns_does_not_hide_changes(spark):
    df = spark.sql("select date'2020-01-01' t0, array(date'2019-01-01', date'2021-01-01') dates, array('A', 'B') codes")
    facts = provenance.Facts([(["dates"], ["codes"])], [])
    for order in (["codes", "dates"], ["dates", "codes"]):
        r = provenance.with_other_future(df.select("t0", *order), "t0", facts).first()
        assert len(r["dates"]) == len(r["codes"]) == 3 and r["codes"][0] == "A" and r["codes"][1] != "B"


def test_features_are_the_same_where_texts_were_searched_before(spark):
    df = trials._trials(spark, DATA)
    df = df.withColumn("petition_text", F.when(F.col("trial_number").endswith("3"), None).otherwise(F.col("petition_text")))
    ready = features.with_text_features(df, FEATURE_SPEC)
    assert "petition_text" not in ready.columns
    of = lambda d: {r["trial_number"]: r for r in features.build_features(d, FEATURE_SPEC).collect()}
    found = of(ready)
    assert found == of(df) and found and not any(k.endswith("3") for k in found)


def test_the_provenance_check_searches_texts_once(spark):
    plan = trials.provenance_check(spark, DATA)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "join" in plan and "pursue" not in plan and "repeat(" not in plan

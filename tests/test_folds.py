"""Forward folds prepared together against folds fitted one by one; steps of scores; levels; first rows of hot keys."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Observation, functions as F

from docket_spark.operators import encode, metrics, modeling, select_one, splits


def frame(spark):
    r = random.Random(4)
    rows = []
    for i in range(240):
        c = r.choice(["a", "b", None] if i < 120 else ["a", "b", None, "late"])
        n = None if r.random() < 0.1 else r.gauss(1.0 if i % 3 else 0.0, 1.0)
        rows.append((date(2019, 1, 1) + timedelta(i // 2), c, n, float(i) if i > 100 else None, None if i % 50 == 7 else int(i % 3 > 0)))
    return spark.createDataFrame(rows, "d date, c string, n double, m double, y int").repartition(3)


def test_folds_together_equal_folds_one_by_one(spark):
    df, estimator = frame(spark), lambda total: modeling.logistic(0.5, 0.0, total)
    got = modeling.fold_scores(df, "y", "d", ["c"], ["n", "m"], estimator, 4)
    want = []
    for k, bounds in enumerate(splits.fold_dates(df, "d", 4)):
        train, test = splits.fold(df, "d", bounds)
        scored = modeling.fit(train, "y", ["c"], ["n", "m"], estimator).transform(test)
        want.append((k, metrics.roc_auc(scored, "y", "score").first()["auc"], metrics.average_precision(scored, "y", "score").first()[0], metrics.class_report(scored, "y", "prediction").where("class = '1'").first()["f1"]))
    assert len(got) == len(want) == 4
    for a, b in zip(got, want):
        assert (a["fold"], a["auc"], a["average_precision"], a["f1"]) == pytest.approx(b, abs=1e-6)


def test_what_folds_learn(spark):
    df = frame(spark)
    ready = modeling.prepare_folds(df, "y", "d", ["c"], ["n", "m"], 3)
    for k, bounds in enumerate(ready.bounds):
        train, _ = splits.fold(df, "d", bounds)
        assert ready.medians[k] == pytest.approx(encode.medians(train, ["n", "m"])) and ready.weights[k] == pytest.approx(encode.class_weights(train, "y"))
        assert ready.levels[k] == {"c": encode.one_hot_levels(train, "c")} and ready.totals[k] == train.where("y is not null").count()
    assert "late" not in ready.levels[0]["c"] and "late" in ready.levels[-1]["c"]


def test_a_search_scans_the_frame_once(spark):
    asked = []
    df = frame(spark)
    plain = modeling.prepare_folds
    modeling.prepare_folds = lambda *a, **b: asked.append(1) or plain(*a, **b)
    try:
        out = modeling.grid_search(df, "y", "d", ["c"], ["n"], lambda c: lambda total: modeling.logistic(c, 0.0, total), {"c": [0.1, 1.0, 10.0]}, 2)
    finally:
        modeling.prepare_folds = plain
    assert out.count() == 3 and asked == [1]


def test_small_scores_have_steps_of_their_own(spark):
    r = random.Random(2)
    rows = [(int(r.random() < 0.3), r.random() * 1e-6) for _ in range(300)] + [(1, 0.0), (0, 0.0), (1, -1e-9), (0, -3.0), (1, 5.0)]
    df = spark.createDataFrame(rows, "y int, p double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df, "y", "p").first()["auc"] == pytest.approx(want)


def test_levels_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(encode, "MOST_LEVELS", 3)
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert encode.one_hot_levels(df, "c") == ["__missing__", "a", "b"]
    with pytest.raises(ValueError):
        encode.one_hot_levels(df.union(spark.createDataFrame([("z",)], "c string")), "c")


def test_first_row_of_a_hot_key_is_found_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = select_one.first_per_key(df, ["k"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    partial = plan.split("Exchange")[-1]
    assert "WindowGroupLimit" in partial and "Partial" in partial  # each task passes one row of a key on


@pytest.mark.parametrize("estimator", [lambda total: modeling.random_forest(3, 3), lambda total: modeling.logistic(1.0, 0.0, total)])
def test_models_work_in_a_session_that_has_observed(spark, estimator):
    seen = Observation("seen")
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    df = frame(spark)
    assert seen.get["n"] == 5
    assert modeling.fit(df, "y", ["c"], ["n"], estimator).transform(df).count() == df.count()
    assert modeling.fit(df, "y", ["c"], ["n"], estimator).transform(df).select("score").collect()
    assert len(modeling.fold_scores(df, "y", "d", ["c"], ["n"], estimator, 2)) == 2

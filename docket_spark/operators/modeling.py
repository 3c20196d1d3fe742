"""Training, forward-walking validation, grid search and scoring with pyspark.ml."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from statistics import fmean, pstdev

from pyspark import SparkContext
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import scratch
from . import encode as E, metrics as M
from .splits import fold_dates, mature, time_split


def random_forest(trees: int = 500, depth: int = 30, seed: int = 42, leaf: int = 5, subset: str = "0.3"):
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy=subset, minInstancesPerNode=leaf, seed=seed, weightCol="weight", labelCol="label", featuresCol="features")


def logistic(c: float = 1.0, l1_ratio: float = 0.0, total_weight: float = 1.0):
    """Standardised; C as inverse strength over the sum of weights."""
    return Pipeline(stages=[StandardScaler(withMean=True, inputCol="features", outputCol="scaled"), LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", elasticNetParam=l1_ratio, regParam=1.0 / (c * total_weight), standardization=False, maxIter=100)])


def light(model):
    """The model without training summaries: they hold the session, which cannot be sent to tasks once it has observed a query."""
    for stage in getattr(model, "stages", None) or [model]:
        if hasattr(stage, "stages"):
            light(stage)
        elif getattr(stage, "hasSummary", False):
            java = stage._java_obj
            java.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


@dataclass
class Fitted:
    """What was learned on the training rows: medians, levels and the model."""

    model: object
    medians: dict[str, float]
    categories: list[str]
    numbers: list[str]
    columns: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        ready = E.impute(E.fill_categories(df, self.categories), self.medians, self.columns)
        return self.model.transform(ready).withColumn("score", vector_to_array("probability")[1])


def fit(df: DataFrame, label: str, categories: list[str], numbers: list[str], estimator: Callable[[float], object]) -> Fitted:
    """Medians, levels, class weights and model of the training rows; ``estimator`` gets the sum of weights."""
    found = E.medians(df, numbers)
    ready = E.impute(E.fill_categories(df, categories), found, numbers)
    ready = E.weighted(ready.where(F.col(label).isNotNull()), label, E.class_weights(df, label)).withColumn("label", F.col(label).cast("double"))
    stages = [*E.preprocessor(categories, list(found)).getStages(), estimator(float(df.where(F.col(label).isNotNull()).count()))]
    return Fitted(light(Pipeline(stages=stages).fit(ready)), found, categories, list(found), numbers)


@dataclass
class Folds:
    """What all forward folds learn from their training days, and the columns they need, stored once."""

    frame: DataFrame
    label: str
    bounds: list[tuple]
    medians: list[dict[str, float]]
    levels: list[dict[str, list[str]]]
    weights: list[dict[int, float]]
    totals: list[int]

    def assembled(self, k: int, rows: DataFrame) -> DataFrame:
        """Rows with the features of fold k: 0/1 columns of the levels seen in its training days, numbers with its medians."""
        made = {f"__{c}_{i}": (F.col(c) == v).cast("double") for c, found in self.levels[k].items() for i, v in enumerate(found)}
        made |= {f"__n_{c}": F.coalesce(F.col(c), F.lit(v)) for c, v in self.medians[k].items()}
        return VectorAssembler(inputCols=list(made), outputCol="features").transform(rows.withColumns(made)).drop(*made)

    def scored(self, k: int, estimator: Callable[[float], object]) -> DataFrame:
        """Test rows of fold k with score and prediction of a model of its training rows."""
        last, end = self.bounds[k]
        train = self.frame.where((F.col("__day") <= F.lit(last)) & F.col(self.label).isNotNull())
        ready = E.weighted(self.assembled(k, train), self.label, self.weights[k]).withColumn("label", F.col(self.label).cast("double"))
        model = light(estimator(float(self.totals[k])).fit(ready.select("features", "label", "weight")))
        test = self.frame.where((F.col("__day") > F.lit(last)) & (F.col("__day") <= F.lit(end)))
        out = model.transform(self.assembled(k, test).select(self.label, "features"))
        return out.select(self.label, vector_to_array("probability")[1].alias("score"), "prediction")


def prepare_folds(df: DataFrame, label: str, date: str, categories: list[str], numbers: list[str], folds: int = 5) -> Folds:
    """Medians, levels and class weights of all folds, which grow from fold to fold, in a number of scans that neither folds
    nor models change: one writes the columns, one counts days, one each finds medians, levels and classes."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "folds")
    narrow = E.fill_categories(df, categories).select(F.to_date(date).alias("__day"), F.col(label), *categories, *(F.col(c).cast("double").alias(c) for c in numbers))
    narrow.write.parquet(path)
    frame = spark.read.parquet(path)
    bounds = fold_dates(frame, "__day", folds)
    upto = [F.col("__day") <= F.lit(a) for a, _ in bounds]
    middle = frame.agg(F.count(F.lit(1)), *(F.median(F.when(u, F.col(c))).alias(f"{k}_{c}") for k, u in enumerate(upto) for c in numbers)).first()
    medians = [{c: float(middle[f"{k}_{c}"]) for c in numbers if middle[f"{k}_{c}"] is not None} for k in range(len(bounds))]
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in categories))) if categories else None
    first = frame.select("__day", each).groupBy("name", "value").agg(F.min("__day").alias("day")).limit(E.MOST_LEVELS + 1).collect() if categories else []
    if len(first) > E.MOST_LEVELS:
        raise ValueError(f"more than {E.MOST_LEVELS} levels")
    levels = [{c: sorted(r["value"] for r in first if r["name"] == c and r["day"] is not None and r["day"] <= a) for c in categories} for a, _ in bounds]
    classes = frame.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("int").alias("y")).agg(*(F.count_if(u).alias(f"n{k}") for k, u in enumerate(upto))).collect()
    counts = [{r["y"]: r[f"n{k}"] for r in classes if r[f"n{k}"]} for k in range(len(bounds))]
    weights = [{y: sum(n.values()) / (len(n) * v) for y, v in sorted(n.items())} for n in counts]
    return Folds(frame, label, bounds, medians, levels, weights, [sum(n.values()) for n in counts])


def fold_scores(df: DataFrame, label: str, date: str, categories: list[str], numbers: list[str], estimator, folds: int = 5, threads: int = 2, prepared: Folds | None = None) -> list[dict]:
    """By fold: AUC, average precision and F1 of class 1 on the days after the training days."""
    ready = prepared or prepare_folds(df, label, date, categories, numbers, folds)

    def one(k):
        scored = ready.scored(k, estimator).persist()
        try:
            report = M.class_report(scored, label, "prediction").where("class = '1'").first()
            return {"fold": k, "auc": M.roc_auc(scored, label, "score").first()["auc"], "average_precision": M.average_precision(scored, label, "score").first()[0], "f1": report["f1"]}
        finally:
            scored.unpersist()

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(one, range(len(ready.bounds))))


def combos(grid: dict[str, list]) -> list[dict]:
    """All combinations; an empty grid has one, which is empty."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def grid_search(df: DataFrame, label: str, date: str, categories: list[str], numbers: list[str], factory: Callable[..., Callable], grid: dict[str, list], folds: int = 5) -> DataFrame:
    """params, mean_auc, std_auc, best; the first of equals is best."""
    rows, ready = [], prepare_folds(df, label, date, categories, numbers, folds)
    for params in combos(grid):
        aucs = [r["auc"] for r in fold_scores(df, label, date, categories, numbers, factory(**params), folds, prepared=ready) if r["auc"] is not None]
        rows.append((str(params), fmean(aucs) if aucs else None, pstdev(aucs) if aucs else None))
    top = max((r[1] for r in rows if r[1] is not None), default=None)
    first = next((i for i, r in enumerate(rows) if r[1] == top), -1)
    return df.sparkSession.createDataFrame([(*r, i == first) for i, r in enumerate(rows)], "params string, mean_auc double, std_auc double, best boolean")


def compare(df: DataFrame, label: str, date: str, categories: list[str], numbers: list[str], estimators: dict[str, Callable], folds: int = 5) -> DataFrame:
    """Estimators by mean AUC."""
    rows, ready = [], prepare_folds(df, label, date, categories, numbers, folds)
    for name, e in estimators.items():
        aucs = [r["auc"] for r in fold_scores(df, label, date, categories, numbers, e, folds, prepared=ready) if r["auc"] is not None]
        rows.append((name, fmean(aucs) if aucs else None))
    return df.sparkSession.createDataFrame(rows, "estimator string, mean_auc double").orderBy(F.desc("mean_auc"), "estimator")


def importances(fitted: Fitted, spark: SparkSession, n: int = 20) -> DataFrame:
    """feature, importance: forest importances or absolute coefficients, the largest first."""
    model = fitted.model.stages[-1]
    model = model.stages[-1] if hasattr(model, "stages") else model
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
    names = []
    for c, stage in zip(fitted.categories, fitted.model.stages):
        names += [f"{c}_{v}" for v in stage.labels]
    names += fitted.numbers
    return M.top_n(spark.createDataFrame([(k, float(v)) for k, v in zip(names, values)], "feature string, importance double"), "importance", "feature", n)


def score(df: DataFrame, fitted: Fitted, key: str, model_version: str, feature_version: str) -> DataFrame:
    """Audit rows of predictions."""
    return fitted.transform(df).select(F.col(key).cast("string").alias("trial_number"), F.col("score").alias("probability"), F.col("prediction").cast("int").alias("predicted_label"), F.lit(model_version).alias("model_version"), F.lit(feature_version).alias("feature_version"), F.current_timestamp().alias("predicted_at"))


def without_suffix(df: DataFrame, suffixes: list[str]) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(tuple(suffixes))])


def ablation(df: DataFrame, label: str, date: str, categories: list[str], numbers: list[str], suffixes: list[str], estimator, folds: int = 3) -> list[dict]:
    """Fold scores with all columns and with those of the suffixes dropped and the model fitted again."""
    out = []
    for kept, frame in (("all", df), ("without", without_suffix(df, suffixes))):
        own = [[c for c in names if c in frame.columns] for names in (categories, numbers)]
        out += [{"columns": kept, **row} for row in fold_scores(frame, label, date, *own, estimator, folds)]
    return out


def run_training(df: DataFrame, label: str, date: str, categories: list[str], numbers: list[str], estimator, today: str, mature_days: int, cutoff: str, folds: int = 5) -> tuple[Fitted, list[dict], DataFrame]:
    """Mature rows -> split -> folds -> refit on all training rows -> report of the held-out rows."""
    train, test = time_split(mature(df, date, today, mature_days), date, cutoff)
    train = train.cache()
    try:
        by_fold = fold_scores(train, label, date, categories, numbers, estimator, folds)
        fitted = fit(train, label, categories, numbers, estimator)
    finally:
        train.unpersist()
    return fitted, by_fold, M.class_report(fitted.transform(test), label, "prediction")

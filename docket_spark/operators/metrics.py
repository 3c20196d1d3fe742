"""Exact metrics of scores against 0/1 labels, at the grain of distinct scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.count("*").alias("n"))


def _cumulative(df: DataFrame, label: str, score: str) -> DataFrame:
    """score, pos, neg and the counts at or above the score.

    Summed in two levels: scores fall into steps, and only the steps' sums meet in one task.  Steps are fine for large
    scores (by log1p, some ten thousand up to 1) and for small ones (by log2, 512 to each halving).
    """
    size = F.abs("score")
    step = (F.signum("score") * (F.floor(F.log1p(size) * 65536) * (1 << 21) + F.when(size > 0, F.floor(F.log2(size) * 512) + (1 << 20)).otherwise(0))).cast("bigint")
    grain = _by_score(df, label, score).select("score", "pos", (F.col("n") - F.col("pos")).alias("neg"), step.alias("step"))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = grain.groupBy("step").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    steps = steps.select("step", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p_above"), F.coalesce(F.sum("q").over(above), F.lit(0)).alias("q_above"))
    down = Window.partitionBy("step").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    inner = grain.select("step", "score", "pos", "neg", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"))
    return inner.join(steps, "step").select("score", "pos", "neg", (F.col("tp") + F.col("p_above")).alias("tp"), (F.col("fp") + F.col("q_above")).alias("fp"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """auc (ties count half), n_pos, n_neg; null without both classes."""
    c = _cumulative(df, label, score)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") / 2.0)
    return c.agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc"), F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Step sum of precision over recall."""
    c = _cumulative(df, label, score)
    return c.agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("pos")).alias("average_precision"))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, fpr, tpr at each distinct score."""
    c = _cumulative(df, label, score)
    total = _by_score(df, label, score).agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return c.crossJoin(F.broadcast(total)).select(F.col("score").alias("threshold"), F.try_divide("fp", "q").alias("fpr"), F.try_divide("tp", "p").alias("tpr"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(label).cast("int").alias("label"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Rows 0, 1, macro avg, weighted avg: precision, recall, f1, support; accuracy in each row."""
    c = confusion(df, label, predicted)
    cell = lambda a, b: F.coalesce(F.sum(F.when((F.col("label") == a) & (F.col("predicted") == b), F.col("n"))), F.lit(0))
    one = c.agg(cell(0, 0).alias("n00"), cell(0, 1).alias("n01"), cell(1, 0).alias("n10"), cell(1, 1).alias("n11"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    n00, n01, n10, n11 = map(F.col, ("n00", "n01", "n10", "n11"))
    all_n = n00 + n01 + n10 + n11

    def stats(hit, said, true):
        p, r = ratio(hit, said), ratio(hit, true)
        return p, r, ratio(2 * p * r, p + r), true

    zero, ones = stats(n00, n00 + n10, n00 + n01), stats(n11, n11 + n01, n11 + n10)
    rows = {"0": zero, "1": ones, "macro avg": (*((a + b) / 2 for a, b in zip(zero[:3], ones[:3])), all_n), "weighted avg": (*(ratio(a * zero[3] + b * ones[3], all_n) for a, b in zip(zero[:3], ones[:3])), all_n)}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("class"), *(x.cast("double").alias(m) for x, m in zip(v, ("precision", "recall", "f1"))), v[3].cast("bigint").alias("support"), ratio(n00 + n11, all_n).alias("accuracy")) for k, v in rows.items())))
    return one.select(each.alias("x")).select("x.*")


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Equal bins of [0, 1], the last closed; empty ones are left out."""
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(place.alias("bin")).agg(F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("fraction_positive"), F.count("*").alias("n"))


def top_n(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(value), tie).limit(n)

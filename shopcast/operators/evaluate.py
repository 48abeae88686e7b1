"""Scores of predictions: classification, calibration, regression, recommendation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shopcast.operators.quantiles import order_statistics
from shopcast.operators.running import running_totals


def _ratio(top: Column, bottom: Column) -> Column:
    """Division where nothing to divide by gives 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def usable(df: DataFrame, prediction_col: str) -> DataFrame:
    return df.where(F.col(prediction_col).isNotNull())


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 and Brier score in one aggregate."""
    y, p = F.col(label), F.col(score)
    hit = p >= threshold

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    sums = df.agg(
        F.count(F.lit(1)).alias("n"),
        count((y == 1) & hit).alias("tp"),
        count((y == 0) & hit).alias("fp"),
        count((y == 1) & ~hit).alias("fn"),
        count((y == 0) & ~hit).alias("tn"),
        F.avg((p - y) * (p - y)).alias("brier_score_loss"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        _ratio(tp + F.col("tn"), F.col("n")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        "brier_score_loss",
        F.lit(threshold).alias("threshold"),
    )


def ranking_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact ROC AUC (ties count half) and PR AUC (trapezoid, from recall 0 at precision 1)."""
    counts = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
        F.count(F.when(F.col(label) == 0, 1)).alias("neg"),
    )
    curve = running_totals(counts, "score", ["pos", "neg"], descending=True)
    tp, fp = F.col("pos_upto").cast("double"), F.col("neg_upto").cast("double")
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp0, fp0 = tp - pos, fp - neg
    before = F.when(tp0 + fp0 > 0, F.try_divide(tp0, tp0 + fp0)).otherwise(F.lit(1.0))
    now = F.try_divide(tp, tp + fp)
    sums = curve.agg(
        F.sum(neg * (tp0 + pos / 2)).alias("won"),
        F.sum(pos * (before + now) / 2).alias("area"),
        F.sum(pos).alias("p"),
        F.sum(neg).alias("n"),
    )
    return sums.select(
        F.try_divide(F.col("won"), F.col("p") * F.col("n")).alias("roc_auc"),
        F.try_divide(F.col("area"), F.col("p")).alias("pr_auc"),
    )


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages."""
    cells = df.groupBy(
        F.col(label).cast("string").alias("y"), F.col(predicted).cast("string").alias("p")
    ).agg(F.count(F.lit(1)).alias("c"))
    hit = F.when(F.col("y") == F.col("p"), F.col("c")).otherwise(0)
    classes = (
        cells.select(
            F.inline(
                F.array(
                    F.struct(
                        F.col("y").alias("class"), F.col("c").alias("support"),
                        F.lit(0).cast("bigint").alias("chosen"), hit.alias("tp"),
                    ),
                    F.struct(
                        F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"),
                        F.col("c").alias("chosen"), F.lit(0).cast("bigint").alias("tp"),
                    ),
                )
            )
        )
        .groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("tp").alias("tp"))
        .select(
            "class",
            _ratio(F.col("tp"), F.col("chosen")).alias("precision"),
            _ratio(F.col("tp"), F.col("support")).alias("recall"),
            _ratio(2 * F.col("tp"), F.col("chosen") + F.col("support")).alias("f1_score"),
            "support",
            "tp",
        )
    )

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))

    n = F.sum("support").alias("support")
    summary = classes.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                F.lit(None).cast("double").alias("recall"),
                _ratio(F.sum("tp"), F.sum("support")).alias("f1_score"), n,
            ),
            F.struct(
                F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                F.avg("recall").alias("recall"), F.avg("f1_score").alias("f1_score"), n,
            ),
            F.struct(
                F.lit("weighted avg").alias("class"), weighted("precision").alias("precision"),
                weighted("recall").alias("recall"), weighted("f1_score").alias("f1_score"), n,
            ),
        ).alias("rows")
    ).select(F.inline("rows"))
    return classes.drop("tp").unionByName(summary)


def regression_errors(df: DataFrame, actual: str, models: Sequence[str]) -> DataFrame:
    """Mean squared and mean absolute error per prediction column, in one aggregate."""
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                F.avg((F.col(actual) - F.col(m)) * (F.col(actual) - F.col(m))).alias("mse"),
                F.avg(F.abs(F.col(actual) - F.col(m))).alias("mae"),
            )
            for m in models
        ]
    )
    return df.agg(rows.alias("rows")).select(F.inline("rows"))


def confusion_matrix(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Counts per true and predicted class with their share of the true class."""
    hit = (F.col(score) >= threshold).cast("int")
    cells = df.groupBy(F.col(label).cast("int").alias("actual"), hit.alias("predicted")).agg(
        F.count(F.lit(1)).alias("cnt")
    )
    return cells.withColumn(
        "share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("actual"))
    )


def calibration_table(
    df: DataFrame, label: str, score: str, n_bins: int = 100, strategy: str = "uniform"
) -> DataFrame:
    """Mean prediction and share of positives per bin; empty bins do not appear.

    A value on an inner edge belongs to the bin below it.
    """
    p = F.col(score).cast("double")
    if strategy == "uniform":
        step = 1.0 / n_bins
        guess = F.greatest(F.least(F.floor(p * n_bins), F.lit(n_bins - 1)), F.lit(0)).cast("int")
        # The guess is off by at most one; edges are multiples of the step.
        bin_no = (
            F.when((guess + 1 < n_bins) & ((guess + 1) * F.lit(step) < p), guess + 1)
            .when((guess > 0) & (guess * F.lit(step) >= p), guess - 1)
            .otherwise(guess)
        )
    elif strategy == "quantile":
        probs = [i / n_bins for i in range(1, n_bins)]
        edges = sorted(
            r["value"] for r in order_statistics(df, [score], probs, "linear").collect()
        )
        bin_no = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < p))
    else:
        raise ValueError("strategy must be 'uniform' or 'quantile'")
    return df.where(p.isNotNull()).groupBy(bin_no.cast("int").alias("bin")).agg(
        F.avg(p).alias("mean_predicted"),
        F.avg(F.col(label).cast("double")).alias("share_positive"),
        F.count(F.lit(1)).alias("cnt"),
    )


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """Equal-width bins over each column's own range; the last bin is closed."""
    limits = df.agg(
        F.struct(
            *[F.min(c).cast("double").alias(f"{c}_lo") for c in columns],
            *[F.max(c).cast("double").alias(f"{c}_hi") for c in columns],
        ).alias("l")
    ).scalar()
    entries = []
    for c in columns:
        lo, hi, v = limits[f"{c}_lo"], limits[f"{c}_hi"], F.col(c).cast("double")
        raw = F.floor((v - lo) * bins / F.when(hi != lo, hi - lo))
        at = F.when(v.isNotNull() & (hi == lo), F.lit(bins // 2)).otherwise(
            F.when(raw >= bins, F.lit(bins - 1)).otherwise(raw)
        )
        entries.append(
            F.struct(F.lit(c).alias("series"), at.cast("int").alias("bin"))
        )
    return (
        df.select(F.inline(F.array(*entries)))
        .where(F.col("bin").isNotNull())
        .groupBy("series", "bin")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def recommendation_report(df: DataFrame, answer: str, predicted: str, click: str) -> DataFrame:
    """Share of exact set matches, expected click rate by overlap, true click rate."""
    truth, guess = F.array_distinct(answer), F.array_distinct(predicted)
    same = F.array_sort(truth) == F.array_sort(guess)
    overlap = F.try_divide(
        F.size(F.array_intersect(guess, truth)).cast("double"), F.size(answer).cast("double")
    )
    return df.agg(
        F.avg(same.cast("double")).alias("exact_match"),
        F.avg(overlap * F.col(click)).alias("expected_ctr"),
        F.avg(F.col(click).cast("double")).alias("true_ctr"),
    )

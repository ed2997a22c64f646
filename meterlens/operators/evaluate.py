"""Scores and flags against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from meterlens import schema as S
from meterlens.operators.ordering import running_totals

OVERALL = "__all__"


def join_labels(scored: DataFrame, labels: DataFrame, keys: Sequence[str] = (S.CLIENT, S.TS)) -> DataFrame:
    """Left join of scored rows to the label of the next reading; no label counts as 0."""
    return scored.join(labels.select(*keys, "label_next"), list(keys), "left").withColumn(
        "label_next", F.coalesce(F.col("label_next").cast("int"), F.lit(0))
    )


def confusion_metrics(
    df: DataFrame, truth: str = "label_next", flag: str = "flag_final", *, overall: bool = True
) -> DataFrame:
    """Precision, recall, F1 (0 when undefined), accuracy and counts per segment.

    With ``overall`` one pass also gives the row over all segments, named ``__all__``.
    """
    t, f = F.col(truth) == 1, F.col(flag) == 1
    sums = [
        F.count_if(t & f).alias("tp"),
        F.count_if(t).alias("positives_true"),
        F.count_if(f).alias("positives_pred"),
        F.count_if(t == f).alias("hits"),
        F.count(F.lit(1)).alias("n_eval"),
    ]
    if overall:
        sets = df.groupingSets([[F.col(S.SEGMENT)], []], S.SEGMENT)
        counted = sets.agg(*sums, F.grouping(S.SEGMENT).alias("_all")).withColumn(
            S.SEGMENT, F.when(F.col("_all") == 1, F.lit(OVERALL)).otherwise(F.col(S.SEGMENT))
        )
    else:
        counted = df.groupBy(S.SEGMENT).agg(*sums)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, true, pred, n = (F.col(c) for c in ("tp", "positives_true", "positives_pred", "n_eval"))
    return counted.select(
        S.SEGMENT,
        share(tp, pred).alias("precision"),
        share(tp, true).alias("recall"),
        share(2 * tp, true + pred).alias("f1"),
        share(F.col("hits"), n).alias("accuracy"),
        "positives_true",
        "positives_pred",
        "n_eval",
        share(pred, n).alias("alarm_rate"),
    )


def _with_overall(df: DataFrame, overall: bool) -> DataFrame:
    if not overall:
        return df
    both = F.explode(F.array(F.col(S.SEGMENT), F.lit(OVERALL)))
    return df.withColumn(S.SEGMENT, both)


def _score_counts(df: DataFrame, truth: str, score: str, overall: bool) -> DataFrame:
    """Positives and negatives per distinct score: ties, however many, become one row."""
    t = F.col(truth) == 1
    per_score = df.groupBy(S.SEGMENT, F.col(score).alias("score")).agg(
        F.count_if(t).alias("pos"), F.count_if(~t).alias("neg")
    )
    if not overall:
        return per_score
    return (
        _with_overall(per_score, True)
        .groupBy(S.SEGMENT, "score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )


def roc_auc(
    df: DataFrame, truth: str = "label_next", score: str = "proba", *, overall: bool = True
) -> DataFrame:
    """Exact area under the ROC curve per segment by rank sums; null with one class only."""
    counts = _score_counts(df, truth, score, overall)
    ranked = running_totals(counts, [S.SEGMENT], ["score"], {"neg_upto": F.col("neg")})
    wins = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)
    return ranked.groupBy(S.SEGMENT).agg(
        F.try_divide(F.sum(wins), (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc")
    )


def roc_points(
    df: DataFrame, truth: str = "label_next", score: str = "proba", *, overall: bool = False
) -> DataFrame:
    """ROC curve: for each distinct score, the rates of rows scoring at least that much.

    The curve starts at (0, 0) with an infinite threshold. Every distinct score is a point, also on
    straight stretches, so the area under it does not depend on which points were left out.
    """
    counts = _score_counts(df, truth, score, overall).withColumn("down", -F.col("score"))
    run = running_totals(counts, [S.SEGMENT], ["down"], {"tp": F.col("pos"), "fp": F.col("neg")})
    totals = counts.groupBy(S.SEGMENT).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    points = run.join(totals, S.SEGMENT).select(
        S.SEGMENT,
        F.try_divide(F.col("fp").cast("double"), F.col("_n")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("_p")).alias("tpr"),
        F.col("score").alias("threshold"),
    )
    start = totals.select(
        S.SEGMENT,
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
        F.lit(float("inf")).alias("threshold"),
    )
    return start.unionByName(points)


def metrics_record(
    confusion: DataFrame, auc: DataFrame, thresholds: DataFrame, contamination: float, fusion: str, z: float
) -> DataFrame:
    """The stored record of one evaluation, one row per segment plus the overall row."""
    return (
        confusion.join(auc, S.SEGMENT, "left")
        .join(thresholds.select(S.SEGMENT, "thr_if"), S.SEGMENT, "left")
        .withColumns(
            {
                "contamination": F.lit(contamination),
                "fusion": F.lit(fusion),
                "z_threshold": F.lit(z),
            }
        )
    )

"""Quality figures of scores, computed over the whole table. No task holds more than its part of the scores."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattlens.plans.ordering import global_rank, running_totals


def score_steps(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score, in descending order: rows and positives, and their running totals."""
    steps = df.groupBy(F.col(score).alias("score")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("ones"))
    return running_totals(steps, [F.desc("score")], {"n_to": "n", "ones_to": "ones"})


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Chance that a positive scores above a negative, ties counted half; NULL with one class."""
    steps = score_steps(df, label, score)
    zeros_to, zeros = F.col("n_to") - F.col("ones_to"), F.col("n") - F.col("ones")
    # negatives above the step lose against its positives: count the negatives below it instead
    above = zeros_to - zeros
    totals = steps.agg(F.sum("ones").alias("p"), F.sum(zeros).alias("q"),
                       F.sum(F.col("ones") * (above + zeros / 2)).alias("lost"))
    return totals.select((1.0 - F.try_divide(F.col("lost"), F.col("p") * F.col("q"))).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision at each score weighted by the gain in recall."""
    steps = score_steps(df, label, score)
    area = steps.agg(F.sum(F.col("ones") * F.col("ones_to") / F.col("n_to")).alias("a"), F.sum("ones").alias("p"))
    return area.select(F.try_divide(F.col("a"), F.col("p")).alias("average_precision"))


def topk_metrics(df: DataFrame, label: str, score: str, id_column: str, share: float = 0.10) -> DataFrame:
    """Precision and recall among the best-scored tenth (at least one row) and the base rate."""
    n = df.agg(F.count("*")).scalar()
    k = F.greatest(F.lit(1), F.ceil(n * share))
    ranked = global_rank(df.select(id_column, label, score), [F.desc(score), id_column], "_rank")
    y = F.col(label).cast("double")
    top = F.col("_rank") <= k
    sums = ranked.agg(F.avg(F.when(top, y)).alias("precision_at_top_10_percent"),
                      F.sum(F.when(top, y)).alias("hits"), F.sum(y).alias("ones"),
                      F.avg(y).alias("holdout_positive_rate"))
    recall = F.col("hits") / F.greatest(F.col("ones"), F.lit(1.0))
    return sums.select("precision_at_top_10_percent", recall.alias("recall_at_top_10_percent"), "holdout_positive_rate")


def mae(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae"))


def r2(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Explained variance; NULL for fewer than three pairs or a constant target."""
    pairs = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    spread = F.count("*") * F.var_pop(actual)
    error = F.sum(F.pow(F.col(actual) - F.col(predicted), 2))
    return pairs.agg(F.when((F.count("*") >= 3) & (spread > 1e-12), 1.0 - error / spread).alias("r2"))

"""Metrics of binary classifiers from counts of scores, with ties handled exactly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .ranks import cut_points


def score_counts(df: DataFrame, target: str, score: str, keys: list[str]) -> DataFrame:
    """(keys, score, positives, negatives) for each different score; nulls are left out."""
    known = df.filter(F.col(target).isNotNull() & F.col(score).isNotNull())
    positive = F.sum(F.when(F.col(target) == 1, 1).otherwise(0))
    return known.groupBy(*keys, F.col(score).alias("score")).agg(positive.alias("positives"), (F.count(F.lit(1)) - positive).alias("negatives"))


def ranking(df: DataFrame, target: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, auroc, average_precision): ties count half in the first, and are one step in the second.

    Scores are counted before they are ordered, and running totals are taken within ranges of scores and over the
    ranges, so that no task orders all different scores.
    """
    keys = list(keys or [])
    return ranked_counts(stored(score_counts(df, target, score, keys), "scores"), keys)


def ranked_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """ranking() of score_counts()."""
    if not keys:
        counts = counts.withColumn("__all", F.lit(1))
    by = keys or ["__all"]
    counts = counts.withColumn("__part", cut_points(counts, ["score"])["score"].part(F.col("score").cast("double")))
    ranges = counts.groupBy(*by, "__part").agg(F.sum("positives").alias("__p"), F.sum("negatives").alias("__n"))
    above = Window.partitionBy(*by).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*by, "__part"])], F.coalesce(F.sum("__p").over(above), F.lit(0)).alias("__tp"), F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__fp"))
    down = Window.partitionBy(*by, "__part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    within = counts.withColumns({"__wp": F.sum("positives").over(down), "__wn": F.sum("negatives").over(down)})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*by, "__part"])])
    stepped = within.join(ranges, same).withColumns({"tp": F.col("__tp") + F.col("__wp"), "fp": F.col("__fp") + F.col("__wn")})
    area = F.sum(F.col("negatives") * (F.col("tp") - F.col("positives") / 2.0))
    precision = F.sum(F.col("positives") * F.col("tp") / (F.col("tp") + F.col("fp")))
    p, n = F.sum("positives"), F.sum("negatives")
    return stepped.groupBy(*by).agg(F.when((p > 0) & (n > 0), area / (p * n)).alias("auroc"), F.when(p > 0, precision / p).alias("average_precision")).drop("__all")


def quality_of(scored: DataFrame, target: str, score: str) -> DataFrame:
    """One row (auroc, average_precision, brier) of ranking() and brier(), from counts of scores that are taken once."""
    counts = stored(score_counts(scored, target, score, []), "scores")
    rows = F.sum(F.col("positives") + F.col("negatives"))
    squares = F.sum(F.col("positives") * F.pow(F.col("score") - 1, F.lit(2.0)) + F.col("negatives") * F.pow("score", F.lit(2.0)))
    return ranked_counts(counts, []).crossJoin(counts.agg((squares / rows).alias("brier")))  # one row each


def brier(target, score):
    """The mean squared difference, as an aggregate."""
    return F.avg(F.pow(score - target, F.lit(2.0)))


def confusion(df: DataFrame, target: str, score: str, thresholds: list[float]) -> DataFrame:
    """Extension: sensitivity, specificity, predictive values and F1 at each threshold (score at least the threshold)."""
    at = df.select(F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), F.col(target).alias("t"), (F.col(score)).alias("s"))
    hit = F.col("s") >= F.col("threshold")
    tp, fp = F.sum((hit & (F.col("t") == 1)).cast("long")), F.sum((hit & (F.col("t") == 0)).cast("long"))
    fn, tn = F.sum((~hit & (F.col("t") == 1)).cast("long")), F.sum((~hit & (F.col("t") == 0)).cast("long"))
    out = at.groupBy("threshold").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    ratio = F.try_divide
    return out.withColumns({"sensitivity": ratio("tp", F.col("tp") + F.col("fn")), "specificity": ratio("tn", F.col("tn") + F.col("fp")), "ppv": ratio("tp", F.col("tp") + F.col("fp")), "npv": ratio("tn", F.col("tn") + F.col("fn")), "f1": ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn"))})


def calibration(df: DataFrame, target: str, score: str, bins: int = 10) -> DataFrame:
    """Extension: (bin, n, mean_score, observed) over bins of equal width between 0 and 1."""
    own = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")
    return df.groupBy(own).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(target).cast("double")).alias("observed"))


def metric_summary(df: DataFrame, key: str = "model", leave_out: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Mean and sample standard deviation of every other column by key, in order of keys: x_mean for all, then x_std."""
    own = [c for c in df.columns if c != key and c not in leave_out]
    return df.groupBy(key).agg(*[F.avg(c).alias(f"{c}_mean") for c in own], *[F.stddev_samp(c).alias(f"{c}_std") for c in own]).orderBy(key)

"""Splits and folds that keep a group's rows together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.values import hash_rank
from .ranks import placed, quantiles


def group_labels(df: DataFrame, group: str, target: str, order: list[str]) -> DataFrame:
    """(group, label): the first non-null target of each group in the given order; null groups are left out."""
    known = F.struct(*order, F.col(target).alias("__target"))
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min(F.when(F.col(target).isNotNull(), known)).alias("__first")).select(group, F.col("__first.__target").alias("label"))


def hash_ranked(df: DataFrame, keys: list[str], by: str, seed: int) -> DataFrame:
    """df with `place`, a pseudo-random rank from 1 within keys, and `size`, the rows of the keys."""
    rows = df.withColumn("__hash", hash_rank(F.col(by).cast("string"), seed=seed))
    return placed(rows, keys, F.shiftright("__hash", 22), ["__hash", by]).drop("__hash")


def random_sides(df: DataFrame, group: str, target: str, order: list[str], test_size: float = 0.2, seed: int = 29) -> DataFrame:
    """(group, label, side): groups dealt to train and test within their label, round(test_size * groups) of each to test."""
    ranked = hash_ranked(group_labels(df, group, target, order), ["label"], group, seed)
    side = F.when(F.col("place") <= F.floor(F.col("size") * test_size + 0.5), "test").otherwise("train")
    return ranked.select(group, "label", side.alias("side"))


def with_side(df: DataFrame, sides: DataFrame, group: str) -> DataFrame:
    """The rows of df with their group's side; rows without a group are left out."""
    return df.join(sides.select(group, "side"), group)


def temporal_sides(df: DataFrame, group: str, date: str, test_size: float = 0.2) -> DataFrame:
    """df with `side`: train, test or dropped.

    The cutoff is the quantile 1 - test_size of the groups' first dates, linear between microseconds. A group that
    begins by the cutoff is in train with its rows up to it; its later rows are dropped. Null dates are errors.
    """
    checks.require_columns(df, [group, date])
    checks.ensure(checks.null_keys(df, [date]), "Null values in")
    first = df.groupBy(group).agg(F.min(date).alias("__first"))
    micros = F.unix_micros(F.col("__first").cast("timestamp"))
    cut = quantiles(first.select(F.lit("first").alias("variable"), micros.cast("double").alias("value")), {"first": first.count()}, [1.0 - test_size])["first"][0]
    cutoff = F.lit(None if cut is None else int(cut)).cast("long")
    sided = first.select(group, (micros <= cutoff).alias("__early"), F.timestamp_micros(cutoff).cast("timestamp_ntz").alias("__cutoff"))
    own = F.when(F.col("__early") & (F.col(date) <= F.col("__cutoff")), "train").when(F.col("__early"), "dropped").otherwise("test")
    return df.join(sided, group).withColumn("side", own).drop("__early", "__cutoff")


def split_statistics(df: DataFrame, group: str, target: str) -> DataFrame:
    """(side, n_rows, n_groups, n_positive, prevalence) of a table with sides."""
    positive = F.sum(F.col(target).cast("double"))
    return df.groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(group).alias("n_groups"), positive.cast("long").alias("n_positive"), F.avg(F.col(target).cast("double")).alias("prevalence"))


def shown_statistics(statistics: DataFrame) -> str:
    """split_statistics() as lines to print, shares in per cent."""
    lines = ["side      rows    groups  positive"]
    for r in statistics.orderBy("side").collect():
        share = "" if r.prevalence is None else f"{100 * r.prevalence:.2f} %"
        lines.append(f"{r.side or '':8}{r.n_rows:>6}{r.n_groups:>10}{share:>10}")
    return "\n".join(lines)


def validate_split(df: DataFrame, group: str, temporal_date: str | None = None, n_rows: int | None = None) -> None:
    """No group on both sides; all rows kept if n_rows is given; train strictly before test if a date is given."""
    train, test = df.filter("side = 'train'"), df.filter("side = 'test'")
    checks.ensure(checks.shared_groups(train, test, group), "Groups on both sides")
    if n_rows is not None and train.count() + test.count() != n_rows:
        raise ValueError("The split lost or repeated rows")
    if temporal_date is not None and not checks.has_order(train, test, temporal_date):
        raise ValueError("The training dates must be before the test dates")


def group_folds(df: DataFrame, group: str, target: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """(group, positives, fold): groups dealt in turn to folds 1.. within their number of positive rows, so that classes balance."""
    counts = df.groupBy(group).agg(F.sum(F.col(target).cast("long")).alias("positives"), F.count(F.lit(1)).alias("rows"))
    ranked = hash_ranked(counts, ["positives", "rows"], group, seed)
    shift = F.pmod(F.col("positives") * 3 + F.col("rows"), F.lit(folds))
    return ranked.select(group, "positives", (F.pmod(F.col("place") + shift, F.lit(folds)) + 1).cast("int").alias("fold"))

"""From a modelling table to splits, prepared features and cross-validated models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.values import lenient_timestamp
from ..operators import models, split
from ..operators.metrics import metric_summary
from ..operators.preprocess import IDENTIFIERS, TARGET, Preprocessor, feature_types
from ..sources.tables import train_test_pair, write_table


def split_table(df: DataFrame, kind: str = "random", group: str = "subject", target: str = TARGET, date: str = "admission_date") -> DataFrame:
    """df with `side`, validated."""
    dated = df.withColumn("__date", lenient_timestamp(F.col(date)))
    if kind == "random":
        sides = split.random_sides(dated, group, target, ["__date"])
        out = split.with_side(df, sides, group)
        split.validate_split(out, group, n_rows=df.filter(F.col(group).isNotNull()).count())
    elif kind == "temporal":
        out = split.temporal_sides(dated, group, "__date")
        split.validate_split(out, group, temporal_date="__date")
        out = out.drop("__date")
    else:
        raise ValueError("split is random or temporal")
    return out


def run_split(df: DataFrame, output: str, kind: str = "random") -> None:
    """Writes both sides of a split."""
    out = split_table(df, kind)
    for side in ("train", "test"):
        write_table(out.filter(F.col("side") == side).drop("side"), f"{output}/{side}_{kind}")


def run_preprocess(spark: SparkSession, folder: str, output: str, kind: str = "random") -> Preprocessor:
    """Fits the preparation on the training side, writes both prepared sides and the fitted parameters."""
    train, test = train_test_pair(spark, folder, kind)
    numeric, categorical, binary = feature_types(train.drop(TARGET, *IDENTIFIERS))
    ready = Preprocessor(numeric, categorical, binary).fit(train)
    columns = []
    for side, df in (("train", train), ("test", test)):
        path = f"{output}/{side}_{kind}"
        write_table(ready.transform(df, [*IDENTIFIERS, TARGET]), path)
        out = spark.read.parquet(path)
        if out.count() != df.count():
            raise ValueError(f"The prepared {side} side has other rows than its source")
        columns.append(out.columns)
    if columns[0] != columns[1]:
        raise ValueError("The prepared sides have other columns")
    ready.save(spark, f"{output}/preprocessor_{kind}")
    return ready


def run_models(spark: SparkSession, folder: str, output: str, kind: str = "random", chosen: dict = models.MODELS) -> DataFrame:
    """Cross-validates models on the training side, writes the folds' and the models' metrics and returns the latter."""
    train, _ = train_test_pair(spark, folder, kind)
    checks.require_enough_groups(train, TARGET, "subject", 5)
    folds = split.group_folds(train, "subject", TARGET)
    numeric, categorical, binary = feature_types(train.drop(TARGET, *IDENTIFIERS))
    results = models.cross_validated(train, folds, "subject", TARGET, lambda: Preprocessor(numeric, categorical, binary), chosen)
    write_table(results, f"{output}/cv_results_{kind}")
    write_table(metric_summary(results), f"{output}/cv_summary_{kind}")
    return metric_summary(results)

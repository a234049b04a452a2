"""Assembly of the analysis table from episodes, features and people."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import died_in_hospital
from ..operators.episodes import assembled


def after_surgery(df: DataFrame, flag: str = "surgery_before_infection") -> DataFrame:
    """Rows whose infection came after surgery."""
    return df.filter(F.col(flag) == 1)


def grouped_label(c: Column, groups: dict[str, str], other: str = "other") -> Column:
    """A label's group; labels without one are `other`, null stays null."""
    own = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])[c]
    return F.when(c.isNotNull(), F.coalesce(own, F.lit(other)))


def analysis_dataset(episodes: DataFrame, features: DataFrame, people: DataFrame, more: list[Callable[[DataFrame], DataFrame]] = []) -> DataFrame:
    """Episodes with features and people, further steps that add columns, and in-hospital mortality where the dates are there."""
    out = assembled(episodes, features, people, ["subject", "infection_id"], "subject")
    for step in more:
        out = step(out)
    if {"death_date", "discharge_date"} <= set(out.columns):
        out = out.withColumn("in_hospital_mortality", died_in_hospital(F.col("death_date"), F.col("discharge_date")))
    return out

"""Aggregate summaries of a modelling table, and a synthetic table from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.checks import require_columns
from ..operators import profile, synth
from ..sources.tables import summary_rows, write_table

#: The pairs of categories whose joint counts are published.
#: Fixed: chosen pairs of columns.
PAIRS = (("site", "organism_bug"), ("tfc", "prophylaxis_group"))
PARTS = ("dataset", "missingness", "continuous", "categorical")


def summarise(df: DataFrame, outcome: str, cluster: str, continuous: list[str], binary: list[str], categorical: list[str], pairs: tuple[tuple[str, str], ...] = PAIRS) -> dict[str, DataFrame]:
    """The six summary tables by name."""
    require_columns(df, [outcome, cluster, *continuous, *binary, *categorical])
    out = {
        "dataset": profile.dataset_summary(df, cluster, outcome),
        "continuous": profile.described(df, continuous),
        "categorical": profile.frequencies(df, [*binary, *categorical]),
        "missingness": profile.missingness(df),
        "dependencies": profile.dependencies(df, [*continuous, *binary]),
    }
    return out | ({"pairs": profile.pair_frequencies(df, list(pairs))} if pairs else {})


def write_summaries(summaries: dict[str, DataFrame], output: str) -> None:
    for name, df in summaries.items():
        write_table(df.coalesce(1), f"{output}/{name}", "csv")


def generate(spark: SparkSession, folder: str, coefficients: str, pairs: str | None = None, dependencies: str | None = None, **options) -> DataFrame:
    """A synthetic table from summary files in a folder; a path that is given must exist."""
    own = {name: summary_rows(spark, f"{folder}/{name}") for name in PARTS}
    own["coefficients"] = summary_rows(spark, coefficients)
    for name, path in (("pairs", pairs), ("dependencies", dependencies)):
        if path is not None:
            own[name] = summary_rows(spark, path)
    return synth.synthetic_table(spark, own, **options)

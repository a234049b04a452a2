"""Sources to one evidence table: common schema, imputed dates, union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import was_imputed
from ..sources import schemas


def standardised(df: DataFrame, source: str, names: dict[str, str], columns: dict[str, str] = schemas.EVIDENCE) -> DataFrame:
    """The common columns in order: renamed, with the source's name, null where the source has none."""
    renamed = df.withColumnsRenamed(names).withColumn("source", F.lit(source))
    return renamed.select(*[(F.col(c) if c in renamed.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])


def with_imputed_dates(df: DataFrame, dates: DataFrame, keys: list[str], date: str, fallback: str, flag: str) -> DataFrame:
    """df whose null dates are taken from a table of (keys, fallback), with a 0/1 flag where they were.

    Null keys match null keys. A key with several fallback dates gives a row for each of them.
    """
    other = dates.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(fallback).alias("__fallback")).distinct()
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(F.col(f"__{k}")) for k in keys])
    joined = df.join(other, same, "left")
    imputed = was_imputed(F.col(date), F.col("__fallback"))
    return joined.withColumns({flag: imputed, date: F.coalesce(date, "__fallback")}).select(*dict.fromkeys([*df.columns, flag]))


def combined(tables: list[DataFrame]) -> DataFrame:
    """All rows by column name, each once."""
    return reduce(DataFrame.unionByName, tables).distinct()

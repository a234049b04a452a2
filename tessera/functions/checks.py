"""Rules that a table must meet: violations are small aggregates, and ensure() raises on the driver."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Violations that a message shows.
SHOWN = 10


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    """Metadata only; no job."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"Missing required columns: {missing}")


def require_arrays(df: DataFrame, columns: Iterable[str]) -> None:
    if wrong := [c for c in columns if not isinstance(df.schema[c].dataType, T.ArrayType)]:
        raise TypeError(f"Columns must be arrays: {wrong}")


def ensure(violations: DataFrame, message: str) -> None:
    """Raises with the first violations in order, if there are any."""
    if found := violations.orderBy(*violations.columns).limit(SHOWN + 1).collect():
        shown = ", ".join(str(r[0] if len(r) == 1 else tuple(r)) for r in found[:SHOWN])
        raise ValueError(f"{message}: {shown}" + " and more" * (len(found) > SHOWN))


def bad_values(df: DataFrame, value: Column) -> DataFrame:
    """The different non-null values of an expression that marks violations."""
    return df.select(value.alias("value")).filter("value IS NOT NULL").distinct()


def null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The names of keys that are null somewhere, from one pass."""
    counts = df.agg(*[F.count(F.when(F.col(k).isNull(), 1)).alias(k) for k in keys])
    return counts.unpivot([], keys, "key", "nulls").filter("nulls > 0").select("key")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def varying_in_group(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Groups with more than one value, null counting as one."""
    different = F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))
    return df.groupBy(*keys).agg(different.alias("values")).filter("values > 1").select(*keys)


def unreviewed_overlaps(df: DataFrame, code: str, label: str, reviewed: dict[str, set[str]]) -> DataFrame:
    """Codes under several labels, unless these are exactly the reviewed ones."""
    labels = df.groupBy(code).agg(F.array_sort(F.collect_set(label)).alias("labels")).filter(F.size("labels") > 1)
    allowed = F.lit(False)
    for c, own in reviewed.items():
        allowed = allowed | ((F.col(code) == c) & (F.col("labels") == F.array(*map(F.lit, sorted(own)))))
    return labels.filter(~allowed)


def without_pairs(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows whose columns equal no row of a table of pairs; Spark broadcasts it if its size allows."""
    return df.join(pairs, pairs.columns, "left_anti")


def dropped_pairs(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pairs, rows): how many rows without_pairs() leaves out for each pair that it meets, to be told."""
    return df.join(pairs, pairs.columns, "left_semi").groupBy(*pairs.columns).agg(F.count(F.lit(1)).alias("rows"))


def name_problems(names: dict[str, DataFrame], label: str, codes: dict[str, str], expected: set[str]) -> list[str]:
    """Every problem of mapping tables against the expected labels: missing or unexpected labels, null and double codes."""
    problems, found = [], {}
    for title, df in names.items():
        own = {r[0] for r in df.select(label).distinct().collect()}
        if None in own:
            problems.append(f"{title} contains missing names")
        found[title] = own - {None}
        code = codes.get(title)
        if code in df.columns:
            if not df.filter(F.col(code).isNull() | (F.col(code) == "")).isEmpty():
                problems.append(f"{title} contains missing codes")
            doubled = sorted(tuple(r[:2]) for r in duplicate_keys(df, [label, code]).collect())
            if doubled:
                problems.append(f"{title} has duplicate rows {doubled}")
    for title, own in found.items():
        if expected - own:
            problems.append(f"{title} missing {sorted(expected - own)}")
        if own - expected:
            problems.append(f"{title} has unexpected {sorted(own - expected)}")
    for title, own in found.items():
        others = set().union(*(o for t, o in found.items() if t != title))
        if own - others:
            problems.append(f"only in {title} {sorted(own - others)}")
    return problems


def shared_groups(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """Groups on both sides."""
    return train.select(group).distinct().join(test.select(group), group, "left_semi")


def has_order(train: DataFrame, test: DataFrame, date: str) -> bool:
    """Whether all of train is before all of test, strictly."""
    last, first = train.agg(F.max(date)).first()[0], test.agg(F.min(date)).first()[0]
    return last is None or first is None or last < first


def require_binary(df: DataFrame, columns: list[str]) -> None:
    """Values must be 0, 1, true, false or null."""
    for c in columns:
        ensure(bad_values(df, F.when(~F.col(c).cast("string").isin("0", "1", "0.0", "1.0", "true", "false"), F.col(c).cast("string"))), f"Column {c} is not binary")


def require_enough_groups(df: DataFrame, target: str, group: str, folds: int) -> None:
    """A target of 0 and 1, no null group, and groups for every fold, in each class too."""
    ensure(null_keys(df, [target, group]), "Null values in")
    ensure(bad_values(df, F.when(~F.col(target).isin(0, 1), F.col(target))), "The target must be 0 or 1")
    counts = df.agg(F.count_distinct(group).alias("all"), *[F.count_distinct(F.when(F.col(target) == v, F.col(group))).alias(f"class {v}") for v in (0, 1)]).first().asDict()
    if few := {k: n for k, n in counts.items() if n < folds}:
        raise ValueError(f"Fewer than {folds} groups: {few}")


def counts_sum_to(df: DataFrame, keys: list[str], count: str, n: int) -> DataFrame:
    """Groups whose counts do not add up to n."""
    return df.groupBy(*keys).agg(F.sum(count).alias("total")).filter(F.col("total") != n)

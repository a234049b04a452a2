"""Aggregate summaries of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import with_missing_label
from ..sources.tables import stored
from .ranks import cut_points, quantiles

#: Fixed: the quantiles of a summary, with their columns.
QUANTILES = {"min": 0.0, "p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "max": 1.0}


def dataset_summary(df: DataFrame, cluster: str, outcome: str) -> DataFrame:
    """(metric, value): rows, columns, different clusters, repeated rows, and outcomes observed, positive and their share."""
    whole = df.agg(
        F.count(F.lit(1)).cast("double").alias("n_rows"),
        F.lit(float(len(df.columns))).alias("n_columns"),
        F.count_distinct(cluster).cast("double").alias("n_unique_patients"),
        F.count(outcome).cast("double").alias("n_outcome_observed"),
        F.sum(F.coalesce(F.col(outcome).cast("double"), F.lit(0.0))).alias("n_outcome_positive"),
    )
    different = df.distinct().agg(F.count(F.lit(1)).alias("different"))
    wide = whole.crossJoin(F.broadcast(different)).select(  # one row each
        "n_rows",
        "n_columns",
        "n_unique_patients",
        (F.col("n_rows") - F.col("different")).alias("n_duplicate_rows"),
        "n_outcome_observed",
        "n_outcome_positive",
        F.try_divide("n_outcome_positive", "n_outcome_observed").alias("outcome_prevalence"),
    )
    return wide.unpivot([], wide.columns, "metric", "value")


def adjusted_skewness(c: str) -> Column:
    """The bias-adjusted skewness, null for fewer than three values."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each number column: count, mean, std, quantiles, missing count and rate, adjusted skewness.

    One pass for the moments; the quantiles, exact, come from counts of ranges and the ranges that hold them.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    n, rows = F.count("value"), F.count(F.lit(1))
    told = long.groupBy("variable").agg(n.alias("n"), n.cast("double").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), (rows - n).alias("missing_count"), ((rows - n) / rows).alias("missing_rate"), adjusted_skewness("value").alias("skewness")).collect()
    points = quantiles(long, {r.variable: r.n for r in told}, list(QUANTILES.values()))
    kinds = ", ".join(["variable string", "count double", "mean double", "std double", *[f"{q} double" for q in QUANTILES], "missing_count long", "missing_rate double", "skewness double"])
    return df.sparkSession.createDataFrame([(r.variable, r["count"], r["mean"], r["std"], *points[r.variable], r.missing_count, r.missing_rate, r.skewness) for r in told], kinds)


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, category, count, proportion) over all columns, missing values under their label; one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), with_missing_label(F.col(c)).alias("category")) for c in columns])).alias("x")).select("x.*")
    return with_proportion(long.groupBy("variable", "category").count(), ["variable"])


def with_proportion(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts with their share within the keys."""
    total = counts.groupBy(*keys).agg(F.sum("count").alias("__total"))
    return counts.join(F.broadcast(total), keys).withColumn("proportion", F.col("count") / F.col("__total")).drop("__total")


def pair_frequencies(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(variable_1, variable_2, category_1, category_2, count, proportion) of chosen pairs of columns; one pass."""
    own = [F.struct(F.lit(a).alias("variable_1"), F.lit(b).alias("variable_2"), with_missing_label(F.col(a)).alias("category_1"), with_missing_label(F.col(b)).alias("category_2")) for a, b in pairs]
    long = df.select(F.explode(F.array(*own)).alias("x")).select("x.*")
    return with_proportion(long.groupBy("variable_1", "variable_2", "category_1", "category_2").count(), ["variable_1", "variable_2"])


def missingness(df: DataFrame) -> DataFrame:
    """(variable, dtype, missing_count, missing_rate) of every column, most missing first; one pass."""
    kinds = dict(df.dtypes)
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in df.columns])
    long = counts.unpivot("__rows", df.columns, "variable", "missing_count")
    dtype = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("variable")]
    return long.select("variable", dtype.alias("dtype"), "missing_count", F.try_divide("missing_count", "__rows").alias("missing_rate")).orderBy(F.desc("missing_rate"), "variable")


def with_missing_flags(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Number columns, and a 0/1 column __missing__x for each that has missing values."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]).first()
    lacking = [c for c in columns if counts[c]]
    out = df.select(*[F.col(c).cast("double").alias(c) for c in columns], *[F.col(c).isNull().cast("double").alias(f"__missing__{c}") for c in lacking])
    return out, out.columns


def view_ranks(df: DataFrame, columns: list[str], lacking: set[str]) -> tuple[DataFrame, dict[tuple[str, str | None], str]]:
    """(table, names): a row for each row of df with its centred average ranks, and their columns by view.

    A view (column, other) ranks a column among the rows that have it and the other column too; (column, None) is
    among all that have it. Rows are dealt by view and part; a part that is one value needs no order.
    """
    views = [(c, None) for c in columns] + [(c, o) for o in sorted(lacking) for c in columns if c != o]
    value = {c: F.col(c).cast("double") for c in columns}
    numbered = stored(df.select(F.monotonically_increasing_id().alias("__row"), *[e.alias(c) for c, e in value.items()]), "rows")
    cuts = cut_points(numbered, columns)
    parted = numbered.withColumns({f"__part_{k}": cuts[c].part(F.col(c)) for k, c in enumerate(columns)})
    own = []
    for k, (c, o) in enumerate(views):
        there = F.col(c).isNotNull() if o is None else F.col(c).isNotNull() & F.col(o).isNotNull()
        own.append(F.when(there, F.struct(F.lit(k).alias("view"), F.col(f"__part_{columns.index(c)}").alias("part"), F.col(c).alias("value"))))
    long = parted.select("__row", F.explode(F.array_compact(F.array(*own))).alias("x")).select("__row", "x.*")
    sizes = long.groupBy("view", "part").agg(F.count(F.lit(1)).alias("n"), (F.min("value") == F.max("value")).alias("single"))
    by = Window.partitionBy("view")
    before = F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = stored(sizes.select("view", "part", "n", "single", (before - (F.sum("n").over(by) + 1) / 2).alias("shift")), "sizes")
    told = long.join(F.broadcast(sizes), ["view", "part"])  # a row for each view and range
    single = told.filter("single").select("__row", "view", (F.col("shift") + (F.col("n") + 1) / 2).alias("rank"))
    within = Window.partitionBy("view", "part")
    ties = F.count(F.lit(1)).over(Window.partitionBy("view", "part", "value"))
    mixed = told.filter("NOT single").select("__row", "view", (F.col("shift") + F.rank().over(within.orderBy("value")) + (ties - 1) / 2).alias("rank"))
    names = {view: f"r{k}" for k, view in enumerate(views)}
    wide = single.unionByName(mixed).groupBy("__row").agg(*[F.max(F.when(F.col("view") == k, F.col("rank"))).alias(f"r{k}") for k in range(len(views))])
    return wide, names


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable_1, variable_2, rho) for each ordered pair: rank correlation over rows that have both, 0 if undefined, 1 with itself.

    Each column is ranked once, and once more for each other column that lacks values; pairs whose rows are the same
    share the ranks. Rows are brought together again by their number, and one aggregation gives the products of all pairs.
    """
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "variable_1 string, variable_2 string, rho double")
    if not pairs:
        return diagonal
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(c)).alias(c) for c in columns]).first()
    lacking = {c for c in columns if counts[c] < counts["__rows"]}
    wide, names = view_ranks(df, columns, lacking)

    def rank(c: str, other: str) -> Column:
        return F.col(names[c, other if other in lacking else None])

    sums = []
    for k, (a, b) in enumerate(pairs):
        x, y = rank(a, b), rank(b, a)
        both = x.isNotNull() & y.isNotNull()
        varies = (F.min(F.when(both, x)) < F.max(F.when(both, x))) & (F.min(F.when(both, y)) < F.max(F.when(both, y)))  # not left to rounding
        rho = F.sum(x * y) / F.sqrt(F.sum(F.when(both, x * x)) * F.sum(F.when(both, y * y)))
        sums.append(F.when(varies, rho).otherwise(0.0).alias(f"p{k}"))
    found = wide.agg(*sums).first()
    rows = [(a, b, found[f"p{k}"] or 0.0) for k, (a, b) in enumerate(pairs)]
    upper = df.sparkSession.createDataFrame([*rows, *[(b, a, rho) for a, b, rho in rows]], "variable_1 string, variable_2 string, rho double")
    return upper.unionByName(diagonal)


def dependencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """The square matrix of spearman() over columns and their missing flags: variable, and a column for each variable."""
    flagged, names = with_missing_flags(df, columns)
    return spearman(flagged, names).groupBy(F.col("variable_1").alias("variable")).pivot("variable_2", names).agg(F.first("rho"))

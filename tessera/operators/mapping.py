"""Codes to labels: prefix and exact joins with several labels, and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and bytes of a table that are broadcast at most.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint, if a count of its rows and of the bytes of their values shows that it is small."""
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in df.columns])
    told = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if told.n <= rows and told["size"] <= BROADCAST_BYTES else df


def labels_by_key(mapping: DataFrame, key: str, label: str, order: str | None = None) -> DataFrame:
    """(key, labels): each key once, with its different labels, by their first place in `order`, or by name without one."""
    if order is None:
        return mapping.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    firsts = mapping.groupBy(key, label).agg(F.min(order).alias("__at")).filter(F.col(label).isNotNull())
    own = F.array_sort(F.collect_list(F.struct("__at", label)))
    return firsts.groupBy(key).agg(F.transform(own, lambda x: x[label]).alias("labels"))


def exact_labels(codes: DataFrame, code: str, mapping: DataFrame, key: str, label: str, normal=lambda c: c, order: str | None = None) -> DataFrame:
    """(code, labels) for each different code that the map has; normal() brings codes and keys to one form."""
    lookup = labels_by_key(mapping.select(normal(F.col(key)).alias("__key"), label, *([order] if order else [])), "__key", label, order)
    different = codes.select(code).filter(F.col(code).isNotNull()).distinct()
    return different.withColumn("__key", normal(F.col(code))).join(small(lookup), "__key").select(code, "labels")


def prefix_labels(codes: DataFrame, code: str, mapping: DataFrame, prefix: str, label: str, order: str | None = None) -> DataFrame:
    """(code, labels) for each different code that starts with a prefix of the map, with the labels of all such prefixes.

    An equi-join on the code's prefixes of the lengths that the map has, not a comparison with every prefix.
    The lengths, at most as many as the longest prefix has characters, are read to the driver.
    """
    lengths = sorted(r[0] for r in mapping.select(F.length(prefix)).filter(F.col(prefix).isNotNull()).distinct().collect())
    different = codes.select(code).filter(F.col(code).isNotNull()).distinct()
    own = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(code)), lambda n: F.substring(F.col(code), F.lit(1), n))
    expanded = different.select(code, F.explode(own).alias("__key"))
    found = expanded.join(small(mapping.select(F.col(prefix).alias("__key"), label, *([order] if order else [])).distinct()), "__key")
    return labels_by_key(found, code, label, order)


def with_labels(df: DataFrame, code: str, labels: DataFrame, name: str) -> DataFrame:
    """df with the labels of its code in the array column `name`; empty without a match, never null."""
    own = labels.select(F.col(code).alias("__code"), F.col("labels").alias(name))
    joined = df.join(own, df[code] == F.col("__code"), "left").drop("__code")
    return joined.withColumn(name, no_null(F.col(name)))


def no_null(labels: Column) -> Column:
    return F.coalesce(labels, F.array().cast("array<string>"))


def as_labels(df: DataFrame, c: str) -> Column:
    """A column of labels or of single labels as an array; null is empty."""
    if df.schema[c].dataType.typeName() == "array":
        return no_null(F.col(c))
    return F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))


def conflict(first: Column, second: Column) -> Column:
    """1 if both have labels and none in common."""
    return ((F.size(first) > 0) & (F.size(second) > 0) & ~F.arrays_overlap(first, second)).cast("int")


def reconciled(first: Column, second: Column, third: Column) -> Column:
    """Both coded: their union, or nothing in conflict; one coded: that one; none: the third. Conflict blocks the third too."""
    both = (F.size(first) > 0) & (F.size(second) > 0)
    return (
        F.when(both & ~F.arrays_overlap(first, second), F.array().cast("array<string>"))
        .when(both, F.array_union(first, second))
        .when(F.size(first) > 0, F.array_distinct(first))
        .when(F.size(second) > 0, F.array_distinct(second))
        .otherwise(F.array_distinct(third))
    )


def map_evidence(evidence: DataFrame, icd: DataFrame, snomed: DataFrame, drugs: DataFrame) -> DataFrame:
    """Evidence with icd_comorbidity, snomed_comorbidity and medication_comorbidity, arrays of conditions.

    Each different code is mapped once, however often it occurs. Labels are in the order of the maps where they have
    a column source_row, else by name.
    """

    def order(mapping: DataFrame) -> str | None:
        return "source_row" if "source_row" in mapping.columns else None

    found = with_labels(evidence, "icd_code", prefix_labels(evidence, "icd_code", icd, "icd_code", "comorbidity", order(icd)), "icd_comorbidity")
    found = with_labels(found, "snomed_code", exact_labels(evidence, "snomed_code", snomed, "snomed_code", "comorbidity", F.trim, order(snomed)), "snomed_comorbidity")
    names = exact_labels(evidence, "medication_name", drugs, "medication_name", "comorbidity", lambda c: F.lower(F.trim(c)), order(drugs))
    return with_labels(found, "medication_name", names, "medication_comorbidity")


def reconcile(mapped: DataFrame) -> DataFrame:
    """Mapped evidence with coding_conflict and cci_condition."""
    i, s, m = (as_labels(mapped, f"{k}_comorbidity") for k in ("icd", "snomed", "medication"))
    return mapped.withColumns({"coding_conflict": conflict(i, s), "cci_condition": reconciled(i, s, m)})

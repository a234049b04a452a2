"""Cleaning of the three event sources and of the code lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, sctid, text
from ..functions.values import lenient_timestamp, mixed_timestamp
from ..operators.mapping import small
from ..sources import schemas


def clean_diagnoses(df: DataFrame) -> DataFrame:
    """Codes and descriptions cleaned, dates read, then repeated rows dropped; extra columns pass through."""
    df = text.normalised_headers(df, strip=False)
    checks.require_columns(df, ["diagnosis_date", "diagnosis_code_icd", "diagnosis_code_snomed", "diagnosis_desc_icd", "diagnosis_desc_snomed"])
    return df.withColumns(
        {
            "diagnosis_date": lenient_timestamp(F.col("diagnosis_date")),
            "diagnosis_code_icd": text.clean_icd(F.col("diagnosis_code_icd")),
            **{c: text.clean_code(F.col(c)) for c in ("diagnosis_code_snomed", "diagnosis_desc_icd", "diagnosis_desc_snomed")},
        }
    ).distinct()


def clean_problems(df: DataFrame) -> DataFrame:
    """Texts cleaned, dates read; rows with neither code nor description go, then repeated rows; a null subject is an error."""
    df = text.normalised_headers(df)
    checks.require_columns(df, schemas.PROBLEMS)
    df = df.withColumns({c: text.optional_text(F.col(c)) for c in ("subject", "problem_code", "problem_desc")})
    df = df.withColumn("problem_dt_tm", lenient_timestamp(F.col("problem_dt_tm")))
    checks.ensure(checks.null_keys(df, ["subject"]), "Null values in")
    return df.dropna("all", subset=["problem_code", "problem_desc"]).distinct()


def clean_prescriptions(df: DataFrame) -> DataFrame:
    """Texts collapsed and in lower case, flags and dates read, rows without drug and class dropped, then repeated rows.

    Flags that are neither yes, no nor missing and null subjects are errors. A date that is none becomes null;
    undated() counts those.
    """
    df = text.normalised_headers(df)
    checks.require_columns(df, schemas.PRESCRIPTIONS)
    flags = ("admission_medicine_y_n", "gp_to_continue")
    for c in flags:
        checks.ensure(checks.bad_values(df, text.unreadable_yes_no(F.col(c))), f"Unexpected values in {c}")
    df = df.withColumns(
        {
            "subject": text.collapsed_text(F.col("subject")),
            **{c: text.collapsed_text(F.col(c), lower=True) for c in ("medication_name_short", "therapeutical_class")},
            **{c: text.yes_no(F.col(c)) for c in flags},
            "order_dt_tm": mixed_timestamp(text.collapsed_text(F.col("order_dt_tm"))),
        }
    )
    checks.ensure(checks.null_keys(df, ["subject"]), "Null values in")
    return df.dropna("all", subset=["medication_name_short", "therapeutical_class"]).distinct()


def undated(df: DataFrame, date: str = "order_dt_tm") -> DataFrame:
    """One row with n_rows and n_undated, the rows whose date is missing or was none."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(date).isNull()).alias("n_undated"))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a given order, by aggregation: what is kept does not depend on partitions."""
    others = [c for c in df.columns if c not in order]
    least = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(F.struct(*order, *others)).alias("__row"))
    return least.select(*[F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def icd_map(raw: DataFrame) -> DataFrame:
    """(comorbidity, icd_code, weight) from rows (category, icd10_codes, weights), the codes a list divided by |.

    The category Age is left out. Unknown categories, bad lists and several weights of a condition are errors.
    Of repeated pairs the smallest weight stays, which is the only one.
    """
    rows = raw.filter("category <> 'Age'").withColumn("comorbidity", text.mapped(F.col("category"), schemas.LABELS))
    checks.ensure(checks.bad_values(rows, F.when(F.col("comorbidity").isNull(), F.col("category"))), "Categories that no label names")
    checks.ensure(checks.varying_in_group(rows, ["comorbidity"], "weights"), "Conditions with several weights")
    checks.ensure(checks.bad_values(rows, text.icd_prefix_error(F.col("icd10_codes"))), "Prefix lists that cannot be read")
    out = rows.select("comorbidity", F.explode(text.icd_prefixes(F.col("icd10_codes"))).alias("icd_code"), F.col("weights").cast("int").alias("weight"))
    return out.groupBy("comorbidity", "icd_code").agg(F.min("weight").alias("weight"))


def snomed_map(raw: DataFrame, repair: bool = True) -> tuple[DataFrame, DataFrame]:
    """(map, repairs): (comorbidity, snomed_code), and (source_code, cleaned_code, concept_id, concept_name, source_row) of audited repairs.

    raw has Comorbid Condition, Concept Code, Concept ID and Concept Name, and may have source_row, which repairs
    and messages then tell. Conditions that no label names, codes that fail the audit (the first are shown), nameless
    or doubly named concepts and overlaps that nobody reviewed are errors.
    """
    spark = raw.sparkSession
    rows = raw.select(
        text.mapped(F.col("`Comorbid Condition`"), schemas.LABELS).alias("comorbidity"),
        F.col("`Comorbid Condition`").alias("label"),
        text.stripped(F.col("`Concept Code`")).alias("source_code"),
        text.stripped(F.col("`Concept ID`").cast("string")).alias("concept_id"),
        text.stripped(F.col("`Concept Name`")).alias("concept_name"),
        (F.col("source_row") if "source_row" in raw.columns else F.lit(None)).cast("long").alias("source_row"),
    )
    checks.ensure(checks.bad_values(rows, F.when(F.col("comorbidity").isNull(), F.coalesce("label", F.lit("(none)")))), "Concepts under unknown conditions")
    audited = spark.createDataFrame(schemas.SNOMED_REPAIRS if repair else [], "source_code string, repair_concept string, repaired string")
    rows = rows.join(small(audited), "source_code", "left")
    rows = rows.withColumn("found", sctid.cleaned(F.col("source_code"), F.col("concept_id"), F.col("repaired"), F.col("repair_concept")))
    where = F.when(F.col("source_row").isNotNull(), F.format_string("at row %d: ", "source_row")).otherwise("")
    checks.ensure(checks.bad_values(rows, F.concat(where, F.col("found.error"))), "Concept codes that fail the audit")
    rows = rows.withColumn("snomed_code", F.col("found.code"))
    excluded = spark.createDataFrame(schemas.EXCLUDED_SNOMED, "comorbidity string, snomed_code string")
    kept = checks.without_pairs(rows, excluded)
    checks.ensure(checks.bad_values(kept, F.when(F.coalesce("concept_name", F.lit("")) == "", F.col("snomed_code"))), "Concepts without a name")
    checks.ensure(checks.varying_in_group(kept, ["comorbidity", "snomed_code"], "concept_name"), "Concepts with several names")
    out = first_by(kept.select("comorbidity", "snomed_code", "source_row"), ["comorbidity", "snomed_code"], ["source_row"]).drop("source_row")
    checks.ensure(checks.unreviewed_overlaps(out, "snomed_code", "comorbidity", schemas.REVIEWED_SNOMED), "Concepts under several conditions that nobody reviewed")
    repairs = rows.filter("source_code <> snomed_code").select("source_code", F.col("snomed_code").alias("cleaned_code"), "concept_id", "concept_name", "source_row")
    return out, repairs


def medication_map(spark: SparkSession, drugs: dict[str, list[str]] = schemas.DRUGS) -> DataFrame:
    """(comorbidity, medication_name) in order; a drug of several conditions is an error."""
    rows = [(c, d) for c, own in drugs.items() for d in own]
    out = spark.createDataFrame(rows, "comorbidity string, medication_name string").withColumn("medication_name", F.lower(text.stripped(F.col("medication_name"))))
    checks.ensure(checks.duplicate_keys(out, ["medication_name"]), "Drugs under several conditions")
    return out.orderBy("comorbidity", "medication_name")


def validate_maps(icd: DataFrame, snomed: DataFrame) -> None:
    """Both maps name every expected condition, no other, and no code twice."""
    problems = checks.name_problems({"ICD-10": icd, "SNOMED CT": snomed}, "comorbidity", {"ICD-10": "icd_code", "SNOMED CT": "snomed_code"}, set(schemas.CONDITIONS))
    if problems:
        raise ValueError("The code maps do not agree: " + "; ".join(problems))

"""From source tables to one row of condition flags and a score for each episode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import cleaning
from ..operators.episodes import episode_flags, scored
from ..operators.evidence import combined, standardised, with_imputed_dates
from ..operators.mapping import map_evidence, reconcile
from ..sources import schemas, tables


def evidence_table(diagnoses: DataFrame, problems: DataFrame, prescriptions: DataFrame, episodes: DataFrame, exclude_index_spell: bool = False) -> DataFrame:
    """Cleaned sources in the common schema; undated diagnoses get the admission date of their spell.

    Such dates are those of an index admission itself, so that its codes count as history; exclude_index_spell
    leaves them out.
    """
    own = {name: standardised(df, name, schemas.SOURCE_COLUMNS[name]) for name, df in (("diagnoses", diagnoses), ("problems", problems), ("prescriptions", prescriptions))}
    own["diagnoses"] = with_imputed_dates(own["diagnoses"], episodes, ["subject", "spell_id"], "comorbidity_date", "admission_date", "event_date_imputed")
    if exclude_index_spell:
        own["diagnoses"] = own["diagnoses"].filter("event_date_imputed = 0")
    return combined(list(own.values()))


def comorbidity_features(diagnoses: DataFrame, problems: DataFrame, prescriptions: DataFrame, episodes: DataFrame, icd: DataFrame, snomed: DataFrame, drugs: DataFrame, exclude_index_spell: bool = False) -> DataFrame:
    """(subject, infection_id, flags, cci_score) from cleaned sources."""
    mapped = reconcile(map_evidence(evidence_table(diagnoses, problems, prescriptions, episodes, exclude_index_spell), icd, snomed, drugs))
    return scored(episode_flags(mapped, episodes))


def run(spark: SparkSession, paths: dict[str, str], output: str) -> DataFrame:
    """Reads the bundle of sources, cleans it, writes the features and returns them as read back."""
    own = tables.bundle(spark, paths, ("diagnoses", "problems", "prescriptions", "infection_eps", "icd_map", "snomed_map", "medication_map"))
    out = comorbidity_features(
        cleaning.clean_diagnoses(own["diagnoses"]),
        cleaning.clean_problems(own["problems"]),
        cleaning.clean_prescriptions(own["prescriptions"]),
        own["infection_eps"],
        own["icd_map"],
        own["snomed_map"],
        own["medication_map"],
    )
    tables.write_table(out, output)
    return spark.read.parquet(output)


def build_maps(spark: SparkSession, icd_path: str, snomed_path: str, output: str) -> None:
    """Builds the three code maps and writes them, all or none."""
    icd = cleaning.icd_map(tables.csv_text(spark, icd_path))
    snomed, repairs = cleaning.snomed_map(tables.workbook(spark, snomed_path, ["Concept Code"]))
    drugs = cleaning.medication_map(spark)
    tables.write_all(
        {"icd": (icd, f"{output}/icd_map"), "snomed": (snomed, f"{output}/snomed_map"), "repairs": (repairs, f"{output}/snomed_repairs"), "drugs": (drugs, f"{output}/medication_map")},
        [lambda: cleaning.validate_maps(icd, snomed)],
        "csv",
    )

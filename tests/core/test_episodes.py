"""The small golden example, and the rules of cleaning and aggregation one by one."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import cleaning, episodes, evidence
from tessera.plans import comorbidity, dataset
from tessera.sources import schemas, tables

from .test_mapping import ICD

SNOMED = [("diabetes_without_complication", "44054006"), ("congestive_heart_failure", "84114007"), ("chronic_pulmonary_disease", "13645005"), ("diabetes_with_complication", "427571000"), ("cerebrovascular_disease", "230690007")]
DIAGNOSES = [
    ("P001", "S001", None, "e11.9", None),
    ("P001", "S002", None, "I50.9", None),
    ("P001", "S003", "2022-03-15", "N17.9", None),
    ("P002", "S010", None, "J44.9", None),
    ("P003", "S020", None, "E11.9", None),
    ("P003", "S021", "2020-06-01", "I63.9", " 230690007 "),
    ("P003", "S022", "2024-01-08", "C78.7", None),
    ("P004", "S029", None, "E11.2", None),
    ("P005", "S040", None, "K70.4", None),
]
PROBLEMS = [("P001", "84114007", "x", "2020-08-12"), ("P001", "44054006", "x", "2019-02-01"), ("P002", "13645005", "x", "2020-01-01"), ("P004", "427571000", "x", "2022-11-10"), ("P005", "38341003", "x", "2020-01-01"), ("P005", None, " ", "2020-01-01")]
PRESCRIPTIONS = [("P002", " Salbutamol ", "respiratory agents", "2020-02-01", "Y", "no"), ("P002", "salbutamol", "Respiratory  Agents", "2020-02-01", "yes", "N"), ("P004", None, "none", "2020-02-01", "Y", "no")]
EPISODES = [("P001", "INF001", "S100", "2022-03-10"), ("P002", "INF002", "S101", "2023-06-01"), ("P003", "INF003", "S020", "2021-05-01"), ("P003", "INF004", "S102", "2024-01-01"), ("P004", "INF005", "S103", "2023-09-10"), ("P005", "INF006", "S040", "2025-02-01")]


def sources(spark):
    diagnoses = spark.createDataFrame([(*r, None, None) for r in DIAGNOSES], ", ".join(f"{c.upper()} string" for c in schemas.DIAGNOSES))
    problems = spark.createDataFrame(PROBLEMS, ", ".join(f"{c} string" for c in schemas.PROBLEMS))
    prescriptions = spark.createDataFrame(PRESCRIPTIONS, ", ".join(f"{c} string" for c in schemas.PRESCRIPTIONS))
    eps = spark.createDataFrame(EPISODES, "subject string, infection_id string, spell_id string, admission_date string").withColumn("admission_date", F.col("admission_date").cast("timestamp_ntz"))
    return diagnoses, problems, prescriptions, eps


def maps(spark):
    icd = spark.createDataFrame(ICD, "comorbidity string, icd_code string, weight int")
    return icd, spark.createDataFrame(SNOMED, "comorbidity string, snomed_code string"), cleaning.medication_map(spark)


GOLDEN = {
    "INF001": ({"congestive_heart_failure", "diabetes_without_complication"}, 2),
    "INF002": ({"chronic_pulmonary_disease"}, 1),
    "INF003": ({"cerebrovascular_disease", "diabetes_without_complication"}, 2),
    "INF004": ({"cerebrovascular_disease", "diabetes_without_complication"}, 2),
    "INF005": ({"diabetes_with_complication"}, 2),
    "INF006": ({"moderate_or_severe_liver_disease"}, 3),
}


def test_golden_features(spark):
    diagnoses, problems, prescriptions, eps = sources(spark)
    out = comorbidity.comorbidity_features(cleaning.clean_diagnoses(diagnoses), cleaning.clean_problems(problems), cleaning.clean_prescriptions(prescriptions), eps, *maps(spark))
    assert out.columns == ["subject", "infection_id", *schemas.CONDITIONS, "cci_score"]
    assert {r.infection_id: ({c for c in schemas.CONDITIONS if r[c]}, r.cci_score) for r in out.collect()} == GOLDEN


def test_golden_files(spark, tmp_path):
    """The same from CSV files through the plan that reads and writes."""
    diagnoses, problems, prescriptions, eps = sources(spark)
    icd, snomed, drugs = maps(spark)
    paths = {}
    for name, df in {"diagnoses": diagnoses, "problems": problems, "prescriptions": prescriptions, "infection_eps": eps.withColumn("first_culture_dt", F.lit("2020-01-01 10:00:00")), "icd_map": icd, "snomed_map": snomed, "medication_map": drugs}.items():
        paths[name] = f"{tmp_path}/{name}"
        tables.write_table(df, paths[name], "csv")
    out = comorbidity.run(spark, paths, f"{tmp_path}/features")
    assert {r.infection_id: ({c for c in schemas.CONDITIONS if r[c]}, r.cci_score) for r in out.collect()} == GOLDEN
    with pytest.raises(FileNotFoundError, match="problems"):
        comorbidity.run(spark, paths | {"problems": f"{tmp_path}/none"}, f"{tmp_path}/x")


def test_cleaning_rules(spark):
    diagnoses, problems, prescriptions, _ = sources(spark)
    assert cleaning.clean_problems(problems).count() == 5
    cleaned = cleaning.clean_prescriptions(prescriptions)
    assert [(r.subject, r.medication_name_short, r.admission_medicine_y_n, r.gp_to_continue) for r in cleaned.collect()] == [("P002", "salbutamol", True, False)]
    with pytest.raises(ValueError, match="perhaps"):
        cleaning.clean_prescriptions(prescriptions.withColumn("gp_to_continue", F.lit("perhaps")))
    soon = cleaning.clean_prescriptions(prescriptions.withColumn("order_dt_tm", F.lit("soon")))
    assert soon.filter("order_dt_tm IS NULL").count() == soon.count() > 0 and tuple(cleaning.undated(soon).first()) == (soon.count(), soon.count())
    for clean, rows in ((cleaning.clean_problems, problems), (cleaning.clean_diagnoses, diagnoses), (cleaning.clean_prescriptions, prescriptions)):
        assert clean(rows.union(rows)).count() == clean(rows).count()
    with pytest.raises(ValueError, match="subject"):
        cleaning.clean_problems(problems.withColumn("subject", F.lit(" ")))
    with pytest.raises(ValueError, match="problem_code"):
        cleaning.clean_problems(problems.drop("problem_code"))
    extra = cleaning.clean_diagnoses(diagnoses.withColumn("MORE", F.lit(1)))
    assert "more" in extra.columns and extra.filter("diagnosis_code_icd = 'E119'").count() == 2


def test_flags_count_only_what_was_known(spark):
    day = lambda d: dt.datetime(2020, 1, d)
    rows = [("P1", ["dementia", "malignancy"], day(1)), ("P1", ["renal_disease"], day(9)), ("P2", [], day(1)), ("P2", ["dementia"], None), (None, ["dementia"], day(1)), ("P1", ["other"], day(1))]
    df = spark.createDataFrame(rows, "subject string, cci_condition array<string>, comorbidity_date timestamp_ntz")
    eps = spark.createDataFrame([("P1", "a", day(1)), ("P1", "b", day(9)), ("P2", "c", day(9)), ("P3", "d", day(9))], "subject string, infection_id string, admission_date timestamp_ntz")
    got = {r.infection_id: {c for c in schemas.CONDITIONS if r[c]} for r in episodes.episode_flags(df, eps).collect()}
    assert got == {"a": {"dementia", "malignancy"}, "b": {"dementia", "malignancy", "renal_disease"}, "c": set(), "d": set()}
    single = df.filter(F.size("cci_condition") == 1).select("subject", F.col("cci_condition")[0].alias("cci_condition"), "comorbidity_date")
    assert episodes.episode_flags(single, eps).filter("renal_disease = 1").count() == 1
    with pytest.raises(ValueError, match="duplicate keys"):
        episodes.episode_flags(df, eps.union(eps.limit(1)))
    with pytest.raises(ValueError, match="admission_date"):
        episodes.episode_flags(df, eps.withColumn("admission_date", F.lit(None).cast("timestamp_ntz")))


def test_score_suppresses_the_milder_condition(spark):
    row = {c: 1 for c in schemas.CONDITIONS}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} int" for c in row))
    out = episodes.scored(df).first()
    assert out.cci_score == sum(schemas.WEIGHTS.values()) - 1 - 1 - 2 and out.malignancy == 1


def test_imputed_dates_match_null_keys(spark):
    df = spark.createDataFrame([("P", None, None), ("P", "s", None), ("P", "s", "2020-01-01")], "subject string, spell_id string, d string")
    dates = spark.createDataFrame([("P", None, "2021-01-01"), ("P", "t", "2022-01-01"), ("P", None, "2021-01-01")], "subject string, spell_id string, a string")
    got = evidence.with_imputed_dates(df, dates, ["subject", "spell_id"], "d", "a", "imputed").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("P", None, "2021-01-01", 1), ("P", "s", None, 0), ("P", "s", "2020-01-01", 0)], key=str)


def test_assembly(spark):
    eps = spark.createDataFrame([("a", "1", 1), ("b", "2", 0)], "subject string, infection_id string, surgery_before_infection int")
    features = spark.createDataFrame([("a", "1", 3)], "subject string, infection_id string, score int")
    people = spark.createDataFrame([("a", "2020-01-01", "2020-01-02"), ("b", None, "2020-01-02")], "subject string, death_date string, discharge_date string")
    out = dataset.analysis_dataset(eps, features, people)
    assert {r.infection_id: (r.score, r.in_hospital_mortality) for r in out.collect()} == {"1": (3, 1), "2": (None, 0)}
    assert dataset.after_surgery(out).count() == 1


def test_lookback(spark):
    eps = spark.createDataFrame([("a", "1", dt.datetime(2020, 4, 1)), ("b", "2", dt.datetime(2020, 4, 1))], "subject string, e string, at timestamp_ntz")
    events = spark.createDataFrame([("a", dt.datetime(2020, 3, 1)), ("b", dt.datetime(2020, 4, 1)), ("b", dt.datetime(2019, 4, 1)), ("a", None)], "subject string, seen timestamp_ntz")
    got = {r.e: r.exposed for r in episodes.lookback_exposure(eps, events, "subject", "e", "at", "seen", 90).collect()}
    assert got == {"1": 1, "2": 0}

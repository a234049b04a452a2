import pytest
from pyspark.sql import functions as F

from tessera.functions import sctid
from tessera.operators import cleaning, mapping
from tessera.sources import schemas

ICD = [("diabetes_without_complication", "E11", 1), ("congestive_heart_failure", "I50", 1), ("cerebrovascular_disease", "I6", 1), ("chronic_pulmonary_disease", "J4", 1), ("metastatic_solid_tumor", "C78", 6), ("moderate_or_severe_liver_disease", "K704", 3)]


def test_identifiers(spark):
    codes = ["22298006", "22298007", "1.0", "022298006", None, "44054006", "713571008"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert [r[0] for r in df.select(sctid.is_valid(F.col("c"))).collect()] == [True, False, False, False, False, True, True]
    body = spark.createDataFrame([("2229800",), ("",), ("12a",)], "c string")
    assert [r[0] for r in body.select(sctid.check_digit(F.col("c"))).collect()] == ["6", None, None]
    repaired = [(r[2], r[2][:-1]) for r in schemas.SNOMED_REPAIRS]
    df = spark.createDataFrame(repaired, "c string, body string")
    assert df.filter(~sctid.is_valid(F.col("c")) | (F.concat("body", sctid.check_digit(F.col("body"))) != F.col("c"))).isEmpty()


def snomed_source(spark, rows):
    return spark.createDataFrame(rows, "`Comorbid Condition` string, `Concept Code` string, `Concept ID` string, `Concept Name` string")


def test_snomed_map(spark):
    rows = [
        ("Dementia", " 22298006 ", "1", "a"),
        ("Dementia", "22298006", "1", "a"),
        ("Dementia", "713571008", "2", "left out"),
        ("Congestive heart failure", "194781004", "3", "both"),
        ("Renal disease", "194781004", "3", "both"),
        ("Renal disease", "12237231000119100", "36712807", "repaired"),
    ]
    found, repairs = cleaning.snomed_map(snomed_source(spark, rows))
    assert sorted(map(tuple, found.collect())) == [("congestive_heart_failure", "194781004"), ("dementia", "22298006"), ("renal_disease", "12237231000119107"), ("renal_disease", "194781004")]
    assert [tuple(r) for r in repairs.collect()] == [("12237231000119100", "12237231000119107", "36712807", "repaired", None)]


@pytest.mark.parametrize(
    "row,said",
    [
        (("Dementia", "22298007", "1", "a"), "check digit"),
        (("Dementia", "12237231000119100", "1", "a"), "requires concept"),
        (("Dementia", None, "1", "a"), "missing"),
        (("Dementia", "22298.0", "1", "a"), "6 to 18 digits"),
        (("Nothing", "22298006", "1", "a"), "unknown conditions"),
        (("Dementia", "22298006", "1", " "), "without a name"),
        (("Dementia", "194781004", "1", "a"), "nobody reviewed"),
    ],
)
def test_snomed_errors(spark, row, said):
    rows = [row] + ([("Renal disease", "194781004", "1", "a")] if said == "nobody reviewed" else [])
    with pytest.raises(ValueError, match=said):
        cleaning.snomed_map(snomed_source(spark, rows))


def test_repairs_can_be_switched_off(spark):
    with pytest.raises(ValueError, match="check digit"):
        cleaning.snomed_map(snomed_source(spark, [("Dementia", "12237231000119100", "36712807", "a")]), repair=False)


def test_icd_map(spark):
    raw = spark.createDataFrame([("Age", "x", "1"), ("Dementia", " f00 | F01.1|f00", "1"), ("AIDS/HIV", "B20", "6")], "category string, icd10_codes string, weights string")
    assert sorted(map(tuple, cleaning.icd_map(raw).collect())) == [("aids_hiv", "B20", 6), ("dementia", "F00", 1), ("dementia", "F011", 1)]
    for bad, said in ((("Dementia", "F02", "2"), "weights"), (("Other", "F02", "1"), "no label"), (("Dementia", "F02|", "1"), "Prefix")):
        with pytest.raises(ValueError, match=said):
            cleaning.icd_map(raw.union(spark.createDataFrame([bad], raw.schema)))


def test_medication_map(spark):
    rows = cleaning.medication_map(spark).collect()
    assert len(rows) == 20 and rows[0].medication_name == "aclidinium"
    with pytest.raises(ValueError):
        cleaning.medication_map(spark, {"a": ["x"], "b": ["X "]})


def test_validate_maps(spark):
    icd = spark.createDataFrame([(c, f"A{k}", 1) for k, c in enumerate(schemas.CONDITIONS)], "comorbidity string, icd_code string, weight int")
    snomed = icd.select("comorbidity", F.col("icd_code").alias("snomed_code"))
    cleaning.validate_maps(icd, snomed)
    with pytest.raises(ValueError, match="missing"):
        cleaning.validate_maps(icd, snomed.filter("comorbidity <> 'dementia'"))
    with pytest.raises(ValueError, match="duplicate"):
        cleaning.validate_maps(icd.union(icd.limit(1)), snomed)


def test_evidence_is_mapped(spark):
    icd = spark.createDataFrame([*ICD, ("malignancy", "C", 2)], "comorbidity string, icd_code string, weight int")
    snomed = spark.createDataFrame([("congestive_heart_failure", "194781004"), ("renal_disease", "194781004")], "comorbidity string, snomed_code string")
    rows = [("E119", None, None), (None, " 194781004 ", None), (None, None, " Tiotropium "), ("N179", "1", "aspirin"), ("C787", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "icd_code string, snomed_code string, medication_name string")
    got = {tuple(r)[:3]: tuple(map(tuple, tuple(r)[3:])) for r in mapping.map_evidence(df, icd, snomed, cleaning.medication_map(spark)).collect()}
    assert [got[r] for r in rows] == [
        (("diabetes_without_complication",), (), ()),
        ((), ("congestive_heart_failure", "renal_disease"), ()),
        ((), (), ("chronic_pulmonary_disease",)),
        ((), (), ()),
        (("malignancy", "metastatic_solid_tumor"), (), ()),
        ((), (), ()),
    ]


def test_reconcile(spark):
    rows = [(["a"], ["a", "b"], ["m"]), (["a"], [], ["m"]), ([], ["b"], []), (["a"], ["b"], ["m"]), ([], [], ["m"]), ([], [], [])]
    df = spark.createDataFrame(rows, "icd_comorbidity array<string>, snomed_comorbidity array<string>, medication_comorbidity array<string>")
    got = mapping.reconcile(df).select("coding_conflict", "cci_condition").collect()
    assert [(r[0], r[1]) for r in got] == [(0, ["a", "b"]), (0, ["a"]), (0, ["b"]), (1, []), (0, ["m"]), (0, [])]


def test_source_rows_are_told(spark):
    """Messages and repairs name the row of the sheet; labels keep the order of the map where it has one."""
    raw = snomed_source(spark, [("Dementia", "22298006", "1", "a"), ("Dementia", "22298007", "1", "b")]).withColumn("source_row", F.when(F.col("Concept Code") == "22298007", 3).otherwise(2))
    with pytest.raises(ValueError, match="at row 3: .*check digit"):
        cleaning.snomed_map(raw)
    _, repairs = cleaning.snomed_map(snomed_source(spark, [("Dementia", "12237231000119100", "36712807", "a")]).withColumn("source_row", F.lit(2)))
    assert [r.source_row for r in repairs.collect()] == [2]
    codes = spark.createDataFrame([("k",), ("kk",), (None,)], "code string")
    own = spark.createDataFrame([("k", "z", 1), ("k", "a", 2), ("k", "z", 3), ("kk", "b", 4)], "key string, label string, source_row int")
    assert {r.code: r.labels for r in mapping.exact_labels(codes, "code", own, "key", "label", order="source_row").collect()} == {"k": ["z", "a"], "kk": ["b"]}
    assert {r.code: r.labels for r in mapping.prefix_labels(codes, "code", own, "key", "label", "source_row").collect()} == {"k": ["z", "a"], "kk": ["z", "a", "b"]}
    assert {r.code: r.labels for r in mapping.exact_labels(codes, "code", own, "key", "label").collect()} == {"k": ["a", "z"], "kk": ["b"]}


def test_first_rows(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z"), (None, 4, None)], "k string, at int, v string")
    assert sorted(map(tuple, cleaning.first_by(rows, ["k"], ["at"]).collect()), key=str) == [("a", 1, "y"), (None, 4, None)]

import pytest
from pyspark.sql import functions as F

from tessera.operators import split
from tessera.plans import cli, comorbidity
from tessera.sources import tables

from .test_episodes import EPISODES, sources


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,n,day,note\n0001234567890123456,1,2020-01-02,"a ""b"",\nc"\n0002,x,none,NA\n')
    text = tables.csv_text(spark, f"{tmp_path}/t.csv", ["note", "id"], multiline=True)
    assert [tuple(r) for r in text.collect()] == [('a "b",\nc', "0001234567890123456"), (None, "0002")]
    typed = tables.csv_typed(spark, f"{tmp_path}/t.csv", "id string, n int, day timestamp_ntz", multiline=True).collect()
    assert [(r.n, str(r.day)) for r in typed] == [(1, "2020-01-02 00:00:00"), (None, "None")]
    assert tables.csv_inferred(spark, f"{tmp_path}/t.csv", multiline=True).count() == 2
    sheet = tables.workbook(spark, f"{tmp_path}/t.csv")
    assert sheet.columns == ["id", "n", "day", "note", "source_row"] and sorted((r.source_row, r.id) for r in sheet.collect()) == [(2, "0001234567890123456"), (3, "0002")]
    with pytest.raises(ValueError, match="other"):
        tables.csv_text(spark, f"{tmp_path}/t.csv", ["other"])


def test_summary_rows(spark, tmp_path):
    (tmp_path / "s.csv").write_text("metric,value\nn_rows,3\nx,\n")
    (tmp_path / "empty.csv").write_text("metric,value\n")
    assert tables.summary_rows(spark, f"{tmp_path}/s.csv") == [{"metric": "n_rows", "value": "3"}, {"metric": "x", "value": ""}]
    with pytest.raises(ValueError, match="No rows"):
        tables.summary_rows(spark, f"{tmp_path}/empty.csv")
    with pytest.raises(FileNotFoundError):
        tables.summary_rows(spark, f"{tmp_path}/none.csv")


def test_config(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("paths:\n  a: data/a.csv\n  b: s3a://x/b\n")
    assert tables.config_paths(f"{tmp_path}/c.yaml") == {"a": f"{tmp_path}/data/a.csv", "b": "s3a://x/b"}
    (tmp_path / "d.yaml").write_text("paths: [a]\n")
    with pytest.raises(ValueError):
        tables.config_paths(f"{tmp_path}/d.yaml")


def test_all_tables_are_written_or_none(spark, tmp_path):
    df = spark.range(3)

    def fails():
        raise ValueError("no")

    with pytest.raises(ValueError):
        tables.write_all({"a": (df, f"{tmp_path}/a")}, [fails])
    assert not (tmp_path / "a").exists()
    tables.write_all({"a": (df, f"{tmp_path}/a"), "b": (df, f"{tmp_path}/b")}, [lambda: None])
    assert spark.read.parquet(f"{tmp_path}/b").count() == 3


def test_pair_of_sides(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "esbl_status int, x int").write.parquet(f"{tmp_path}/train_random")
    spark.createDataFrame([(2, 1)], "x int, esbl_status int").write.parquet(f"{tmp_path}/test_random")
    train, test = tables.train_test_pair(spark, str(tmp_path))
    assert train.columns == test.columns
    with pytest.raises(ValueError):
        tables.train_test_pair(spark, str(tmp_path), "other")
    with pytest.raises(ValueError, match="target"):
        tables.train_test_pair(spark, str(tmp_path), target="target")


def test_extract(spark):
    source = spark.createDataFrame([("a", "Respiratory Agents"), ("a", "x"), ("b", "none")], "subject string, therapeutical_class string")
    cohort = spark.createDataFrame([("a",), ("a",)], "subject string")
    assert tables.cohort_extract(source, cohort).count() == 2
    from tessera.sources.schemas import THERAPEUTIC_CLASSES

    assert tables.cohort_extract(source, cohort, classes=("therapeutical_class", THERAPEUTIC_CLASSES)).count() == 1


def test_split_rules(spark):
    both = spark.createDataFrame([("a", "train", 1), ("a", "test", 2), ("b", "train", 1)], "g string, side string, day int")
    with pytest.raises(ValueError, match="both sides"):
        split.validate_split(both, "g")
    apart = both.filter("NOT (g = 'a' AND side = 'train')")
    split.validate_split(apart, "g", "day", 2)
    with pytest.raises(ValueError, match="lost"):
        split.validate_split(apart, "g", n_rows=3)
    with pytest.raises(ValueError, match="before"):
        split.validate_split(apart.withColumn("day", F.lit(1)), "g", "day")
    with pytest.raises(ValueError, match="day"):
        split.temporal_sides(both.withColumn("day", F.lit(None).cast("timestamp_ntz")), "g", "day")


def test_index_spell_can_be_left_out(spark):
    diagnoses, problems, prescriptions, eps = (df.toDF(*[c.lower() for c in df.columns]) for df in sources(spark))
    whole = comorbidity.evidence_table(diagnoses, problems, prescriptions, eps)
    assert whole.filter("event_date_imputed = 1").count() == 2
    assert comorbidity.evidence_table(diagnoses, problems, prescriptions, eps, True).filter("event_date_imputed = 1").count() == 0
    assert len(EPISODES) == eps.count()


def test_command_line():
    told = cli.parser().parse_args(["generate", "--summaries", "s", "--coefficients", "c", "--output", "o"])
    assert (told.seed, told.start, told.end, told.pairs) == (2026, "2015-01-01", "2025-09-01", None)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["split", "t", "o", "--kind", "other"])


def test_pair_of_csv_files(spark, tmp_path):
    (tmp_path / "train_random.csv").write_text("esbl_status,x\n1,2\n")
    (tmp_path / "test_random.csv").write_text("x,esbl_status\n2,0\n")
    train, test = tables.train_test_pair(spark, str(tmp_path))
    assert train.columns == test.columns == ["esbl_status", "x"] and (train.first().esbl_status, test.first().x) == (1, 2)

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import ranks, synth
from tessera.plans import catalog
from tessera.streaming import first


def test_joint_cells_are_exact(spark):
    rows = [{"a": "x", "b": "__MISSING__", "count": "3"}, {"a": "y", "b": "q", "count": "2"}]
    got = synth.exact_sample(spark, rows, ["a", "b"], ["u", "v"], 5, 1).collect()
    assert sorted(r.row_id for r in got) == [0, 1, 2, 3, 4]
    assert sorted(((r.u, r.v) for r in got), key=str) == sorted([("x", None)] * 3 + [("y", "q")] * 2, key=str)
    with pytest.raises(ValueError, match="add up to"):
        synth.exact_sample(spark, rows, ["a", "b"], ["u", "v"], 6, 1)


@pytest.mark.parametrize("long", [True, False])
def test_dependencies_keep_margins(spark, long):
    rng = np.random.default_rng(4)
    values = [(k, float(rng.normal()), float(rng.integers(0, 9)) if k % 5 else None) for k in range(500)]
    df = spark.createDataFrame(values, "row_id long, x double, y double")
    square = [{"variable": a, **{b: str(1.0 if a == b else 0.8) for b in ("x", "y")}} for a in ("x", "y")]
    cells = [{"variable_1": a, "variable_2": b, "correlation": str(1.0 if a == b else 0.8)} for a in ("x", "y") for b in ("x", "y")]
    names, matrix = synth.correlation_matrix(cells if long else square, {"x", "y"})
    flagged = [*names, "__missing__y"]
    wide = np.eye(3)
    wide[:2, :2] = matrix
    got = synth.with_dependencies(df, flagged, wide, 3).toPandas()
    assert sorted(got.x) == sorted(v[1] for v in values)
    assert sorted(got.y.dropna()) == sorted(v[2] for v in values if v[2] is not None) and got.y.isna().sum() == 100
    assert got[["x", "y"]].corr().iloc[0, 1] > 0.7


def test_no_missing_values_move_nothing_out(spark):
    df = spark.createDataFrame([(k, float(k), float(k)) for k in range(50)], "row_id long, x double, y double")
    got = synth.with_dependencies(df, ["x", "y", "__missing__y"], np.eye(3), 3).toPandas()
    assert got.y.notna().all()


def test_model_terms():
    rows = [{"variable": "", "coefficient": "1"}, {"variable": "const", "coefficient": "2"}, {"variable": "x", "coefficient": "3"}]
    assert synth.model_terms(rows) == (2.0, {"x": 3.0})
    for bad in (rows[:2], rows[2:], [*rows, {"variable": "Intercept", "coefficient": "1"}], [{"variable": "x"}]):
        with pytest.raises(ValueError):
            synth.model_terms(bad)
    with pytest.raises(ValueError, match="No column"):
        synth.linear_predictor(0.0, {"q": 1.0}, ["x"], {}, "y")
    with pytest.raises(ValueError, match="predict itself"):
        synth.linear_predictor(0.0, {"y": 1.0}, ["x", "y"], {}, "y")


def test_correlation_factor():
    noisy = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    rows = synth.correlation_factor(noisy)
    fixed = rows @ rows.T
    assert np.allclose(np.diag(fixed), 1) and np.linalg.eigvalsh(fixed).min() > -1e-9
    valid = np.array([[1, 0.5, 0.2], [0.5, 1, -0.3], [0.2, -0.3, 1]])
    rows = synth.correlation_factor(valid)
    assert np.allclose(rows @ rows.T, valid)


def test_subjects(spark):
    rows = spark.range(50).withColumnRenamed("id", "row_id")
    got = [r.subject for r in synth.subjects(rows, 20, 50, 1).collect()]
    assert len(got) == 50 and set(got) == {f"SYN-P{k:06d}" for k in range(1, 21)}
    with pytest.raises(ValueError):
        synth.subjects(rows, 51, 50, 1)


def test_ids_beyond_their_digits_stay_different(spark):
    """Above 999,999 subjects and 9,999,999 rows the numbers are longer than the padding."""
    numbers = spark.createDataFrame([(k,) for k in (1, 999_999, 1_000_000, 1_000_001, 10_000_000, 10_000_001)], "n long")
    got = [r.id for r in numbers.orderBy("n").select(text.whole_id("SYN-P", F.col("n"), 6).alias("id")).collect()]
    assert got == ["SYN-P000001", "SYN-P999999", "SYN-P1000000", "SYN-P1000001", "SYN-P10000000", "SYN-P10000001"]
    rows = spark.range(1_000_020).withColumnRenamed("id", "row_id")
    assert synth.subjects(rows, 1_000_010, 1_000_020, 1).agg(F.count_distinct("subject")).first()[0] == 1_000_010


def test_bounds_and_even_ranks(spark, monkeypatch):
    """Places are exact for heavy values, far outliers and few rows a step; ranks follow the order."""
    monkeypatch.setattr(ranks, "STEP_ROWS", 5)
    monkeypatch.setattr(ranks, "STEPS", 4)
    rng = np.random.default_rng(1)
    rows = [(k, [float(rng.normal()), 2.0, 1e12 * (k % 7 == 0)][k % 3]) for k in range(300)]
    df = spark.createDataFrame(rows, "row_id long, x double")
    want = sorted((x, k) for k, x in rows)
    assert ranks.bounds(df, "x", "row_id", [1, 2, 77, 150, 299, 300]) == {p: want[p - 1] for p in (1, 2, 77, 150, 299, 300)}
    got = ranks.ranked_evenly(df, 1 / (1 + F.exp(-F.col("x"))), ["x", "row_id"]).collect()
    assert {r.place: (r.x, r.row_id) for r in got} == dict(enumerate(want, 1)) and {r.size for r in got} == {300}


def test_categories_by_bounds_are_exact(spark):
    counts = [{"category": "a", "count": "30"}, {"category": "__MISSING__", "count": "50"}, {"category": "none", "count": "0"}, {"category": "b", "count": "20"}]
    rows = spark.range(100).withColumnRenamed("id", "row_id")
    got = rows.select(*synth.category_columns(rows, counts, ["category"], ["c"], 5)).groupBy("c").count().collect()
    assert {r.c: r["count"] for r in got} == {"a": 30, None: 50, "b": 20}


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([("u", "a", "2020-01-01 00:00:01"), ("u", "a", "2020-01-01 00:00:00"), ("v", "b", "2020-01-01 01:00:00"), (None, "b", "2020-01-01 01:00:00")], "user string, kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    own = first.stream(spark, f"{tmp_path}/in", events.schema, 1)
    for name, df, mode in (("seen", first.first_seen(own, "user", "kind", "ts"), "complete"), ("counted", first.windowed_counts(own, "ts", ["kind"], "10 minutes", "1 day"), "update")):
        run = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        run.processAllAvailable()
        run.stop()
    assert sorted((r.user, r.kind, str(r.first_date)) for r in spark.table("seen").collect()) == [("u", "a", "2020-01-01 00:00:00"), ("v", "b", "2020-01-01 01:00:00")]
    assert spark.table("counted").groupBy("kind").agg(F.max("n")).count() == 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_query_describes_the_whole_table(spark):
    """As many rows as lineitem has, with the counts of its categories and nulls."""
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("lacks", F.col("l_partkey") % 9 == 0)
    got = catalog.QUERIES["q50_synth_dataset"](spark, "/root/testdata/sf0.001").withColumn("lacks", F.col("l_extendedprice").isNull())
    for c in ("l_returnflag", "l_linestatus", "lacks"):
        assert sorted(map(tuple, got.groupBy(c).count().collect())) == sorted(map(tuple, lines.groupBy(c).count().collect()))

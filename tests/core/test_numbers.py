"""Profiles, splits, metrics, preparation and models against plain computations."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics, models, preprocess, profile, ranks, split
from tessera.operators.preprocess import Imputer, Preprocessor, feature_types, features_and_target
from tessera.plans import modelling, summaries


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    n = 300
    x = rng.normal(size=n)
    df = pd.DataFrame({"subject": [f"P{k}" for k in rng.integers(0, 120, n)], "infection_id": [f"I{k}" for k in range(n)], "x": x, "y": 2 * x + rng.normal(size=n) * 0.1, "z": rng.integers(0, 6, n).astype(float)})
    df["admission_date"] = [str(dt.date(2020, 1, 1) + dt.timedelta(days=int(k))) for k in rng.integers(0, 900, n)]
    df["site"] = rng.choice(["a", "b", "rare"], n, p=[0.5, 0.49, 0.01])
    df["gender"] = rng.integers(0, 2, n).astype(float)
    df["esbl_status"] = (x + rng.normal(size=n) > 0.4).astype(int)
    df.loc[rng.choice(n, 60, False), "y"] = np.nan
    df.loc[rng.choice(n, 30, False), "z"] = np.nan
    df.loc[rng.choice(n, 10, False), "gender"] = np.nan
    return df


@pytest.fixture(scope="module")
def rows(spark, table):
    return spark.createDataFrame(table.astype(object).where(table.notna(), None), "subject string, infection_id string, x double, y double, z double, admission_date string, site string, gender double, esbl_status int").cache()


def test_described(rows, table):
    got = {r.variable: r for r in profile.described(rows, ["x", "y", "z"]).collect()}
    for c in "xyz":
        v = table[c]
        for name, want in {"count": v.count(), "mean": v.mean(), "std": v.std(), "skewness": v.skew(), "missing_count": v.isna().sum(), "missing_rate": v.isna().mean(), **{k: v.quantile(q) for k, q in profile.QUANTILES.items()}}.items():
            assert got[c][name] == pytest.approx(want), (c, name)


def test_few_values_have_no_skewness(spark):
    assert profile.described(spark.createDataFrame([(1.0,), (2.0,)], "x double"), ["x"]).first().skewness is None


def test_dependencies(rows, table):
    got = {r.variable: r.asDict() for r in profile.dependencies(rows, ["x", "y", "z"]).collect()}
    flagged = table[["x", "y", "z"]].assign(**{f"__missing__{c}": table[c].isna().astype(int) for c in "yz"})
    want = flagged.corr(method="spearman").fillna(0)
    for a in want:
        for b in want:
            assert got[a][b] == pytest.approx(1.0 if a == b else want.loc[a, b], abs=1e-9)


def test_constant_columns_have_no_correlation(spark):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("x"), F.lit(0.1).alias("y"))
    got = {(r.variable_1, r.variable_2): r.rho for r in profile.spearman(df, ["x", "y"]).collect()}
    assert got == {("x", "y"): 0.0, ("y", "x"): 0.0, ("x", "x"): 1.0, ("y", "y"): 1.0}


def test_frequencies_and_summary(rows, table):
    got = {(r.variable, r.category): (r["count"], r.proportion) for r in profile.frequencies(rows, ["site", "gender"]).collect()}
    assert got["gender", "__MISSING__"] == (10, 10 / 300) and got["site", "a"][0] == (table.site == "a").sum()
    pairs = profile.pair_frequencies(rows, [("site", "gender")]).collect()
    assert sum(r["count"] for r in pairs) == 300
    metrics_ = {r.metric: r.value for r in profile.dataset_summary(rows.union(rows.limit(1)), "subject", "esbl_status").collect()}
    assert metrics_["n_rows"] == 301 and metrics_["n_duplicate_rows"] == 1 and metrics_["n_unique_patients"] == table.subject.nunique()
    assert [r.variable for r in profile.missingness(rows).limit(3).collect()] == ["y", "z", "gender"]


def test_ranks(spark):
    rng = random.Random(1)
    values = [(rng.randint(0, 50) / 7, k) for k in range(500)]
    got = {r.k: (r.place, r.size) for r in ranks.ranked(spark.createDataFrame(values, "v double, k int"), "v", "k").collect()}
    assert got == {k: (i + 1, 500) for i, (_, k) in enumerate(sorted(values))}
    assert ranks.ranked(spark.createDataFrame([], "v double, k int"), "v", "k").count() == 0


@pytest.mark.parametrize("kind", ["random", "temporal"])
def test_splits_keep_groups_together(spark, rows, table, tmp_path, kind):
    out = modelling.split_table(rows, kind).toPandas()
    sides = out[out.side != "dropped"].groupby("subject").side.nunique()
    assert sides.max() == 1
    if kind == "random":
        assert len(out) == 300
        first = table.sort_values("admission_date", kind="stable").groupby("subject").esbl_status.first()
        test = set(out[out.side == "test"].subject)
        assert abs(len(test) - 0.2 * table.subject.nunique()) <= 2
        assert abs(first[list(test)].mean() - first.mean()) < 0.05
    else:
        first = pd.to_datetime(table.admission_date).groupby(table.subject).min()
        cut = first.quantile(0.8)
        own = pd.to_datetime(out.admission_date)
        begins = out.subject.map(first)
        assert ((out.side == "train") == ((begins <= cut) & (own <= cut))).all() and ((out.side == "test") == (begins > cut)).all()
    with pytest.raises(ValueError):
        modelling.split_table(rows, "other")


def test_folds_balance_classes(rows, table):
    folds = split.group_folds(rows, "subject", "esbl_status").toPandas().set_index("subject").fold
    assert len(folds) == table.subject.nunique() and set(folds) == {1, 2, 3, 4, 5}
    share = table.groupby(table.subject.map(folds)).esbl_status.mean()
    assert share.max() - share.min() < 0.25


def auroc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)


def test_ranking_metrics(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 20, 200).astype(float)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    got = metrics.ranking(df, "y", "s").first()
    assert got.auroc == pytest.approx(auroc(y, s))
    steps = [((s >= t) & (y == 1)).sum() for t in sorted(set(s), reverse=True)]
    precision = [((s >= t) & (y == 1)).sum() / (s >= t).sum() for t in sorted(set(s), reverse=True)]
    assert got.average_precision == pytest.approx(sum(p * d for p, d in zip(precision, np.diff([0, *steps]))) / y.sum())
    by = metrics.ranking(df.withColumn("g", F.col("y") * 0), "y", "s", ["g"]).first()
    assert by.auroc == got.auroc
    assert metrics.ranking(df.filter("y = 1"), "y", "s").first().auroc is None
    table = metrics.confusion(df, "y", "s", [10.0]).first()
    assert table.tp == ((s >= 10) & (y == 1)).sum() and table.sensitivity == pytest.approx(table.tp / y.sum())
    assert metrics.calibration(df.withColumn("s", F.col("s") / 20), "y", "s").agg(F.sum("n")).first()[0] == 200


def test_imputer_finds_the_line(rows, table):
    own = Imputer(["x", "y", "z"]).fit(rows)
    assert set(own.lacking) == {"y", "z"}
    got = own.with_steps(rows).select("infection_id", *[e.alias(c) for c, e in own.imputed().items()]).toPandas().set_index("infection_id")
    want = table.set_index("infection_id")
    missing = want.y.isna()
    assert np.allclose(got.y[~missing], want.y[~missing])
    assert np.abs(got.y[missing] - 2 * want.x[missing]).max() < 0.2
    assert got.notna().all().all()


def by_rows(x, rounds=10):
    """The imputer row by row: each round fits each incomplete column on the rows that have it."""
    lacks = np.isnan(x)
    x = np.where(lacks, np.nanmean(x, axis=0), x)
    order = sorted(np.flatnonzero(lacks.any(axis=0)), key=lambda j: lacks[:, j].sum())
    for _ in range(rounds):
        for j in order:
            own, others = ~lacks[:, j], [i for i in range(x.shape[1]) if i != j]
            a, b = x[own][:, others], x[own, j]
            middle, mean = a.mean(axis=0), b.mean()
            a, b = a - middle, b - mean
            noise, weight, before = 1 / b.var(), 1.0, np.zeros(len(others))
            for _ in range(300):
                beta = np.linalg.solve(a.T @ a + weight / noise * np.eye(len(others)), a.T @ b)
                s = np.linalg.eigvalsh(a.T @ a)
                effective = (noise * s / (weight + noise * s)).sum()
                weight = (effective + 2e-6) / (beta @ beta + 2e-6)
                noise = (len(b) - effective + 2e-6) / (((b - a @ beta) ** 2).sum() + 2e-6)
                if np.abs(beta - before).sum() < 1e-3:
                    break
                before = beta
            beta = np.linalg.solve(a.T @ a + weight / noise * np.eye(len(others)), a.T @ b)
            x[lacks[:, j], j] = (x[lacks[:, j]][:, others] - middle) @ beta + mean
    return x


@pytest.mark.parametrize("patterns", [64, 0])
def test_imputer_by_rows(spark, monkeypatch, patterns):
    """The same values as by rows, whether patterns have expressions of their own or go through the steps."""
    monkeypatch.setattr(preprocess, "PATTERNS", patterns)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + [1, 2, 3, 4]
    x[rng.random((200, 4)) < 0.15] = np.nan
    x[:, 0] = np.where(np.isnan(x[:, 0]), 1.0, x[:, 0])
    df = spark.createDataFrame([(k, *(None if np.isnan(v) else float(v) for v in r)) for k, r in enumerate(x)], "k int, a double, b double, c double, d double")
    own = Imputer(["a", "b", "c", "d"]).fit(df)
    got = own.with_steps(df).select("k", *[e.alias(c) for c, e in own.imputed().items()]).orderBy("k").toPandas()[["a", "b", "c", "d"]].to_numpy()
    assert np.allclose(got, by_rows(x), atol=1e-6)


def test_patterns_that_training_rows_do_not_have(spark):
    """They go through the fitted steps, and are not just means."""
    rows = [(float(k), 2.0 * k, 3.0 * k) for k in range(40)] + [(50.0, None, 150.0), (60.0, 120.0, None)]
    own = Imputer(["a", "b", "c"]).fit(spark.createDataFrame(rows, "a double, b double, c double"))
    new = spark.createDataFrame([(30.0, None, None)], "a double, b double, c double")
    got = own.with_steps(new).select(*[e.alias(c) for c, e in own.imputed().items()]).first()
    assert abs(got.b - 60) < 8 and abs(got.c - 90) < 12


def test_preprocessor(spark, rows, table, tmp_path):
    features, target = features_and_target(rows)
    assert target.columns == ["esbl_status"]
    numeric, categorical, binary = feature_types(features)
    assert (numeric, categorical, binary) == (["x", "y", "z"], ["site"], ["gender"])
    ready = Preprocessor(numeric, categorical, binary).fit(rows)
    out = ready.transform(rows, ["infection_id"]).toPandas().set_index("infection_id")
    assert list(out.columns) == ["num__x", "num__y", "num__z", "num__missingindicator_y", "num__missingindicator_z", "cat__site_a", "cat__site_b", "cat__site_infrequent", "bin__gender", "bin__missingindicator_gender"]
    numbers = out[[c for c in out if c.startswith("num__")]]
    assert np.allclose(numbers.mean(), 0, atol=1e-9) and np.allclose(numbers.std(ddof=0), 1)
    assert (out.cat__site_a.to_numpy() == (table.site == "a").to_numpy()).all()
    mode = table.gender.mode()[0]
    assert (out.bin__gender[table.gender.isna().to_numpy()] == mode).all()
    ready.save(spark, f"{tmp_path}/fitted")
    again = Preprocessor.load(spark, f"{tmp_path}/fitted").transform(rows, ["infection_id"]).toPandas().set_index("infection_id")
    pd.testing.assert_frame_equal(out, again)
    unseen = ready.transform(rows.withColumn("site", F.lit("new"))).agg(F.min("cat__site_infrequent")).first()[0]
    assert unseen == 1


def test_binary_columns_hold_two_values(spark):
    with pytest.raises(ValueError, match="gender"):
        feature_types(spark.createDataFrame([(0,), (1,), (2,)], "gender int"))
    assert feature_types(spark.createDataFrame([(True, "a")], "flag boolean, s string")) == ([], ["s"], ["flag"])


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "k int, v array<double>")
    got = models.nearest(df, df, "k", "v", 4).collect()
    far = np.sqrt(((v[:, None] - v) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    assert {(r.query, r.place): r.neighbour for r in got} == {(i, p + 1): int(j) for i in range(60) for p, j in enumerate(np.argsort(far[i])[:4])}


def test_repeated_training_rows_vote_each(spark):
    """Ten positives and a negative at one point are eleven votes, of which five count with the point's share; nearer points count first."""
    train = spark.createDataFrame([(0.0, 1)] * 10 + [(0.0, 0)] + [(5.0, 0)] * 2 + [(6.0, 1)] * 9 + [(50.0, 0)] * 7, "x double, y int")
    got = {r.x: r.score for r in models.neighbour_score(train, "y", ["x"])(spark.createDataFrame([(0.0,), (5.0,), (5.0,), (49.0,)], "x double")).collect()}
    assert got == {0.0: pytest.approx(10 / 11), 5.0: pytest.approx(3 / 5), 49.0: 0.0}


def test_modelling_plan(spark, rows, tmp_path):
    """Split, preparation and cross-validation through files; informed models beat the prior."""
    modelling.run_split(rows, f"{tmp_path}/splits")
    modelling.run_preprocess(spark, f"{tmp_path}/splits", f"{tmp_path}/ready")
    assert spark.read.parquet(f"{tmp_path}/ready/train_random").count() + spark.read.parquet(f"{tmp_path}/ready/test_random").count() == 300
    chosen = {k: models.MODELS[k] for k in ("Dummy", "Logistic L2")}
    out = {r.model: r for r in modelling.run_models(spark, f"{tmp_path}/splits", f"{tmp_path}/models", chosen=chosen).collect()}
    assert out["Dummy"].roc_auc_mean == 0.5 and out["Logistic L2"].roc_auc_mean > 0.7
    assert spark.read.parquet(f"{tmp_path}/models/cv_results_random").count() == 10


@pytest.mark.parametrize("name", ["Logistic L1", "Logistic elastic net", "Decision tree", "k-NN", "SVM (linear substitute)"])
def test_models_rank_rows(rows, name):
    whole = rows.filter("y IS NOT NULL").select("x", "y", "esbl_status").cache()
    score = models.MODELS[name](whole, "esbl_status", ["x", "y"])
    assert models.quality(score(whole), "esbl_status")["roc_auc"] > (0.95 if name == "Decision tree" else 0.6)


def test_boosted_trees_take_all_rounds(rows, monkeypatch):
    """As many rounds as the library that they stand for, and the thresholds of the other trees."""
    told, make = {}, models.GBTClassifier

    def recorded(**parameters):
        told.update(parameters)
        return make(**parameters | {"maxIter": 2})

    monkeypatch.setattr(models, "GBTClassifier", recorded)
    whole = rows.filter("y IS NOT NULL").select("x", "y", "esbl_status")
    score = models.MODELS["Boosted trees (substitute)"](whole, "esbl_status", ["x", "y"])
    assert score(whole).count() == whole.count() and (told["maxIter"], told["maxBins"]) == (100, models.BINS)


def test_summaries_and_synthesis(spark, rows, table, tmp_path):
    """A table is summarised, made again from its summaries and keeps its counts, nulls, quantiles and rank dependencies."""
    own = rows.withColumns({"gender": F.col("gender").cast("int"), "ward": F.when(F.col("z") > 3, "north").otherwise("south west")})
    tables_ = summaries.summarise(own, "esbl_status", "subject", ["x", "y", "z"], ["gender"], ["site", "ward"], (("site", "ward"),))
    summaries.write_summaries(tables_, f"{tmp_path}/s")
    spark.createDataFrame([("", "9"), ("const", "-0.5"), ("x", "1.5"), ("site__a", "0.3")], "variable string, coefficient string").write.option("header", True).csv(f"{tmp_path}/c")
    made = summaries.generate(spark, f"{tmp_path}/s", f"{tmp_path}/c", f"{tmp_path}/s/pairs", f"{tmp_path}/s/dependencies", seed=5).toPandas()
    assert len(made) == 300 and made.esbl_status.sum() == table.esbl_status.sum() and made.subject.nunique() == table.subject.nunique()
    real, fake = (pd.crosstab(d.site, d.ward) for d in (own.toPandas(), made))
    assert (real.to_numpy() == fake.to_numpy()).all()
    for c in "xyz":
        assert made[c].isna().sum() == table[c].isna().sum()
        assert made[c].median() == pytest.approx(table[c].median(), abs=0.15)
    assert made[["x", "y"]].corr(method="spearman").iloc[0, 1] > 0.85
    assert auroc(made.esbl_status.to_numpy(), made.x.to_numpy()) > 0.65
    with pytest.raises(FileNotFoundError):
        summaries.generate(spark, f"{tmp_path}/s", f"{tmp_path}/c", f"{tmp_path}/none")


def test_order_statistics_of_hot_and_large_parts(spark, monkeypatch):
    """Exact quantiles, whatever fills a range, though no part may have more than a few rows in one task."""
    monkeypatch.setattr(ranks, "RANGE_ROWS", 5)
    rng = np.random.default_rng(3)
    values = {"few": rng.integers(0, 3, 900).astype(float), "many": rng.normal(size=900), "hot": np.where(rng.random(900) < 0.6, 7.0, rng.normal(size=900) + 7)}
    long = spark.createDataFrame([(k, float(v)) for k, own in values.items() for v in own] + [("none", None)], "variable string, value double")
    shares = [0.0, 0.05, 0.25, 0.5, 0.777, 1.0]
    got = ranks.quantiles(long, {**{k: 900 for k in values}, "none": 0}, shares)
    for k, own in values.items():
        assert np.allclose(got[k], np.quantile(own, shares))
    assert got["none"] == [None] * 6


def test_ranks_of_few_values(spark):
    """A column of two values is dealt over ranges of the tie."""
    rows = spark.createDataFrame([(k, k % 2) for k in range(1000)], "k long, v int")
    got = {r.k: r.place for r in ranks.ranked(rows, "v", "k").collect()}
    assert got == {k: (k // 2 + 1) + 500 * (k % 2) for k in range(1000)}


def test_range_of_many_cuts(spark):
    cuts = [float(k * k) for k in range(500)]
    got = spark.range(2000).select("id", ranks.range_of(F.col("id").cast("double"), cuts).alias("r")).collect()
    assert all(r.r == sum(c < r.id for c in cuts) for r in got)


def test_shown_statistics(spark):
    df = spark.createDataFrame([("train", 1, 1), ("train", 2, 0), ("test", 3, 1)], "side string, g int, y int")
    assert split.shown_statistics(split.split_statistics(df, "g", "y")).splitlines()[2].split() == ["train", "2", "2", "50.00", "%"]

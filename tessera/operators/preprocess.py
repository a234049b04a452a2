"""Feature preparation: fitted on training rows, applied to any rows, as column expressions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import checks
from ..functions.text import MISSING_LABEL

#: Fixed: columns of the modelling table that are 0/1 though stored as numbers.
BINARY = ("gender", "past_abx", "hospital_exposure_90d", "any_healthcare_exposure_90d", "asthma", "cancer", "copd", "hypertension", "ischaemic_heart_disease", "type2_diabetes", "prior_positive_esbl")
#: Fixed: identifiers and outcome of the modelling table.
IDENTIFIERS, TARGET = ("subject", "infection_id", "admission_date"), "esbl_status"
#: Rounds of the imputer; patterns of missing values up to which each has an expression of its own.
ROUNDS, PATTERNS = 10, 64
#: The column of values that went through the imputer's steps.
STEPPED = "__stepped"
#: Fixed: rounds and least change of the search for the largest evidence, and the parameters of its gamma priors.
EVIDENCE_ROUNDS, EVIDENCE_CHANGE, PRIOR = 300, 1e-3, 1e-6


def features_and_target(df: DataFrame, target: str = TARGET, identifiers: tuple[str, ...] = IDENTIFIERS) -> tuple[DataFrame, DataFrame]:
    """(features, target) as tables; identifiers that are not there are an error."""
    checks.require_columns(df, [target, *identifiers])
    return df.drop(target, *identifiers), df.select(target)


def feature_types(df: DataFrame, binary: tuple[str, ...] = BINARY) -> tuple[list[str], list[str], list[str]]:
    """(numeric, categorical, binary) columns by type; the named ones and booleans are binary and must hold 0 and 1 only."""
    flags = [f.name for f in df.schema if f.name in binary or isinstance(f.dataType, T.BooleanType)]
    checks.require_binary(df, flags)
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in flags]
    categorical = [f.name for f in df.schema if f.name not in numeric and f.name not in flags]
    return numeric, categorical, flags


def population_scale(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, population standard deviation) of each column; 1 for a deviation of 0."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def scaled(c: str, mean: float, deviation: float) -> Column:
    return (F.col(c).cast("double") - mean) / deviation


def frequent_categories(df: DataFrame, columns: list[str], least: int) -> dict[str, tuple[list[str], bool]]:
    """(categories with at least so many rows, in order; whether there are rarer ones) for each column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LABEL)).alias("category")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("variable", "category").count()
    rare = counts.groupBy("variable").agg(F.max((F.col("count") < least).cast("int")).alias("rare"), F.array_sort(F.collect_list(F.when(F.col("count") >= least, F.col("category")))).alias("own"))
    return {r.variable: (list(r.own), bool(r.rare)) for r in rare.collect()}


def one_hot(c: str, categories: list[str], rare: bool) -> dict[str, Column]:
    """A 0/1 column for each category, and one for rarer and unknown ones if the training rows had rarer ones."""
    own = F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LABEL))
    out = {f"{c}_{k}": (own == k).cast("double") for k in categories}
    if rare:
        out[f"{c}_infrequent"] = (~own.isin(*categories)).cast("double") if categories else F.lit(1.0)
    return out


def modes(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """The most frequent value of each column, the smallest of equals."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = long.filter("value IS NOT NULL").groupBy("variable", "value").count()
    return {r.variable: r.best.value for r in counts.groupBy("variable").agg(F.max_by(F.struct("value"), F.struct("count", (-F.col("value")).alias("low"))).alias("best")).collect()}


def bayesian_ridge(gram: np.ndarray, xy: np.ndarray, yy: float, n: float) -> np.ndarray:
    """The coefficients of ridge regression whose penalty is the one of largest evidence, from centred sums of products.

    The precisions of noise and coefficients are re-estimated in turn from the effective number of parameters.
    """
    values, vectors = np.linalg.eigh(gram)
    values, along = np.maximum(values, 0.0), vectors.T @ xy
    noise, weight, beta = n / max(yy, np.finfo(float).eps * n), 1.0, np.zeros(len(xy))
    for _ in range(EVIDENCE_ROUNDS):
        new = vectors @ (along / (values + weight / noise))
        effective = float((noise * values / (weight + noise * values)).sum())
        rest = max(yy - 2 * new @ xy + new @ gram @ new, 0.0)
        weight = (effective + 2 * PRIOR) / (float(new @ new) + 2 * PRIOR)
        noise = (n - effective + 2 * PRIOR) / (rest + 2 * PRIOR)
        moved, beta = float(np.abs(new - beta).sum()), new
        if moved < EVIDENCE_CHANGE:
            break
    return vectors @ (along / (values + weight / noise))


@dataclass
class Imputer:
    """Round-robin Bayesian ridge regression of each column with missing values on all others.

    In rows that lack the same columns an imputed value is a linear function of the others, so that counts, sums
    and products by pattern of missing values, one aggregation, are all that the rounds need; they run on
    matrices of the size of the columns. One set of coefficients for each pattern results. The steps of the rounds are
    kept too: rows of a pattern that training rows did not have go through them one after the other.
    """

    columns: list[str]
    lacking: list[str] = field(default_factory=list)
    means: dict[str, float] = field(default_factory=dict)
    #: Pattern to column to coefficients over (1, columns).
    coefficients: dict[str, dict[str, list[float]]] = field(default_factory=dict)
    #: (place of a column, coefficients over (1, columns)) for each regression of all rounds, in order.
    steps: list[tuple[int, list[float]]] = field(default_factory=list)

    def pattern(self) -> Column:
        return F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in self.lacking]) if self.lacking else F.lit("")

    def fit(self, df: DataFrame, rounds: int = ROUNDS) -> Imputer:
        p = len(self.columns)
        missing = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in self.columns]).first()
        self.lacking = sorted((c for c in self.columns if missing[c]), key=lambda c: (missing[c], c))
        value = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns]
        terms = [F.lit(1.0), *value]
        cells = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
        rows = df.groupBy(self.pattern().alias("pattern")).agg(*[F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i, j in cells]).collect()
        sums = {}
        for r in rows:
            own = np.zeros((p + 1, p + 1))
            for i, j in cells:
                own[i, j] = own[j, i] = r[f"s{i}_{j}"]
            sums[r.pattern] = own
        at = {c: k + 1 for k, c in enumerate(self.columns)}
        seen = {c: [g for g in sums if not self.lacking or c not in self.lacking or g[self.lacking.index(c)] == "0"] for c in self.columns}
        self.means = {c: sum(sums[g][0, at[c]] for g in seen[c]) / max(1.0, sum(sums[g][0, 0] for g in seen[c])) for c in self.columns}
        lift = {g: np.eye(p + 1) for g in sums}
        for g in sums:
            for k, c in enumerate(self.lacking):
                if g[k] == "1":
                    lift[g][at[c]] = 0
                    lift[g][at[c], 0] = self.means[c]
        self.steps = []
        for _ in range(rounds):
            for k, c in enumerate(self.lacking):
                j = at[c]
                full = sum((lift[g] @ sums[g] @ lift[g].T for g in seen[c]), np.zeros((p + 1, p + 1)))
                beta = self.regression(full, j)
                self.steps.append((j, beta.tolist()))
                for g in sums:
                    if g[k] == "1":
                        lift[g][j] = beta @ lift[g]
        self.coefficients = {g: {c: lift[g][at[c]].tolist() for k, c in enumerate(self.lacking) if g[k] == "1"} for g in sums}
        return self

    def regression(self, full: np.ndarray, j: int) -> np.ndarray:
        """Coefficients over (1, columns), 0 for column j itself, from the sums of products of the rows that have it."""
        n, p = full[0, 0], len(full) - 1
        beta = np.zeros(p + 1)
        if n:
            others = [i for i in range(1, p + 1) if i != j]
            mean = full[0] / n
            centred = full - n * np.outer(mean, mean)
            if others:
                beta[others] = bayesian_ridge(centred[np.ix_(others, others)], centred[others, j], max(centred[j, j], 0.0), n)
            beta[0] = mean[j] - beta[others] @ mean[others]
        return beta

    def stepped(self) -> Column:
        """All values of a row, after a 1, when its missing ones have gone through the steps."""
        start = F.array(F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(float(self.means[c]))) for c in self.columns])
        missing = F.array(F.lit(False), *[F.col(c).isNull() for c in self.columns])
        steps = F.array(*[F.struct(F.lit(j).alias("at"), F.array(*map(F.lit, own)).alias("own")) for j, own in self.steps])

        def taken(state: Column, step: Column) -> Column:
            fitted = F.aggregate(F.zip_with(state, step["own"], lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
            return F.transform(state, lambda x, i: F.when((i == step["at"]) & F.get(missing, i), fitted).otherwise(x))

        return F.aggregate(steps, start, taken)

    def with_steps(self, df: DataFrame) -> DataFrame:
        """df with what imputed() reads: a column of its own, as Spark evaluates equal nested expressions of one row wrongly."""
        return df.withColumn(STEPPED, self.stepped()) if self.steps else df

    def imputed(self) -> dict[str, Column]:
        """Each column with its missing values filled in, over with_steps()."""
        out = {}
        value = [F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns]]
        for k, c in enumerate(self.columns):
            filled = F.get(F.col(STEPPED), F.lit(k + 1)) if self.steps and c in self.lacking else F.lit(float(self.means.get(c, 0.0)))
            if len(self.coefficients) <= PATTERNS:
                for g, own in self.coefficients.items():
                    if c in own:
                        filled = F.when(self.pattern() == g, sum((F.lit(w) * v for w, v in zip(own[c], value) if w), F.lit(0.0))).otherwise(filled)
            out[c] = F.coalesce(F.col(c).cast("double"), filled)
        return out


@dataclass
class Preprocessor:
    """Numbers imputed with missing flags and scaled, categories one-hot, binaries by mode with missing flags; in this order."""

    numeric: list[str]
    categorical: list[str]
    binary: list[str]
    least: int = 10
    imputer: Imputer | None = None
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    categories: dict[str, tuple[list[str], bool]] = field(default_factory=dict)
    mode: dict[str, float] = field(default_factory=dict)
    flagged: list[str] = field(default_factory=list)

    def numbers(self) -> dict[str, Column]:
        return {**self.imputer.imputed(), **{f"missingindicator_{c}": F.col(c).isNull().cast("double") for c in self.imputer.columns if c in self.imputer.lacking}}

    def fit(self, train: DataFrame) -> Preprocessor:
        self.imputer = Imputer(self.numeric).fit(train) if self.numeric else Imputer([])
        if self.numeric:
            own = self.numbers()
            self.scale = population_scale(self.imputer.with_steps(train).select(*[e.alias(c) for c, e in own.items()]), list(own))
        self.categories = frequent_categories(train, self.categorical, self.least) if self.categorical else {}
        if self.binary:
            self.mode = modes(train, self.binary)
            missing = train.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in self.binary]).first()
            self.flagged = [c for c in self.binary if missing[c]]
        return self

    def expressions(self) -> dict[str, Column]:
        out = {f"num__{c}": (e - self.scale[c][0]) / self.scale[c][1] for c, e in self.numbers().items()} if self.numeric else {}
        for c in self.categorical:
            out |= {f"cat__{k}": e for k, e in one_hot(c, *self.categories[c]).items()}
        out |= {f"bin__{c}": F.coalesce(F.col(c).cast("double"), F.lit(self.mode.get(c, 0.0))) for c in self.binary}
        return out | {f"bin__missingindicator_{c}": F.col(c).isNull().cast("double") for c in self.flagged}

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """The prepared columns, after those to keep."""
        checks.require_columns(df, [*self.numeric, *self.categorical, *self.binary])
        return self.imputer.with_steps(df).select(*(keep or []), *[e.alias(c) for c, e in self.expressions().items()])

    def save(self, spark: SparkSession, path: str) -> None:
        """The fitted parameters as one row of JSON."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preprocessor:
        own = json.loads(spark.read.text(path).first().value)
        own["imputer"] = Imputer(**own["imputer"])
        own["imputer"].steps = [(j, list(w)) for j, w in own["imputer"].steps]
        own["scale"] = {k: tuple(v) for k, v in own["scale"].items()}
        own["categories"] = {k: (v[0], v[1]) for k, v in own["categories"].items()}
        return cls(**own)

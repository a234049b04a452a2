"""Binary classifiers, grouped cross-validation and nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .metrics import quality_of
from .preprocess import Preprocessor

SEED = 42
#: Candidate thresholds of a feature in trees.
BINS = 256
#: Vectors in a block of the neighbour search.
BLOCK = 2_000


def prior(train: DataFrame, target: str) -> Callable[[DataFrame], DataFrame]:
    """Scores every row with the share of positives in training."""
    share = train.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
    return lambda df: df.withColumn("score", F.lit(share))


def estimated(make: Callable[[int], object]) -> Callable[[DataFrame, str, list[str]], Callable[[DataFrame], DataFrame]]:
    """A model of the ml library as a function from training rows to a scoring function; make() is told their number."""

    def fit(train: DataFrame, target: str, features: list[str]) -> Callable[[DataFrame], DataFrame]:
        label = train.withColumn("__label", F.col(target).cast("double"))
        model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__features"), make(train.count())]).fit(label)

        def score(df: DataFrame) -> DataFrame:
            out = model.transform(df)
            if "__probability" in out.columns:
                value = vector_to_array("__probability")[1]
            else:  # a margin as a probability
                value = 1 / (1 + F.exp(-vector_to_array("__raw")[1]))
            return out.withColumn("score", value).select(*df.columns, "score")

        return score

    return fit


def named(estimator, **parameters):
    return estimator(featuresCol="__features", labelCol="__label", predictionCol="__prediction", rawPredictionCol="__raw", **parameters)


def logistic(mix: float):
    """Inverse regularisation strength 1, as a penalty for each row; the features are scaled already."""
    return estimated(lambda n: named(LogisticRegression, probabilityCol="__probability", elasticNetParam=mix, regParam=1.0 / max(1, n), maxIter=1000, standardization=False))


#: Model by name: a function of (training rows, target, features). The SVM is linear with a logistic link and the
#: boosted trees are Spark's own: substitutes for an RBF kernel and another boosting library.
MODELS: dict[str, Callable] = {
    "Dummy": lambda train, target, features: prior(train, target),
    "Logistic L2": logistic(0.0),
    "Logistic L1": logistic(1.0),
    "Logistic elastic net": logistic(0.5),
    "Decision tree": estimated(lambda n: named(DecisionTreeClassifier, probabilityCol="__probability", maxDepth=30, maxBins=BINS, maxMemoryInMB=512, seed=SEED)),
    "Random forest": estimated(lambda n: named(RandomForestClassifier, probabilityCol="__probability", numTrees=100, maxDepth=20, maxBins=BINS, seed=SEED)),
    "k-NN": lambda train, target, features: neighbour_score(train, target, features),
    "SVM (linear substitute)": estimated(lambda n: named(LinearSVC, regParam=1.0 / max(1, n), maxIter=100, standardization=False)),
    "Boosted trees (substitute)": estimated(lambda n: GBTClassifier(featuresCol="__features", labelCol="__label", predictionCol="__prediction", maxIter=100, maxBins=BINS, seed=SEED).setRawPredictionCol("__raw").setProbabilityCol("__probability")),
}


def blocks(df: DataFrame, key: str, vector: str, prefix: str) -> DataFrame:
    """Vectors gathered in blocks of about BLOCK, by hash of the key."""
    n = max(1, -(-df.count() // BLOCK))
    block = F.pmod(F.xxhash64(key), F.lit(n)).alias(f"{prefix}_block")
    return df.groupBy(block).agg(F.collect_list(key).alias(f"{prefix}_key"), F.collect_list(vector).alias(f"{prefix}_vector"))


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int = 5, itself: bool = False) -> DataFrame:
    """(query, neighbour, distance, place): the k nearest base rows of each query by Euclidean distance, ties by key.

    Blocks of queries meet blocks of base rows; each pair of blocks gives the k best of its queries and one more
    aggregation the k best of all. Null vectors are left out; a row is not its own neighbour unless asked.
    """
    own = blocks(queries.filter(F.col(vector).isNotNull()), key, vector, "q")
    other = blocks(base.filter(F.col(vector).isNotNull()), key, vector, "b")

    own_type = to_arrow_type(queries.schema[key].dataType)

    def best(batches):
        for batch in batches:
            for q_key, q_vector, b_key, b_vector in zip(*(batch.column(c).to_pylist() for c in ("q_key", "q_vector", "b_key", "b_vector"))):
                q, b = np.array(q_vector, np.float64), np.array(b_vector, np.float64)
                keys, mine = np.array(b_key), np.array(q_key)
                rough = (q**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (q @ b.T)
                if not itself:
                    rough[mine[:, None] == keys] = np.inf
                edge = np.partition(rough, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
                slack = 1e-9 * (1 + (q**2).sum(axis=1) + (b**2).sum(axis=1).max())  # more than the rounding of the products and of the distance
                rows = []
                for i in range(len(q)):
                    near = np.flatnonzero((rough[i] <= edge[i] + slack[i]) & np.isfinite(rough[i]))
                    far = np.round(np.sqrt(((b[near] - q[i]) ** 2).sum(axis=1)), 9)
                    rows += [(q_key[i], b_key[near[j]], float(far[j])) for j in np.lexsort((keys[near], far))[:k]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (own_type, own_type, pa.float64()))], names=["query", "neighbour", "distance"])

    kind = queries.schema[key].dataType.simpleString()
    pairs = own.crossJoin(other)  # of blocks
    found = pairs.repartition(pairs.sparkSession.sparkContext.defaultParallelism, "q_block", "b_block").mapInArrow(best, f"query {kind}, neighbour {kind}, distance double")
    top = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k).alias("top"))
    out = top.select("query", F.posexplode("top").alias("place", "x"))
    return out.select("query", F.col("x.neighbour").alias("neighbour"), F.col("x.distance").alias("distance"), (F.col("place") + 1).alias("place"))


def neighbour_score(train: DataFrame, target: str, features: list[str], k: int = 5) -> Callable[[DataFrame], DataFrame]:
    """Scores rows with the share of positives among the k nearest training rows.

    Repeated training rows vote each. Rows of one vector are one point with their counts; the k nearest points hold
    the k nearest rows, and of the last point only as many rows vote as are lacking, with the point's share.
    """
    vector = F.array(*[F.col(c).cast("double") for c in features])
    own_id = F.concat(F.lit("t"), F.xxhash64("__v").cast("string"))
    base = train.select(vector.alias("__v"), F.col(target).cast("double").alias("__y")).groupBy("__v").agg(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("share")).withColumn("__id", own_id)

    def score(df: DataFrame) -> DataFrame:
        own = df.withColumn("__id", F.concat(F.lit("q"), F.xxhash64(*[F.col(c).cast("double") for c in features]).cast("string")))
        asked = own.select("__id", vector.alias("__v")).dropDuplicates(["__id"])
        found = nearest(asked, base.select("__id", "__v"), "__id", "__v", k)
        points = found.join(base.select(F.col("__id").alias("neighbour"), "n", "share"), "neighbour")
        nearer = F.coalesce(F.sum("n").over(Window.partitionBy("query").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        votes = points.withColumn("votes", F.greatest(F.lit(0), F.least("n", F.lit(k) - nearer)))
        share = votes.groupBy(F.col("query").alias("__id")).agg((F.sum(F.col("votes") * F.col("share")) / F.sum("votes")).alias("score"))
        return own.join(share, "__id", "left").drop("__id")

    return score


def cross_validated(df: DataFrame, folds: DataFrame, group: str, target: str, preprocessor: Callable[[], Preprocessor], models: dict[str, Callable] = MODELS) -> DataFrame:
    """(model, fold, metrics of training and held-out rows) for each model and fold.

    The preparation is fitted anew on each fold's training rows only. Folds and models are a fixed, small number
    of jobs; the driver holds their metrics.
    """
    if not models:
        raise ValueError("No model is chosen")
    dealt = df.join(folds.select(group, "fold"), group)
    numbers = sorted(r[0] for r in folds.select("fold").distinct().collect())
    out = []
    for fold in numbers:
        train, test = dealt.filter(F.col("fold") != fold), dealt.filter(F.col("fold") == fold)
        ready = preprocessor().fit(train)
        train, test = (ready.transform(side, [target]).cache() for side in (train, test))
        features = [c for c in train.columns if c != target]
        for name, fit in models.items():
            score = fit(train, target, features)
            seen, held = (quality(score(side), target) for side in (train, test))
            out.append((name, fold, seen["roc_auc"], held["roc_auc"], seen["average_precision"], held["average_precision"], seen["brier_score"], held["brier_score"]))
        train.unpersist()
        test.unpersist()
    return df.sparkSession.createDataFrame(out, "model string, fold int, train_roc_auc double, roc_auc double, train_average_precision double, average_precision double, train_neg_brier_score double, brier_score double")


def quality(scored: DataFrame, target: str) -> dict[str, float | None]:
    row = quality_of(scored, target, "score").first()
    return {"roc_auc": row.auroc, "average_precision": row.average_precision, "brier_score": row.brier}

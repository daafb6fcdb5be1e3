"""Features, training, tuning and scoring with MLlib."""

from __future__ import annotations

import math
import random
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import newest_version, saved
from .metrics import average_precision, best_threshold

# The ranges of a search. Inverse penalty (even in its logarithm), mixture of penalties, trees, depth, learning rate (even in its logarithm), shares of rows and columns, rows of a leaf.
INVERSE_PENALTY, PENALTIES = (1e-4, 100.0), (0.0, 1.0)
TREES, DEPTH, RATE, SHARE, LEAF = (200, 1200), (3, 10), (0.01, 0.3), (0.5, 1.0), (1, 10)


def vocabulary(train: DataFrame, column: str, most: int = 1000) -> list[str]:
    """Distinct values of a category in training rows; more than ``most`` is an error, as such a column is no category."""
    rows = train.select(F.coalesce(F.col(column), F.lit("missing")).alias("v")).distinct().orderBy("v").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} values")
    return [r["v"] for r in rows]


def one_hot(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Indicator columns of the training values; values that training lacks give zeros."""
    for c in columns:
        df = df.withColumns({f"{c}_{v}": (F.coalesce(F.col(c), F.lit("missing")) == v).cast("int") for v in vocabulary(train, c)}).drop(c)
    return df


def preparation(numeric: list[str], categories: list[str]) -> list:
    """Stages: indexed and encoded categories (unseen ones kept apart), assembled, standardised."""
    stages = [StringIndexer(inputCols=categories, outputCols=[f"{c}_i" for c in categories], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_v" for c in categories])] if categories else []
    return [*stages, VectorAssembler(inputCols=[*numeric, *(f"{c}_v" for c in categories)], outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="x", withMean=True)]


def learner(kind: str, label: str, weight: str | None = None, **params):
    """logistic, boosted or forest."""
    make = {"logistic": LogisticRegression, "boosted": GBTClassifier, "forest": RandomForestClassifier}[kind]
    return make(featuresCol="x", labelCol=label, **({"weightCol": weight} if weight else {}), **params)


def train(df: DataFrame, kind: str, numeric: list[str], categories: list[str], label: str, weight: str | None = None, **params) -> PipelineModel:
    return Pipeline(stages=[*preparation(numeric, categories), learner(kind, label, weight, **params)]).fit(df)


def scored_by(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("p", F.round(vector_to_array("probability")[1], 9)).drop("_raw", "rawPrediction", "probability", "prediction")


class KeptModel:
    """A fitted pipeline, its decision threshold and its input columns: what is needed to score later rows, as one versioned artefact."""

    def __init__(self, model: PipelineModel, threshold: float, numeric: list[str], categories: list[str], version: int):
        self.model, self.threshold, self.numeric, self.categories, self.version = model, threshold, numeric, categories, version

    def save(self, folder: str) -> None:
        """Writes ``folder/version=<version>``; threshold and columns come last, so a version that broke off isn't loaded."""
        where, spark = f"{folder}/version={self.version}", SparkSession.active()
        self.model.write().overwrite().save(f"{where}/pipeline")
        rows = [(self.threshold, n, c, c in self.categories) for n, c in enumerate([*self.numeric, *self.categories])]
        spark.createDataFrame(rows, "threshold double, place int, feature string, category boolean").coalesce(1).write.mode("overwrite").parquet(f"{where}/serving")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int | None = None) -> KeptModel:
        version = newest_version(spark, folder, "serving") if version is None else version
        where = f"{folder}/version={version}"
        rows = spark.read.parquet(f"{where}/serving").orderBy("place").collect()  # a row for each input column
        of = lambda category: [r["feature"] for r in rows if r["category"] == category]
        return cls(PipelineModel.load(f"{where}/pipeline"), rows[0]["threshold"], of(False), of(True), version)

    def score(self, df: DataFrame) -> DataFrame:
        """Rows with ``p`` and ``flagged``, by the model's own columns: an absent number or null is 0, an absent category unknown; other columns are carried along."""
        numbers = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in self.numeric}
        absent = {c: F.lit(None).cast("string") for c in self.categories if c not in df.columns}
        return scored_by(self.model, df.withColumns(numbers | absent)).withColumn("flagged", F.col("p") >= self.threshold)


def kept_model(train_rows: DataFrame, val_rows: DataFrame, kind: str, numeric: list[str], categories: list[str], label: str, version: int = 1, **params) -> KeptModel:
    """A model fitted on training rows, with the threshold of the best F2 on validation rows."""
    model = train(train_rows, kind, numeric, categories, label, **params)
    at = best_threshold(scored_by(model, val_rows), "p", label).first()["threshold"]
    return KeptModel(model, float(at), numeric, categories, version)


class AveragePrecision(Evaluator):
    """M10's average precision as an evaluator of MLlib, for its searches. A constant score counts 0."""

    def __init__(self, label: str):
        super().__init__()
        self.label = label

    def _evaluate(self, dataset: DataFrame) -> float:
        p = dataset.select(F.round(vector_to_array("probability")[1], 9).alias("p"), self.label)
        low, high = p.agg(F.min("p"), F.max("p")).first()
        return 0.0 if low is None or high - low < 1e-6 else float(average_precision(p, "p", self.label).first()[0])

    def isLargerBetter(self) -> bool:
        return True


def tournament(train_rows: DataFrame, val_rows: DataFrame, candidates: dict[str, tuple[str, dict]], numeric: list[str], categories: list[str], label: str, sample: int | None = None, parallelism: int = 4) -> DataFrame:
    """``run, pr_auc``: each candidate trained and measured on validation rows; a constant score counts 0.

    Features are prepared once; trials run side by side, ``parallelism`` at a time
    (the loop is over candidates, not rows). ``sample``: about so many training rows
    are used (by a fixed hash share), as a search does; all without it.
    """
    rows = train_rows
    if sample is not None and (n := train_rows.count()) > sample:
        rows = train_rows.where(F.pmod(F.xxhash64(*numeric), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    prepare = Pipeline(stages=preparation(numeric, categories)).fit(rows)
    fit_on, measure_on = (saved(prepare.transform(df).select("x", label), name) for df, name in ((rows, "trial-rows"), (val_rows, "validation-rows")))
    evaluate = AveragePrecision(label)

    def trial(item: tuple[str, tuple[str, dict]]) -> tuple[str, float]:
        name, (kind, params) = item
        return name, evaluate.evaluate(learner(kind, label, **params).fit(fit_on).transform(measure_on))

    with ThreadPool(parallelism) as pool:
        runs = pool.map(inheritable_thread_target(train_rows.sparkSession)(trial), list(candidates.items()), 1)
    return train_rows.sparkSession.createDataFrame(runs, "run string, pr_auc double")  # a row for each candidate


def search_space(draws: int, seed: int = 42) -> dict[str, tuple[str, dict]]:
    """Random candidates for ``tournament``: logistic, boosted and forest in turn, from the ranges below."""
    rng, out = random.Random(seed), {}
    even = lambda low, high: math.exp(rng.uniform(math.log(low), math.log(high)))
    for i in range(draws):
        if i % 3 == 0:
            out[f"draw_{i}"] = ("logistic", {"regParam": 1 / even(*INVERSE_PENALTY), "elasticNetParam": rng.choice(PENALTIES), "maxIter": 1000})
        elif i % 3 == 1:
            out[f"draw_{i}"] = ("boosted", {"maxIter": rng.randint(*TREES), "maxDepth": rng.randint(*DEPTH), "stepSize": even(*RATE), "subsamplingRate": rng.uniform(*SHARE), "featureSubsetStrategy": str(rng.uniform(*SHARE)), "minInstancesPerNode": rng.randint(*LEAF), "seed": seed})
        else:
            out[f"draw_{i}"] = ("forest", {"numTrees": rng.randint(*TREES), "maxDepth": rng.randint(*DEPTH), "subsamplingRate": rng.uniform(*SHARE), "featureSubsetStrategy": str(rng.uniform(*SHARE)), "minInstancesPerNode": rng.randint(*LEAF), "seed": seed})
    return out


def scaled_down(space: dict[str, tuple[str, dict]], trees: int) -> dict[str, tuple[str, dict]]:
    """The same draws with at most ``trees`` trees and depth 4, for trials that only have to tell candidates apart."""
    most = {"maxIter": trees, "numTrees": trees, "maxDepth": 4}
    return {name: (kind, {k: min(v, most[k]) if k in most and kind != "logistic" else v for k, v in params.items()}) for name, (kind, params) in space.items()}


def promotion(runs: DataFrame, champion: str, challenger: str, margin: float = 0.005) -> DataFrame:
    """Whether the challenger replaces the champion: by at least the same measure at training time, by ``margin`` in operation."""
    of = lambda r: F.max(F.when(F.col("run") == r, F.col("pr_auc")))
    g = runs.agg(of(champion).alias("c"), of(challenger).alias("n"))
    return g.select(F.round("c", 6).alias("champion"), F.round("n", 6).alias("challenger"), (F.col("n") >= F.col("c")).alias("promote_trained"), (F.col("n") - F.col("c") > margin).alias("promote_live"))


def importance(model: PipelineModel, df: DataFrame, top: int = 20) -> DataFrame:
    """``feature, importance`` of the model's inputs, largest first; ``top`` rows at most, made on the driver from the model's own numbers."""
    last = model.stages[-1]
    values = [abs(v) for v in (last.coefficients if hasattr(last, "coefficients") else last.featureImportances).toArray()]
    meta = model.transform(df.limit(1)).schema["_raw"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in meta.values() for a in kind}
    best = sorted(((names.get(i, str(i)), float(v)) for i, v in enumerate(values)), key=lambda x: (-x[1], x[0]))[:top]
    return df.sparkSession.createDataFrame(best, "feature string, importance double")


def contributions(df: DataFrame, weights: dict[str, float], means: dict[str, float]) -> Column:
    """Signed contribution of each input of a linear model: weight times distance from the mean."""
    return F.array(*(F.struct(F.lit(c).alias("feature"), F.round(F.lit(w) * (F.col(c).cast("double") - F.lit(means[c])), 6).alias("contribution")) for c, w in weights.items()))

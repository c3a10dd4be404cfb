"""Classifiers over the weekly panel: feature assembly, MLlib estimators, prediction."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import sigmoid
from tidemark.operators.metrics import class_weights
from tidemark.operators.numeric_prep import NumericPrep, fit_numeric
from tidemark.operators.terms import TextVectors, fit_text_vectors
from tidemark.settings import ModelSettings, TextSettings

NAIVE = "naive_persistence"
TEXT_MODELS = {"text_logreg", "hybrid_logreg", "linear_svm"}
NUMERIC_MODELS = {"market_logreg", "hybrid_logreg", "random_forest", "boosted_trees"}
SEED = 42
KEEP = ("week_start", "asset", "target_up")


def enabled_models(models: Sequence[ModelSettings]) -> list[ModelSettings]:
    """The baseline first, whatever its own flag says, then the enabled ones in their order."""
    return [ModelSettings(NAIVE)] + [m for m in models if m.enabled and m.name != NAIVE]


def uses(name: str) -> tuple[bool, bool]:
    """Whether a model reads text and whether it reads numbers."""
    text, numeric = name in TEXT_MODELS, name in NUMERIC_MODELS
    if not (text or numeric):
        raise ValueError(f"unknown model: {name}")
    return text, numeric


def estimator(model: ModelSettings, n_train: int, features: str, maximum_iterations: int = 100):
    """The MLlib estimator of a model.

    Penalised losses: C sums over rows where MLlib averages, hence ``regParam = 1 / (C n)``.
    """
    name, p = model.name, model.params
    columns = {"labelCol": "target_up", "featuresCol": features}
    if name in ("market_logreg", "text_logreg", "hybrid_logreg"):
        return LogisticRegression(
            regParam=1.0 / (float(p.get("C", 1.0)) * n_train), elasticNetParam=0.0,
            maxIter=int(p.get("max_iter", maximum_iterations)), standardization=False,
            weightCol="_weight", **columns,
        )
    if name == "linear_svm":
        return LinearSVC(
            regParam=1.0 / (float(p.get("C", 1.0)) * n_train),
            maxIter=int(p.get("max_iter", maximum_iterations)), standardization=False,
            weightCol="_weight", **columns,
        )
    if name == "random_forest":
        return RandomForestClassifier(
            numTrees=int(p.get("n_trees", 300)), maxDepth=int(p.get("max_depth", 8)),
            minInstancesPerNode=int(p.get("min_leaf", 8)), featureSubsetStrategy="sqrt",
            seed=SEED, weightCol="_weight", **columns,
        )
    if name == "boosted_trees":
        return GBTClassifier(
            maxIter=int(p.get("n_rounds", 400)), maxDepth=int(p.get("max_depth", 4)),
            stepSize=float(p.get("learning_rate", 0.05)),
            subsamplingRate=float(p.get("row_share", 0.8)),
            featureSubsetStrategy=str(float(p.get("column_share", 0.8))), seed=SEED, **columns,
        )
    raise ValueError(f"unknown model: {name}")


@dataclass(frozen=True)
class Features:
    """Feature steps fitted on one training block, shared by all its models."""

    prep: NumericPrep | None
    text: TextVectors | None

    def transform(self, panel: DataFrame, terms: DataFrame | None) -> DataFrame:
        """Adds ``numeric_features``, ``text_features`` and ``all_features`` as far as fitted."""
        out = panel
        if self.text is not None:
            out = self.text.transform(out, terms, "text_features")
        if self.prep is not None:
            out = self.prep.transform(out)
            columns = [f"std_{c}" for c in self.prep.columns]
            out = VectorAssembler(inputCols=columns, outputCol="numeric_features").transform(out)
            out = out.drop(*columns)
        if self.text is not None and self.prep is not None:
            out = VectorAssembler(
                inputCols=["text_features", "numeric_features"], outputCol="all_features"
            ).transform(out)
        return out.drop("weekly_text")

    def names(self, model_name: str) -> list[str]:
        text, numeric = uses(model_name)
        found = [f"text__{t}" for t in self.text.terms] if text else []
        return found + ([f"num__{c}" for c in self.prep.columns] if numeric else [])


def fit_features(
    train: DataFrame,
    terms: DataFrame | None,
    models: Sequence[ModelSettings],
    columns: Sequence[str],
    n_train: int,
    settings: TextSettings = TextSettings(),
) -> Features:
    needs = [uses(m.name) for m in models if m.name != NAIVE]
    text = prep = None
    if any(t for t, _ in needs):
        if terms is None:
            raise ValueError("text models need the weekly terms")
        text = fit_text_vectors(terms, train, n_train, settings.max_features, settings.min_df)
    if any(n for _, n in needs):
        prep = fit_numeric(train, columns, n_train)
    return Features(prep, text)


def features_column(model_name: str) -> str:
    return {(True, False): "text_features", (False, True): "numeric_features", (True, True): "all_features"}[
        uses(model_name)
    ]


def with_class_weights(rows: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``_weight`` (balanced by class) and gives the row count; both classes have to occur."""
    found = {r["target_up"]: (r["n"], r["weight"]) for r in class_weights(rows).collect()}
    if len(found) < 2:
        raise ValueError("training rows hold a single class")
    weight = F.when(F.col("target_up") == 1, F.lit(found[1][1])).otherwise(F.lit(found[0][1]))
    return rows.withColumn("_weight", weight), sum(n for n, _ in found.values())


def positive_score(model: Model) -> Column:
    """Probability of class 1, or the sigmoid of the margin for a model without probabilities."""
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    if model.hasParam("probabilityCol"):
        return vector_to_array("probability")[1]
    return sigmoid(vector_to_array("rawPrediction")[1])


def naive_predictions(panel: DataFrame) -> DataFrame:
    signal = F.col("naive_persistence_signal")
    return panel.select(
        *KEEP, F.lit(NAIVE).alias("model"),
        signal.cast("int").alias("y_pred"), signal.cast("double").alias("y_score"),
    )


def model_predictions(model: Model, name: str, features: DataFrame) -> DataFrame:
    return model.transform(features).select(
        *KEEP, F.lit(name).alias("model"),
        F.col("prediction").cast("int").alias("y_pred"), positive_score(model).alias("y_score"),
    )


def feature_importance(
    spark: SparkSession, model: Model, names: Sequence[str], top_n: int = 40
) -> DataFrame | None:
    """(feature, importance, abs_importance), largest first; None where the model has no weights."""
    if hasattr(model, "coefficients"):
        values = model.coefficients.toArray()
    elif hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    else:
        return None
    if len(values) != len(names):
        return None
    table = spark.createDataFrame(
        [(n, float(v)) for n, v in zip(names, values)], "feature string, importance double"
    )
    return top_importance(table, top_n)


def top_importance(table: DataFrame, top_n: int = 40) -> DataFrame:
    return (
        table.withColumn("abs_importance", F.abs("importance"))
        .orderBy(F.col("abs_importance").desc(), "feature")
        .limit(top_n)
    )


@dataclass(frozen=True)
class TrainedModel:
    """A fitted classifier with the feature steps it needs."""

    name: str
    model: Model
    features: Features

    def predict(self, panel: DataFrame, terms: DataFrame | None) -> DataFrame:
        return model_predictions(self.model, self.name, self.features.transform(panel, terms))

    def save(self, folder: str) -> None:
        """Classifier, vocabulary, numeric statistics and name, each in its own subfolder."""
        text, numeric = uses(self.name)
        PipelineModel([self.model]).write().overwrite().save(f"{folder}/classifier")
        spark = SparkSession.getActiveSession()
        if text:
            self.features.text.vocab.write.mode("overwrite").parquet(f"{folder}/vocabulary")
        if numeric:
            prep = self.features.prep
            spark.createDataFrame(
                [(i, c, prep.medians[c], prep.means[c], prep.deviations[c])
                 for i, c in enumerate(prep.columns)],
                "position int, name string, median double, mean double, deviation double",
            ).write.mode("overwrite").parquet(f"{folder}/numeric")
        spark.createDataFrame([(json.dumps({"model": self.name}),)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{folder}/about")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> TrainedModel:
        name = json.loads(spark.read.text(f"{folder}/about").first()[0])["model"]
        text, numeric = uses(name)
        vectors = prep = None
        if text:
            vocab = spark.read.parquet(f"{folder}/vocabulary")
            terms = tuple(r["term"] for r in vocab.orderBy("idx").collect())
            vectors = TextVectors(terms, vocab)
        if numeric:
            rows = spark.read.parquet(f"{folder}/numeric").orderBy("position").collect()
            prep = NumericPrep(
                {r["name"]: r["median"] for r in rows}, {r["name"]: r["mean"] for r in rows},
                {r["name"]: r["deviation"] for r in rows},
            )
        model = PipelineModel.load(f"{folder}/classifier").stages[0]
        return TrainedModel(name, model, Features(prep, vectors))

"""Pairwise matchers: models over scaled features, out-of-fold scores, a learned threshold."""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.trees import Boosting, Forest, GrownForest, Trees
from tessera.operators.components import checkpointed
from tessera.operators.evaluation import best_threshold, class_weights, fold_report, scaled, scaler, stratified_folds


def make_model(kind: str = "logreg", total_weight: float = 1.0, **options):
    """An estimator by name: logreg, rf or xgb (gradient boosting as xgboost does it; xgboost itself where it is installed and asked for).

    Fixed values: the models' settings.
    """
    common = {"featuresCol": "_x", "labelCol": "label", "weightCol": "_w"}
    if kind == "logreg":
        return LogisticRegression(**common, maxIter=2000, standardization=False, regParam=1.0 / max(total_weight, 1e-9), elasticNetParam=0.0)
    if kind == "rf":
        return Forest(**options)
    if kind == "xgb":
        if options.pop("native", False):
            if importlib.util.find_spec("xgboost") is None:
                raise RuntimeError("xgboost is not installed")
            from xgboost.spark import SparkXGBClassifier

            return SparkXGBClassifier(features_col="_x", label_col="label", weight_col="_w", n_estimators=600, max_depth=6, learning_rate=0.05, subsample=0.9, colsample_bytree=0.9, reg_lambda=1.0)
        return Boosting(**options)
    raise ValueError(f"unknown model {kind!r}; choose logreg, rf or xgb")


@dataclass
class TrainedMatcher:
    model: object
    scaling: dict[str, tuple[float, float]]
    features: tuple[str, ...]
    threshold: float
    metrics: dict = field(default_factory=dict)
    oof: DataFrame | None = None

    def predict_proba(self, pairs: DataFrame) -> DataFrame:
        """Adds prob_match."""
        return _score(self.model, pairs, self.scaling, self.features, "prob_match")

    def predict(self, pairs: DataFrame) -> DataFrame:
        """Adds prob_match and pred_match."""
        return self.predict_proba(pairs).withColumn("pred_match", (F.col("prob_match") >= self.threshold).cast("int"))


def _vector(rows: DataFrame, scaling: dict[str, tuple[float, float]], features: tuple[str, ...]) -> DataFrame:
    kept = rows.withColumns({f"_f_{f}": F.col(f) for f in features})
    ready = scaled(kept, {f"_f_{f}": scaling[f] for f in features})
    return VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol="_x").transform(ready)


def _score(model, rows: DataFrame, scaling: dict, features: tuple[str, ...], name: str) -> DataFrame:
    if isinstance(model, (Trees, GrownForest)):  # trees need no scaling
        return rows.withColumn(name, model.score(features))
    out = model.transform(_vector(rows, scaling, features))
    return out.withColumn(name, vector_to_array("probability")[1]).select(*rows.columns, name)


def _fit(rows: DataFrame, features: tuple[str, ...], kind: str, options: dict):
    scaling = scaler(rows, features)
    weights = class_weights(rows).select(F.col("label").alias("_l"), F.col("weight").alias("_w"))
    if isinstance(model := make_model(kind, **options), (Boosting, Forest)):
        return model.fit(rows.join(F.broadcast(weights), F.col("label") == F.col("_l")), features, "_w"), scaling
    train = _vector(rows, scaling, features).join(F.broadcast(weights), F.col("label") == F.col("_l")).drop("_l")
    total = rows.count()  # balanced weights sum to the number of rows
    return make_model(kind, float(total), **options).fit(train), scaling


def train_matcher(labeled: DataFrame, features: tuple[str, ...], kind: str = "logreg", n_folds: int = 5, seed: int = 42, align: str = "correct", **options) -> TrainedMatcher:
    """Out-of-fold scores of every row, metrics and threshold from them, and a model of all rows."""
    folded = checkpointed(stratified_folds(labeled, n_folds, seed))
    parts = []
    for fold in range(n_folds):
        model, scaling = _fit(folded.filter(F.col("fold") != fold), features, kind, options)
        parts.append(_score(model, folded.filter(F.col("fold") == fold), scaling, features, "score"))
    oof = checkpointed(reduce(DataFrame.unionByName, parts))
    whole = fold_report(oof, ()).first().asDict()
    best = best_threshold(oof, (), align).first()
    threshold = float(best["threshold"]) if best else 0.5
    model, scaling = _fit(folded, features, kind, options)
    metrics = {"folds": [r.asDict() for r in fold_report(oof).orderBy("fold").collect()], "oof": whole | {"threshold": threshold}, "features": list(features), "model": kind, "n_folds": n_folds}
    return TrainedMatcher(model, scaling, features, threshold, metrics, oof)

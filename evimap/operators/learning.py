"""Scoring protein models by a classifier that labels its own sure cases."""

from __future__ import annotations

import itertools
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evimap.functions.tables import written

BASE_COLUMNS = (
    "sequence_coverage", "protein_specific_peptides", "gene_specific_peptides", "splice_peptides", "internal_peptides",
    "mapped_peptides", "n_terminal_peptides", "c_terminal_peptides", "protein_length",
)
COLUMNS = (
    *BASE_COLUMNS, "mapped_peptides_per_aa", "protein_specific_rate", "gene_specific_rate", "splice_rate", "internal_rate", "terminal_rate",
    "isoform_specificity", "junction_evidence", "has_n_term", "has_c_term", "has_both_term", "has_any_protein_specific", "has_any_splice",
)
#: Probabilities from which a row takes a label of its own, and from which it counts as positive: fixed values of the method.
SURE, POSITIVE = (0.10, 0.90), 0.5
#: What a search tries: trees, depth, step, share of rows, share of columns, weight of a positive row: fixed values of the method.
SEARCH = {"maxIter": (100, 200), "maxDepth": (3, 5, 7), "stepSize": (0.01, 0.1), "subsamplingRate": (0.8, 1.0), "featureSubsetStrategy": ("0.8", "all"), "weight": (1, 2, 5)}
#: Labelled rows that are dealt to folds together.
DEALT = 100_000


def columns_of(model: PipelineModel, rows: DataFrame) -> tuple[str, ...]:
    """The columns that a model takes. ValueError names those that rows lack; protein_coverage is an old name of sequence_coverage."""
    wanted = tuple(c.removeprefix("_x_") for c in model.stages[0].getInputCols())
    names = {"protein_coverage": "sequence_coverage", "sequence_coverage": "protein_coverage"}
    missing = [c for c in wanted if c not in rows.columns and names.get(c) not in rows.columns]
    if missing:
        raise ValueError(f"missing columns for the model: {missing}")
    return wanted


def _inputs(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    names = {"protein_coverage": "sequence_coverage", "sequence_coverage": "protein_coverage"}
    return rows.select("*", *[F.coalesce(F.col(c if c in rows.columns else names[c]).cast("double"), F.lit(0.0)).alias(f"_x_{c}") for c in columns])


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds probability and positive."""
    out = model.transform(rows).withColumn("_p", vector_to_array("probability")[1])
    out = out.drop("rawPrediction", "probability", "prediction", "_features")
    return out.withColumnRenamed("_p", "probability").withColumn("positive", F.col("probability") >= POSITIVE)


def pretrained(rows: DataFrame, path: str) -> tuple[DataFrame, PipelineModel]:
    """rows with probability and positive by a model that was saved before."""
    model = PipelineModel.load(path)
    columns = columns_of(model, rows)
    return score(model, _inputs(rows, columns)).drop(*[f"_x_{c}" for c in columns]), model


def default_grid(classifier: GBTClassifier, draws: int = 20, seed: int = 42) -> list[dict]:
    """So many of SEARCH's combinations, drawn at random; a weight is the name of the column that has it."""
    every = list(itertools.product(*SEARCH.values()))
    chosen = random.Random(seed).sample(every, min(draws, len(every)))
    param = lambda name: classifier.getParam("weightCol" if name == "weight" else name)
    return [{param(n): f"_w_{v}" if n == "weight" else v for n, v in zip(SEARCH, values, strict=True)} for values in chosen]


def self_train(rows: DataFrame, columns: tuple[str, ...] = COLUMNS, rounds: int = 5, grid: list | str | None = None, folds: int = 5, seed: int = 42, trees: int = 20, draws: int = 20) -> tuple[DataFrame, PipelineModel]:
    """rows (with high and low, and a protein) with label, probability and positive; and the model.

    Rows that are low are labelled 0, other high ones 1. Each round labels the rows that the model is sure of and fits
    anew, until a round adds none. With a grid of ParamMaps, or "default" for default_grid(), the first model is the best
    of a cross-validation by area under the ROC curve, its folds stratified by label. Nulls count as 0. ValueError where
    either label is missing."""
    label = F.when(F.col("low"), 0.0).when(F.col("high"), 1.0)
    state = _inputs(rows, columns).withColumn("label", label)
    n = rows.count()
    dealt = Window.partitionBy("label", F.pmod(F.xxhash64("protein"), F.lit(1 + n // DEALT))).orderBy(F.xxhash64("protein"), "protein")
    weights = {f"_w_{w}": F.when(F.col("label") == 1, float(w)).otherwise(1.0) for w in SEARCH["weight"]}
    state = written(state.withColumn("_fold", F.pmod(F.row_number().over(dealt), F.lit(folds)).cast("int")))
    if state.select("label").na.drop().distinct().count() < 2:
        raise ValueError("both high and low rows are needed")
    classifier = GBTClassifier(featuresCol="_features", labelCol="label", seed=seed, maxIter=trees)
    steps = Pipeline(stages=[VectorAssembler(inputCols=[f"_x_{c}" for c in columns], outputCol="_features"), classifier])
    if grid:
        maps = default_grid(classifier, draws, seed) if grid == "default" else grid
        search = CrossValidator(estimator=steps, estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=folds, foldCol="_fold", seed=seed)
        model = search.fit(state.where("label is not null").withColumns(weights)).bestModel
    else:
        model = steps.fit(state.where("label is not null"))
    for _ in range(rounds):
        scored = score(model, state)
        sure = F.when(F.col("probability") >= SURE[1], 1.0).when(F.col("probability") <= SURE[0], 0.0)
        now = written(scored.withColumn("_new", F.col("label").isNull() & sure.isNotNull()).withColumn("label", F.coalesce("label", sure)).drop("probability", "positive"))
        added = not now.where("_new").isEmpty()
        state = now.drop("_new")
        if not added:
            break
        model = steps.fit(state.where("label is not null"))
    return score(model, state).drop("_fold", *[f"_x_{c}" for c in columns]), model


def classify(rows: DataFrame, path: str | None = None, iterative: bool = False, **how) -> tuple[DataFrame, PipelineModel, str]:
    """rows scored, the model and how: pretrained by the model at path, iterative if asked for, iterative-fallback where that model can't be used."""
    if iterative:
        return *self_train(rows, **how), "iterative"
    try:
        if not path:
            raise ValueError("no model is named")
        return *pretrained(rows, path), "pretrained"
    except Exception:  # whatever keeps the model from being used
        return *self_train(rows, **how), "iterative-fallback"


def metrics(scored: DataFrame, label: str = "label", positive: str = "positive") -> DataFrame:
    """One row over labelled rows: accuracy, precision, recall, f1 of label 1; 0 where nothing counts."""
    hit = lambda a, b: F.count_if((F.col(label) == a) & (F.col(positive) == F.lit(b)))
    n = scored.where(F.col(label).isNotNull()).agg(hit(1, True).alias("tp"), hit(0, True).alias("fp"), hit(1, False).alias("fn"), hit(0, False).alias("tn"))
    share = lambda a, b: F.coalesce(F.try_divide(F.expr(a), F.expr(b)), F.lit(0.0))
    return n.select(share("tp + tn", "tp + tn + fp + fn").alias("accuracy"), share("tp", "tp + fp").alias("precision"), share("tp", "tp + fn").alias("recall"), share("2 * tp", "2 * tp + fp + fn").alias("f1"))


def area(scored: DataFrame, label: str = "label", probability: str = "probability") -> float:
    """Area under the ROC curve over labelled rows."""
    return BinaryClassificationEvaluator(rawPredictionCol=probability, labelCol=label, numBins=0).evaluate(scored.where(F.col(label).isNotNull()))


def importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """feature and importance, largest first: the trees' gains, not Shapley values."""
    names = [c.removeprefix("_x_") for c in model.stages[0].getInputCols()]
    rows = [(n, float(x)) for n, x in zip(names, model.stages[-1].featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")

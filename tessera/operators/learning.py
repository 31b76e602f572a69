"""Linear classifiers over named features: train, classify, search a grid, save.

Feature names are hashed into a sparse vector inside the JVM, so no dictionary
of names is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import evaluation, features, structure


def train(examples: DataFrame, names: str = "names", label: str = "class", c: float = 1.0, size: int = 1 << 18, kind: str = "svm", iterations: int = 50) -> PipelineModel:
    """A multi-class model of an array column of feature names.

    ``kind`` is ``svm`` (one linear machine a class) or ``logistic``; ``c`` is the
    inverse of the regularisation. Names equal under the hash share a weight;
    ``size`` is the number of weights a class.
    """
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(examples)
    common = {"featuresCol": "_features", "labelCol": "_label"}
    if kind == "svm":
        learner = OneVsRest(classifier=LinearSVC(regParam=1 / c, maxIter=iterations), parallelism=4, predictionCol="_predicted", **common)
    else:
        learner = LogisticRegression(regParam=1 / c, maxIter=iterations, predictionCol="_predicted", probabilityCol="_p", **common)
    hashing = HashingTF(inputCol=names, outputCol="_features", numFeatures=size, binary=True)
    back = IndexToString(inputCol="_predicted", outputCol="predicted", labels=index.labels)
    fitted = Pipeline(stages=[hashing, learner]).fit(index.transform(examples))
    return PipelineModel(stages=[*fitted.stages, back])


def classify(model: PipelineModel, examples: DataFrame) -> DataFrame:
    """The examples with ``predicted`` and ``scores``, a map from class to score."""
    classes = F.array(*map(F.lit, model.stages[-1].getLabels()))
    rows = model.transform(examples).withColumn("scores", F.map_from_arrays(classes, F.slice(vector_to_array("rawPrediction"), 1, F.size(classes))))
    return rows.select(*examples.columns, "predicted", "scores")


def search(training: DataFrame, held_out: DataFrame, grid: Sequence[dict], negative: str = "neg", names: str = "names", label: str = "class") -> tuple[PipelineModel, dict, float]:
    """The model, setting and micro F-score of the best setting on the held-out examples; the first of equals."""
    best = None
    for setting in grid:
        model = train(training, names, label, **setting)
        f = evaluation.micro(evaluation.confusion(classify(model, held_out), label, "predicted"), negative).first().fscore
        if best is None or f > best[2]:
            best = (model, setting, f)
    return best


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def weights(model: PipelineModel) -> DataFrame:
    """(class, slot, weight) of a linear model, weights of 0 left out: a row for each class and hashed name in use."""
    from pyspark.sql import SparkSession

    learner, classes = model.stages[-2], model.stages[-1].getLabels()
    vectors = [m.coefficients.toArray() for m in learner.models] if hasattr(learner, "models") else list(learner.coefficientMatrix.toArray())
    rows = [(classes[k], int(i), float(v[i])) for k, v in enumerate(vectors) for i in v.nonzero()[0]]
    return SparkSession.getActiveSession().createDataFrame(rows, "class string, slot int, weight double")


#: Steps of a detection by task: how examples are made, and what a prediction becomes.
DETECTORS = {
    "triggers": (features.trigger_examples, structure.split_predictions),
    "edges": (features.edge_examples, structure.valid_relations),
    "modifiers": (features.modifier_examples, structure.with_modifiers),
    "phrases": (features.phrase_examples, structure.split_predictions),
}


def detector(task: str) -> tuple:
    """(maker of examples, writer of predictions) by name."""
    if task not in DETECTORS:
        raise KeyError(f"no detector {task}")
    return DETECTORS[task]


def detect(training: DataFrame, new: DataFrame, keys: Sequence[str], names: str = "names", label: str = "class", **setting) -> DataFrame:
    """Predicted classes of new examples by a model of training examples: the keys, ``class`` and the scores of each class."""
    found = classify(train(training, names, label, **setting), new)
    return found.select(*keys, F.col("predicted").alias("class"), "scores")


def detect_events(training: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Triggers and then edges, each detected from its own examples; edge examples whose ends weren't detected are left out.

    Both sides are (trigger examples, edge examples); an edge has the keys of its
    trigger, under the same names.
    """
    triggers = detect(training[0], new[0], keys).where("class <> 'neg'")
    edges = new[1].join(triggers.select(*keys).distinct(), list(keys), "left_semi")
    more = [c for c in edges.columns if c not in ("names", "class")]
    return triggers, detect(training[1], edges, more).where("class <> 'neg'")

"""A forest as Spark's own models: pipelines that can be saved, loaded and applied without this engine."""

from __future__ import annotations

from uuid import uuid4

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import SparkSession

from matchloom.operators.boosting import Forest, Tree


def of(forest: Forest) -> list[tuple[PipelineModel, PipelineModel]]:
    """(trees, sigmoid) of each fold: features to ``margin``, and ``margin_of_1`` to ``calibrated``."""
    return [(_trees(forest, trees), _sigmoid(*numbers)) for trees, numbers in zip(forest.folds, forest.calibration, strict=True)]


def _array(kind, values):
    sc = SparkSession.active().sparkContext
    out = sc._gateway.new_array(kind, len(values))
    for i, v in enumerate(values):
        out[i] = v
    return out


def _node(forest: Forest, tree: Tree, at: int):
    jvm = SparkSession.active().sparkContext._jvm
    ml = jvm.org.apache.spark.ml.tree
    stats = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(_array(jvm.double, [tree.total[at], tree.total[at] * tree.value[at], 0.0]), int(tree.total[at]))
    f = tree.feature[at]
    if f < 0:
        return ml.LeafNode(tree.value[at], 0.0, stats)
    split = ml.ContinuousSplit(f, float(forest.edges[f][tree.bin[at]]))
    gain = tree.gain[at] / tree.total[at]  # Spark's is a row's
    return ml.InternalNode(tree.value[at], 0.0, gain, _node(forest, tree, 2 * at + 1), _node(forest, tree, 2 * at + 2), split, stats)


def _trees(forest: Forest, trees: list[Tree]) -> PipelineModel:
    jvm = SparkSession.active().sparkContext._jvm
    kind, n = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(forest.features)
    grown = [kind(f"dtr_{uuid4().hex[:12]}", _node(forest, t, 0), n) for t in trees]
    made = jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"gbtc_{uuid4().hex[:12]}", _array(kind, grown), _array(jvm.double, [t.weight for t in trees]), n, 2)
    model = GBTClassificationModel(made).setFeaturesCol("features").setPredictionCol("c").setRawPredictionCol("margin").setProbabilityCol("p")
    return PipelineModel([VectorAssembler(inputCols=forest.features, outputCol="features"), model])


def _sigmoid(slope: float, offset: float) -> PipelineModel:
    jvm = SparkSession.active().sparkContext._jvm
    vector = jvm.org.apache.spark.ml.linalg.Vectors.dense(_array(jvm.double, [slope]))
    made = jvm.org.apache.spark.ml.classification.LogisticRegressionModel(f"logreg_{uuid4().hex[:12]}", vector, offset)
    model = LogisticRegressionModel(made).setFeaturesCol("margin_vector").setProbabilityCol("calibrated").setRawPredictionCol("lr_raw").setPredictionCol("lr_class")
    return PipelineModel([VectorAssembler(inputCols=["margin_of_1"], outputCol="margin_vector"), model])

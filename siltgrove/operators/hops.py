"""How many lookups a question needs: a classifier over its embedding, and the budget that follows from it."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distances import normalized
from .ranking import label_weights, stratified

CLASSES, HIDDEN, EPOCHS = 4, 128, 50


def hop_label(n: Column) -> Column:
    """Number of hops as a label: at most 4, 0 for none."""
    return F.greatest(F.least(n, F.lit(CLASSES)), F.lit(0))


def features(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    return rows.where(F.col(vector).isNotNull()).withColumn("features", array_to_vector(normalized(F.col(vector))))


def train(rows: DataFrame, width: int, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 42):  # noqa: ANN201
    """(model, held-out accuracy) of rows with embedding, hops and query_id: rows of 0 hops are left out, a stratified
    tenth is held out, classes are weighed by drawing rare ones more often. Two layers, width to hidden to 4."""
    known = rows.where("hops > 0").withColumn("label", (hop_label(F.col("hops")) - 1).cast("double"))
    split = stratified(features(known), "label", "query_id")
    fit = split.where(~F.col("held_out"))
    weights = label_weights(fit, "label", CLASSES).select("label", "weight")
    copies = F.greatest(F.lit(1), F.round("weight").cast("int"))
    drawn = fit.join(weights, "label").withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    model = MultilayerPerceptronClassifier(layers=[width, hidden, CLASSES], maxIter=epochs, seed=seed, blockSize=64).fit(drawn.select("features", "label"))
    held = model.transform(split.where("held_out"))
    return model, held.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def budget(model, queries: DataFrame) -> DataFrame:  # noqa: ANN001
    """query_id, hops (1 to 4) and lookups beyond the first: hops - 1."""
    p = model.transform(features(queries))
    return p.select("query_id", (F.col("prediction") + 1).cast("int").alias("hops"), F.greatest(F.col("prediction"), F.lit(0)).cast("int").alias("lookups"))


def save(model, path: str) -> None:  # noqa: ANN001
    """Write a trained model to a folder, local or of the cluster's file system; an old one is replaced."""
    model.write().overwrite().save(path)


def load(path: str) -> MultilayerPerceptronClassificationModel:
    """A model that save() wrote."""
    return MultilayerPerceptronClassificationModel.load(path)

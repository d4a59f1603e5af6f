"""The slot for a trained classifier: batches of vectors in, class and confidence out."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Classes of a model at most: their weights are broadcast.
CLASSES = 10_000


def class_means(df: DataFrame, label: str, vector: str) -> tuple[list, np.ndarray, np.ndarray]:
    """Classes (sorted), weights and offsets of the linear model whose scores are highest for the nearest mean of a class: means
    from sums by class and place, a row of each comes to the driver."""
    rows = df.filter(F.col(label).isNotNull() & F.col(vector).isNotNull())
    sums = rows.select(F.col(label).alias("label"), F.posexplode(vector).alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("m")).limit(CLASSES + 1).collect()
    if len(means) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    means.sort(key=lambda r: r[0])
    weights = np.array([r[1] for r in means], np.float64).reshape(len(means), -1)
    return [r[0] for r in means], weights, -(weights**2).sum(1) / 2


def predicted(df: DataFrame, vector: str, classes: list, weights: np.ndarray, offsets: np.ndarray, scale: float = 1.0, out: str = "class", confidence: str = "confidence", batch: int = 1024) -> DataFrame:
    """``df`` with the class of the highest score (the first, if several) and its softmax share, of scores ``scale * (weights . vector +
    offsets)``. Null for a null vector."""
    sent = df.sparkSession.sparkContext.broadcast((weights, offsets))

    def load():
        w, b = sent.value

        def predict(x: np.ndarray) -> dict[str, np.ndarray]:
            scores = scale * (x.astype(np.float64) @ w.T + b)
            best = scores.argmax(1)
            shares = np.exp(scores - scores.max(1, keepdims=True))
            return {"i": best.astype(np.int32), "p": 1 / shares.sum(1)}

        return predict

    kind = StructType([StructField("i", IntegerType()), StructField("p", DoubleType())])
    predict = predict_batch_udf(load, return_type=kind, batch_size=batch, input_tensor_shapes=[[weights.shape[1]]])
    known = F.col(vector).isNotNull()
    filled = F.coalesce(F.col(vector).cast("array<double>"), F.array_repeat(F.lit(0.0), weights.shape[1]))
    found = df.withColumn("__p", predict(filled))
    names = F.array(*map(F.lit, classes))
    return found.withColumns({out: F.when(known, F.get(names, F.col("__p.i"))), confidence: F.when(known, F.col("__p.p"))}).drop("__p")

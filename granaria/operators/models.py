"""Prototype and gate fitting with the built-in machine-learning library.

Centroid prototypes are exact aggregates (``plans.evaluation``); clustered prototypes and the gate are fitted here. The
scaler uses the population deviation, so it is computed and applied by hand; the gate is an L2-regularised logistic
regression on balanced weights. Both are checked by property, not by value: cluster seeds differ between libraries.

Odd input: a class with fewer rows than clusters repeats its last prototype; empty input raises.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granaria.functions.vectors import l2


def kmeans_prototypes(rows: DataFrame, label: str, vector: str, k: int = 4, seed: int = 42) -> DataFrame:
    """(label, k, vec): ``k`` unit prototypes of each class. Classes are a fixed few, so fitting loops over them."""
    spark = rows.sparkSession
    out = []
    for value in [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]:
        part = rows.where(F.col(label) == value).select(array_to_vector(vector).alias("features")).cache()
        n = part.count()
        centers = [list(map(float, c)) for c in KMeans(k=min(k, n), seed=seed).fit(part).clusterCenters()] if n > 1 else [list(map(float, part.first()["features"]))]
        centers += [centers[-1]] * (k - len(centers))
        out += [(value, i, c) for i, c in enumerate(centers)]
        part.unpersist()
    frame = spark.createDataFrame(out, f"{label} {rows.schema[label].dataType.simpleString()}, k int, vec array<double>")
    return frame.withColumn("vec", l2(F.col("vec")))


def fit_gate(rows: DataFrame, features: str, known: str, width: int, c: float = 1.0) -> dict:
    """mean, scale, weights and bias of a gate that tells known from unknown rows."""
    stats = rows.agg(
        *[F.avg(F.get(features, F.lit(i))).alias(f"m{i}") for i in range(width)], *[F.stddev_pop(F.get(features, F.lit(i))).alias(f"s{i}") for i in range(width)],
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(known)).alias("k"),
    ).first()
    mean, scale = [stats[f"m{i}"] for i in range(width)], [max(stats[f"s{i}"], 1e-12) for i in range(width)]
    n, k = stats["n"], stats["k"]
    if not 0 < k < n:
        raise ValueError("a gate needs known and unknown rows")
    z = F.array(*[(F.get(features, F.lit(i)) - mean[i]) / scale[i] for i in range(width)])
    weight = F.when(F.col(known), n / (2.0 * k)).otherwise(n / (2.0 * (n - k)))
    data = rows.select(array_to_vector(z).alias("features"), F.col(known).cast("double").alias("label"), weight.alias("weight"))
    model = LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, weightCol="weight", maxIter=200, tol=1e-9).fit(data)
    return {"mean": mean, "scale": scale, "weights": [float(x) for x in model.coefficients], "bias": float(model.intercept)}

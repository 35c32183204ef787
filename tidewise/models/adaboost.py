"""AdaBoost.R2 on Spark's trees: a weight column is written anew each round, and the forecast is a weighted median over the trees.

Each round fits a weighted tree, measures every row's error as a share of the largest, and lowers the weights of rows that it gets right.
The rows with their weights are cut from their past every few rounds, so that plans stay short; a round brings two numbers to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.storage import cut

#: Depth of the trees, and rounds after which the weights are cut from their past.
DEPTH, EVERY = 3, 8


def weighted_median(values: Column, weights: Column) -> Column:
    """Of an array the first value, in order, at which half of the weight is reached."""
    pairs = F.sort_array(F.zip_with(values, weights, lambda v, w: F.struct(v.alias("v"), w.alias("w"))))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("v"))
    step = lambda a, p: F.struct((a["sum"] + p["w"]).alias("sum"), F.when(a["v"].isNull() & (a["sum"] + p["w"] >= total / 2), p["v"]).otherwise(a["v"]).alias("v"))
    return F.aggregate(pairs, start, step, lambda a: a["v"])


def fit(rows: DataFrame, features: list[str], target: str, n_estimators: int, learning_rate: float) -> list[tuple[DecisionTreeRegressionModel, float]]:
    """Trees and their weights; it ends early when a tree is perfect or no better than chance."""
    assembler = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip")
    data = cut(assembler.transform(rows.select(*(F.col(c).cast("double").alias(c) for c in features), F.col(target).cast("double").alias("_y")).dropna()).select("x", "_y", F.lit(1.0).alias("_w")))
    trees: list[tuple[DecisionTreeRegressionModel, float]] = []
    for k in range(n_estimators):
        tree = DecisionTreeRegressor(featuresCol="x", labelCol="_y", weightCol="_w", predictionCol="_p", maxDepth=DEPTH, seed=k).fit(data)
        found = tree.transform(data).withColumn("_e", F.abs(F.col("_y") - F.col("_p"))).drop("_p")
        most, total, error, n = found.agg(F.max("_e"), F.sum("_w"), F.sum(F.col("_w") * F.col("_e")), F.count("*")).first()
        if not most:
            trees.append((tree, 1.0))
            break
        share = error / (total * most)
        if share >= 0.5:
            if not trees:
                trees.append((tree, 1.0))
            break
        beta = share / (1 - share)
        trees.append((tree, learning_rate * math.log(1 / beta)))
        # Weights are shares of their sum times the number of rows, so that they keep their digits.
        data = found.withColumn("_w", F.col("_w") * (n / total) * F.pow(F.lit(beta), (1 - F.col("_e") / most) * learning_rate)).drop("_e")
        if (k + 1) % EVERY == 0:
            data = cut(data)
    return trees


def predictor(trees: list[tuple[DecisionTreeRegressionModel, float]], features: list[str]) -> Callable[[DataFrame], DataFrame]:
    def add(frame: DataFrame) -> DataFrame:
        out = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(frame)
        names = []
        for k, (tree, _) in enumerate(trees):
            names.append(f"_p{k}")
            out = tree.copy({tree.featuresCol: "_x", tree.predictionCol: names[-1]}).transform(out)
        yhat = weighted_median(F.array(*names), F.array(*(F.lit(float(w)) for _, w in trees)))
        return out.withColumn("yhat", yhat).drop("_x", *names)

    return add

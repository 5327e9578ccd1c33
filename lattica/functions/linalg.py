"""Matrices in coordinates (i, j, v) and element functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matmul(a: DataFrame, b: DataFrame, transposed_a: bool = False, transposed_b: bool = False) -> DataFrame:
    """A·B; a flag says that the operand is stored transposed. One join on the inner index, partial sums, one shuffle."""
    a = transposed(a) if transposed_a else a
    b = transposed(b) if transposed_b else b
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """A + B, a new matrix; entries that only one has count."""
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v"))


def applied(a: DataFrame, function: str) -> DataFrame:
    """relu or sigmoid of each entry; any other name is relu."""
    return a.withColumn("v", sigmoid(F.col("v")) if function == "sigmoid" else relu(F.col("v")))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def squared_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "w"), ["i", "j"]).select("i", "j", ((F.col("v") - F.col("w")) * (F.col("v") - F.col("w"))).alias("v"))


def quantised(x: Column, scale: float) -> Column:
    """int8 by scaling, towards zero, within [-127, 127]."""
    return F.greatest(F.least((x * scale).cast("int"), F.lit(127)), F.lit(-127))

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import linalg, training, vectors


def matrix(spark, rows):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(rows) for j, v in enumerate(row)], "i long, j long, v double")


def dense(df, n, m):
    out = np.zeros((n, m))
    for r in df.collect():
        out[r.i, r.j] = r.v
    return out.tolist()


def test_worked_examples(spark):
    a, b = matrix(spark, [[0, 1], [2, 3], [4, 5], [6, 7]]), matrix(spark, [[-1], [-1]])
    assert dense(linalg.matmul(a, b), 4, 1) == [[-1], [-5], [-9], [-13]]
    assert dense(linalg.matmul(linalg.transposed(a), b, transposed_a=True), 4, 1) == [[-1], [-5], [-9], [-13]]
    assert dense(linalg.matmul(a, linalg.transposed(b), transposed_b=True), 4, 1) == [[-1], [-5], [-9], [-13]]
    c, d = matrix(spark, [[1, 2, 3], [4, 5, 6]]), matrix(spark, [[0.5, 1.5, 2.5], [3.5, 4.5, 5.5]])
    assert dense(linalg.add(c, d), 2, 3) == [[1.5, 3.5, 5.5], [7.5, 9.5, 11.5]]
    assert dense(linalg.transposed(c), 3, 2) == [[1, 4], [2, 5], [3, 6]]
    assert dense(linalg.applied(matrix(spark, [[-1, 2]]), "relu"), 1, 2) == [[0, 2]]
    assert dense(linalg.applied(matrix(spark, [[0]]), "sigmoid"), 1, 1) == [[0.5]]


def test_similarities(spark):
    x, y = [1.0, 2.0, -1.0], [0.5, -1.0, 2.0]
    row = spark.createDataFrame([(x, y)], "a array<double>, b array<double>")
    got = row.select(vectors.cosine(F.col("a"), F.col("b")), vectors.dot(F.col("a"), F.col("b")), vectors.squared_l2(F.col("a"), F.col("b")), vectors.manhattan(F.col("a"), F.col("b"))).first()
    a, b = np.array(x), np.array(y)
    assert list(got) == pytest.approx([a @ b / np.linalg.norm(a) / np.linalg.norm(b), a @ b, ((a - b) ** 2).sum(), 1 / (1 + abs(a - b).sum())])
    with pytest.raises(ValueError):
        vectors.combined(F.col("a"), F.col("b"), (1.0, 1.0, 1.0))


def test_mean_embedding(spark):
    edges = [(0, 2), (1, 2), (2, 3), (3, 0)]
    n = 4
    m = np.zeros((n, n))
    for v in range(n):
        into = [a for a, b in edges if b == v]
        for a in into:
            m[v, a] = 1 / len(into)
    x = np.arange(8.0).reshape(n, 2)
    features = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(n) for j in range(2)], "id long, dim long, v double")
    for rounds in (1, 3):
        got = np.zeros((n, 2))
        for r in vectors.mean_embedding(features, spark.createDataFrame(edges, "src long, dst long"), rounds).collect():
            got[r.id, r.dim] = r.v
        assert got == pytest.approx(np.linalg.matrix_power(np.eye(n) + m, rounds) @ m @ x)


def test_metrics_and_samples(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "vid long")
    row = vectors.metrics(ids(1, 2, 3), ids(2, 3, 4), ids(1, 2, 3, 4, 5)).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (2, 1, 1, 1)
    assert row.f1 == pytest.approx(2 / 3)
    empty = vectors.metrics(ids(), ids(), ids(1)).first()
    assert (empty.precision, empty.recall, empty.f1) == (0, 0, 0)
    found = vectors.training_samples(ids(*range(10)), ids(*range(200))).collect()
    assert sum(r.y for r in found) == 10 and len(found) == 20
    strata = vectors.stratified(ids(*range(50)).withColumn("y", (F.col("vid") % 2).cast("int")))
    assert sorted((r.y, r.part, r["count"]) for r in strata.groupBy("y", "part").count().collect()) == [(0, "test", 3), (0, "train", 22), (1, "test", 3), (1, "train", 22)]
    train, test = vectors.split(ids(*range(500)).withColumn("y", F.lit(1)))
    assert train.count() + test.count() == 500 and 400 < train.count() < 490


def test_predict(spark):
    network = {"w1": [[1.0, 0.0], [0.0, 1.0]], "b1": [0.0, 0.0], "w2": [2.0, -2.0], "b2": 0.0}
    assert training.set_parameters(training.get_parameters(network)) == network
    with pytest.raises(ValueError):
        training.set_parameters(training.get_parameters(network | {"b1": [0.0]}))
    rows = training.predict(spark.createDataFrame([([3.0, 1.0], 1), ([1.0, 3.0], 0)], "x array<double>, y int"), network)
    assert all(r.predicted == r.y for r in rows.collect()) and training.squared_loss(rows).first().loss < 0.01


def test_perceptron_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] > 0).astype(float)
    w = training.fit_perceptron(x, y)
    h = np.maximum(x @ np.array(w["w1"]).T + w["b1"], 0)
    p = 1 / (1 + np.exp(-(h @ np.array(w["w2"]) + w["b2"])))
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.9

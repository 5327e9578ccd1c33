"""Similarities, small networks, mean aggregation, sampling and metrics; all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.structure import running
from ..storage import bucketed, released
from . import hashes
from .linalg import relu, sigmoid


def _folded(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _folded(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    norm = lambda x: F.greatest(F.sqrt(dot(x, x)), F.lit(1e-8))
    return dot(a, b) / (norm(a) * norm(b))


def squared_l2(a: Column, b: Column) -> Column:
    return _folded(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))


def manhattan(a: Column, b: Column) -> Column:
    """1 / (1 + L1 distance)."""
    return 1 / (1 + _folded(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def combined(a: Column, b: Column, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    """Array of the weighted cosine, dot and squared distance; weights add up to 1."""
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError("weights add up to 1")
    return F.array(weights[0] * cosine(a, b), weights[1] * (dot(a, b) + 1) / 2, weights[2] * squared_l2(a, b))


def against(vectors: DataFrame, vec_id: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """a, b, va, vb: every vector beside the one named (a single row, broadcast)."""
    one = vectors.filter(F.col(id_col) == vec_id).select(F.col(id_col).alias("a"), F.col(vector_col).alias("va")).limit(1)
    return vectors.select(F.col(id_col).alias("b"), F.col(vector_col).alias("vb")).crossJoin(F.broadcast(one))


def perceptron(x: Column, w1: list[list[float]], b1: list[float], w2: list[float], b2: float) -> Column:
    """sigmoid(W2 · relu(W1 x + b1) + b2) of an array column."""
    hidden = [relu(dot(x, F.array(*map(F.lit, row))) + F.lit(b)) for row, b in zip(w1, b1)]
    total = F.lit(b2)
    for h, w in zip(hidden, w2):
        total = total + h * F.lit(w)
    return sigmoid(total)


def learned_filter(pairs: DataFrame, w1, b1, w2, b2, threshold: float = 0.1) -> DataFrame:
    """Pairs (a, va, b, vb) whose squared difference the network scores at ``threshold`` or more, with p."""
    difference = F.zip_with("va", "vb", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    scored = pairs.withColumn("d", difference).withColumn("p", perceptron(F.col("d"), w1, b1, w2, b2))
    return scored.filter(F.col("p") >= threshold).select("a", "b", "p")


def in_means(features: DataFrame, edges: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """id, dim, v: the mean over in-neighbours; 0 where there are none. ``counts``: id, n (in-degrees), if known."""
    got = edges.join(features, edges["src"] == features["id"]).groupBy(F.col("dst").alias("id"), "dim").agg(F.sum("v").alias("s"))
    n = in_counts(edges) if counts is None else counts
    means = got.join(n, "id").select("id", "dim", (F.col("s") / F.col("n")).alias("m"))
    return features.select("id", "dim").join(means, ["id", "dim"], "left").select("id", "dim", F.coalesce("m", F.lit(0.0)).alias("v"))


def in_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))


def mean_embedding(features: DataFrame, edges: DataFrame, rounds: int = 1) -> DataFrame:
    """(I + M)^rounds · M · X, with M the mean over in-neighbours.

    Edges lie in buckets of their source, in-degrees are counted once, and each
    round reads what the one before has stored.
    """
    edges = bucketed(edges.select("src", "dst"), "edges", "src")
    n = bucketed(in_counts(edges), "counts", "id", placed=True)
    x = bucketed(in_means(features, edges, n), "means", "id")
    for _ in range(rounds):
        m = in_means(x, edges, n).withColumnRenamed("v", "m")
        after = bucketed(x.join(m, ["id", "dim"]).select("id", "dim", (F.col("v") + F.col("m")).alias("v")), "means", "id")
        released(x)
        x = after
    released(edges, n)
    return x


def metrics(truth: DataFrame, predicted: DataFrame, universe: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy over ids; 0 where a denominator is 0."""
    marks = universe.select("vid").distinct().join(truth.select("vid").distinct().withColumn("t", F.lit(1)), "vid", "full").join(predicted.select("vid").distinct().withColumn("p", F.lit(1)), "vid", "full")
    count = lambda t, p: F.count_if((F.col("t").isNotNull() == t) & (F.col("p").isNotNull() == p))
    sums = marks.agg(count(True, True).alias("tp"), count(False, True).alias("fp"), count(True, False).alias("fn"), count(False, False).alias("tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = F.col
    rates = sums.withColumns({"precision": share(c("tp"), c("tp") + c("fp")), "recall": share(c("tp"), c("tp") + c("fn")), "accuracy": share(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn"))})
    return rates.withColumn("f1", share(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def first_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the least md5 of ``key``, ties by the key.

    Sums over 4096 ranges of the hash tell where the cut lies; only that range's
    rows are ranked.
    """
    hashed = df.withColumn("__h", F.md5(F.col(key).cast("string"))).withColumn("__r", F.substring("__h", 1, 3))
    before = 0
    for r, size in sorted(hashed.groupBy("__r").count().collect()):
        if before + size > n:
            break
        before += size
    else:
        return df
    inside = hashed.filter(F.col("__r") == r).withColumn("__n", F.row_number().over(Window.partitionBy("__r").orderBy("__h", key))).filter(F.col("__n") <= n - before).drop("__n")
    return hashed.filter(F.col("__r") < r).unionByName(inside).drop("__h", "__r")


def training_samples(truth: DataFrame, universe: DataFrame) -> DataFrame:
    """vid, y: all of ``truth`` as 1, and as many others in seeded order as 0."""
    yes = truth.select("vid").distinct()
    no = universe.select("vid").distinct().join(yes, "vid", "left_anti")
    return yes.withColumn("y", F.lit(1)).unionByName(first_by_hash(no, "vid", yes.count()).withColumn("y", F.lit(0)))


def split(samples: DataFrame, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(train, test): about ``percent`` of each class, by a hash of the id."""
    place = F.pmod(hashes.portable(F.lit(7), "vid"), F.lit(100))
    return samples.filter(place < percent), samples.filter(place >= percent)


def stratified(samples: DataFrame, percent: int = 90, label: str = "y") -> DataFrame:
    """``samples`` with ``part``: train for exactly floor(n * percent / 100) rows of each class, those of least hash, else test."""
    hashed = samples.withColumn("__h", hashes.portable(F.lit(7), "vid"))
    place = running(hashed, [label, "__h", "vid"], "__at")
    sizes = samples.groupBy(label).agg(F.count("*").alias("__size"))
    first = F.broadcast(sizes.withColumn("__first", F.sum("__size").over(Window.orderBy(label)) - F.col("__size")))
    cut = F.floor(F.col("__size") * percent / 100)
    return place.join(first, label).withColumn("part", F.when(F.col("__at") - F.col("__first") < cut, "train").otherwise("test")).select(*samples.columns, "part")


def training_set(truth: DataFrame, universe: DataFrame, embeddings: DataFrame, pivot: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vid, y, x (the three combined similarities to vector ``pivot``), part (train, test) of the samples that have a vector."""
    pairs = against(embeddings, pivot, id_col, vector_col).select(F.col("b").cast("long").alias("vid"), combined(F.col("va"), F.col("vb")).alias("x"))
    return stratified(training_samples(truth, universe).join(pairs, "vid").select("vid", "y", "x"))

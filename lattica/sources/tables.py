"""Graphs over the star-schema tables: (vertices, edges) as plain DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dealt

#: Vertex ids of the property graph are label * SPACE + key.
SPACE = 1_000_000_000
CUSTOMER, ORDER, PART, SUPPLIER, NATION = 1, 2, 3, 4, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges order -> customer in one id space: out-degree 1, long paths."""
    return dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("src"), F.col("o_custkey").cast("long").alias("dst")), "src", "dst").distinct()


def supply_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges part -> supplier in one id space: a dense core."""
    return dealt(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("src"), F.col("l_suppkey").cast("long").alias("dst")), "src", "dst").distinct()


def property_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """vertices(id, label) and edges(src, dst, label, src_label, dst_label)."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda label, c: (F.lit(label * SPACE) + F.col(c)).cast("long")
    kinds = ((CUSTOMER, "customer", "c_custkey"), (ORDER, "orders", "o_orderkey"), (PART, "part", "p_partkey"), (SUPPLIER, "supplier", "s_suppkey"), (NATION, "nation", "n_nationkey"))
    ties = (
        (0, "orders", CUSTOMER, "o_custkey", ORDER, "o_orderkey"),
        (1, "lineitem", ORDER, "l_orderkey", PART, "l_partkey"),
        (2, "lineitem", ORDER, "l_orderkey", SUPPLIER, "l_suppkey"),
        (3, "customer", CUSTOMER, "c_custkey", NATION, "c_nationkey"),
        (4, "supplier", SUPPLIER, "s_suppkey", NATION, "s_nationkey"),
    )
    vertices = edges = None
    for label, name, c in kinds:
        part = t(name).select(key(label, c).alias("id"), F.lit(label).cast("long").alias("label"))
        vertices = part if vertices is None else vertices.union(part)
    for label, name, a, ca, b, cb in ties:
        part = dealt(t(name).select(key(a, ca).alias("src"), key(b, cb).alias("dst")), "src", "dst").distinct()
        part = part.select("src", "dst", *[F.lit(x).cast("long").alias(n) for x, n in ((label, "label"), (a, "src_label"), (b, "dst_label"))])
        edges = part if edges is None else edges.union(part)
    return vertices, edges


def vectors_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a matrix in coordinates: i (vector), j (dimension), v."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))

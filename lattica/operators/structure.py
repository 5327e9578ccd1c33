"""Degrees, ids, adjacency, order, labels and statistics of a graph given as edges(src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashes
from ..storage import dealt, stored


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct vertex ids. Exploding both ends reads the edges once, not twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def edge_stats(edges: DataFrame) -> DataFrame:
    """n_vertices, n_edges, min_vid, max_vid in one row."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return ends.agg(F.count("*").alias("n_vertices"), (F.coalesce(F.sum("n"), F.lit(0)) / 2).cast("long").alias("n_edges"), F.min("id").alias("min_vid"), F.max("id").alias("max_vid"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree: one shuffle of partial sums over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def transpose(edges: DataFrame) -> DataFrame:
    """Edges the other way round; other columns stay."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge both ways, once."""
    return dealt(edges.select("src", "dst").union(transpose(edges).select("src", "dst")), "src", "dst").distinct()


def induced_view(edges: DataFrame, strategy: str) -> DataFrame:
    """vertex, other: edges stored by their target ("in"), source ("out") or both ends ("both")."""
    out = edges.select(F.col("src").alias("vertex"), F.col("dst").alias("other"))
    into = edges.select(F.col("dst").alias("vertex"), F.col("src").alias("other"))
    return {"in": into, "out": out, "both": out.union(into)}[strategy]


def running(df: DataFrame, keys: list[str], name: str, value: str | None = None) -> DataFrame:
    """Adds the number of rows before each one (or the sum of ``value`` over them) by ascending ``keys``.

    The rows are dealt to as many ranges of the keys as there are shuffle
    partitions, and written so with their range; inside a range a window counts,
    and the sums of the ranges before it are added. Only one row a range is
    ordered in one place, and ties in the first key do not pile up in a range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    amount = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    dealt = df.withColumn("__n", amount).repartitionByRange(parts, *keys).withColumn("__range", F.spark_partition_id())
    placed = stored(dealt, "ranges")
    sums = placed.groupBy("__range").agg(F.sum("__n").alias("__s"))
    before = sums.withColumn("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    inside = Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("__i", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    return ranked.join(F.broadcast(before), "__range").withColumn(name, F.col("__b") + F.col("__i")).drop("__range", "__b", "__i", "__n")


def dense_ids(vertices: DataFrame) -> DataFrame:
    """id, dense_id: 0, 1, ... by ascending id."""
    return running(vertices.select("id"), ["id"], "dense_id")


def first_appearance_ids(edges: DataFrame, position: str) -> DataFrame:
    """id, dense_id: 0, 1, ... by first appearance along ``position``, the source before the target."""
    seen = edges.select(F.posexplode(F.array("src", "dst")).alias("side", "id"), F.col(position).alias("at"))
    first = seen.groupBy("id").agg(F.min(F.col("at") * 2 + F.col("side")).alias("first"))
    return running(first, ["first"], "dense_id").select("id", "dense_id")


def degree_order(edges: DataFrame) -> DataFrame:
    """id, rank: vertices by descending out-degree, then id."""
    return running(degrees(edges).withColumn("less", -F.col("out_degree")), ["less", "id"], "rank").select("id", "rank")


def csr_offsets(edges: DataFrame) -> DataFrame:
    """id, out_offset: out-edges of all vertices with a lesser id."""
    return running(degrees(edges), ["id"], "out_offset", "out_degree").select("id", "out_offset")


def adjacency(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, in_nbrs, out_nbrs (sorted): the compressed-row view."""
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("o"), F.lit(None).cast("long").alias("i")).union(edges.select(F.col("dst").alias("id"), F.lit(None).cast("long").alias("o"), F.col("src").alias("i")))
    lists = ends.groupBy("id").agg(F.sort_array(F.collect_list("i")).alias("in_nbrs"), F.sort_array(F.collect_list("o")).alias("out_nbrs"))
    return lists.select("id", F.size("in_nbrs").cast("long").alias("in_degree"), F.size("out_nbrs").cast("long").alias("out_degree"), "in_nbrs", "out_nbrs")


def adjacency_edges(rows: DataFrame) -> DataFrame:
    """id, pos, nbr: the out-lists taken apart again."""
    return rows.select("id", F.posexplode("out_nbrs").alias("pos", "nbr")).select("id", F.col("pos").cast("long").alias("pos"), "nbr")


def modulo_labels(vertices: DataFrame, classes: int = 5) -> DataFrame:
    """id, label in [0, classes): the id modulo ``classes``."""
    return vertices.select("id", F.pmod(F.col("id"), F.lit(classes)).alias("label"))


def random_labels(vertices: DataFrame, classes: int = 5, seed: int = 0) -> DataFrame:
    """id, label in [0, classes): the id and a seeded hash of it added up, so reruns agree."""
    return vertices.select("id", F.pmod(hashes.portable(F.lit(seed), "id") + F.col("id"), F.lit(classes)).alias("label"))


def local_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """src, dst as the dense ids of ``ids`` (id, dense_id); ends that it lacks are left out."""
    name = lambda end: ids.select(F.col("id").alias(end), F.col("dense_id").alias(f"__{end}"))
    return edges.join(name("src"), "src").join(name("dst"), "dst").select(F.col("__src").alias("src"), F.col("__dst").alias("dst"))


def global_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The way back: dense ids as the ids they stand for."""
    return local_edges(edges, ids.select(F.col("dense_id").alias("id"), F.col("id").alias("dense_id")))


def one_hot(vertices: DataFrame, classes: int = 64) -> DataFrame:
    """id, dim, v: 1.0 at the label's place, 0.0 elsewhere."""
    return vertices.select("id", "label", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("dim")).select("id", F.col("dim").cast("long").alias("dim"), (F.col("dim") == F.col("label")).cast("double").alias("v"))


def label_schema(edges: DataFrame) -> DataFrame:
    """Distinct (src_label, label, dst_label) with their counts."""
    return edges.groupBy("src_label", "label", "dst_label").agg(F.count("*").alias("cnt"))


def set_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """idx_a, idx_b: places of common values in the two sorted sets (columns ``v``)."""
    a = running(left.select("v").distinct(), ["v"], "idx_a")
    b = running(right.select("v").distinct(), ["v"], "idx_b")
    return a.join(b, "v").select("idx_a", "idx_b")


def packed_sets(df: DataFrame, key: str, item: str) -> DataFrame:
    """key, word, bits: each key's set of items as 32-bit words held in longs."""
    return df.groupBy(key, F.shiftright(item, 5).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({item}, 32) as int))")).alias("bits"))

"""Pivot documents: a graph cut into nested documents, one a pivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashes
from .traversal import khop_edges


def pivot_edges(edges: DataFrame, mode: str, hops: int = 2) -> DataFrame:
    """pivot, src, dst: ``source`` groups by source, ``k_hop`` by neighbourhood, ``single`` is one group."""
    if mode == "source":
        return edges.select(F.concat(F.lit("pg_"), F.col("src")).alias("pivot"), "src", "dst")
    if mode == "k_hop":
        return khop_edges(edges, hops).select(F.concat(F.lit("pg_"), F.col("center")).alias("pivot"), "src", "dst")
    if mode == "single":
        return edges.select(F.lit("pg_0").alias("pivot"), "src", "dst")
    raise ValueError(f"no pivot mode {mode!r}")


def pivot_stats(found: DataFrame) -> DataFrame:
    """pivot_id, n_vertices, n_edges."""
    ends = found.select("pivot", F.explode(F.array("src", "dst")).alias("id")).distinct().groupBy("pivot").agg(F.count("*").alias("n_vertices"))
    return found.groupBy("pivot").agg(F.count("*").alias("n_edges")).join(ends, "pivot").select(F.col("pivot").alias("pivot_id"), "n_vertices", "n_edges")


def default_label(vertex: Column, kinds: int = 1) -> Column:
    """``default``, or one of ``default_0``, ... by a hash of the id."""
    return F.lit("default") if kinds <= 1 else F.concat(F.lit("default_"), F.pmod(hashes.portable(F.lit(42), vertex), F.lit(kinds)))


def pivot_documents(found: DataFrame, graph_id: int, business_id: int, time: str, pivot_time: str, kinds: int = 1, edge_label: str = "default") -> DataFrame:
    """One nested document a pivot, ready for ``write.json``."""
    # documents are built after the shuffle, which then carries two ids an edge
    attrs = F.array(F.struct(F.lit("placeholder").alias("key"), F.lit("0").alias("value")))
    label = lambda c: default_label(c, kinds)
    edge = lambda e: F.struct(F.concat_ws("_", F.lit("e"), e["src"], e["dst"]).alias("id"), F.lit(edge_label).alias("label"), e["src"].cast("string").alias("srcId"), e["dst"].cast("string").alias("dstId"), F.lit(time).alias("time"), label(e["dst"]).alias("dstLabel"), label(e["src"]).alias("srcLabel"), attrs.alias("attrs"))
    pairs = found.groupBy("pivot").agg(F.collect_list(F.struct("src", "dst")).alias("pairs"))
    grouped = pairs.select("pivot", F.sort_array(F.transform("pairs", edge)).alias("edges"), F.sort_array(F.array_distinct(F.flatten(F.transform("pairs", lambda e: F.array(e["src"], e["dst"]))))).alias("ids"))
    vertex = lambda v: F.struct(v.cast("string").alias("id"), F.lit(time).alias("time"), default_label(v, kinds).alias("label"), attrs.alias("attrs"))
    main = F.struct(F.transform("ids", vertex).alias("vertices"), "edges")
    return grouped.select(F.lit(graph_id).alias("graph_id"), F.lit(business_id).alias("business_id"), F.col("pivot").alias("pivot_graph_id"), F.lit(time).alias("_time"), F.lit(pivot_time).alias("_pivot_time"), F.struct(main.alias("main")).alias("graph"))


def write_pivots(found: DataFrame, path: str, graph_id: int, business_id: int, time: str, pivot_time: str, kinds: int = 1, edge_label: str = "default", compression: str = "none") -> None:
    """Three folders of JSON lines under ``path``: pivot_graphs, pivot_graph_ids and graph_structure (one row).

    The structure counts vertices and edges of the whole graph and lists the
    vertex labels and the label triples of its edges; both lists are as short as
    the graph's schema.
    """
    edges = found.select("src", "dst").distinct()
    label = lambda c: default_label(F.col(c), kinds)
    triples = edges.select(label("src").alias("src_label"), F.lit(edge_label).alias("label"), label("dst").alias("dst_label")).distinct().withColumn("attrs", F.array().cast("array<string>"))
    vertices = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    labels = vertices.select(label("id").alias("label")).distinct().withColumn("attrs", F.array().cast("array<string>"))
    listed = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
    n, m = vertices.agg(F.count("*").alias("num_vertices")), edges.agg(F.count("*").alias("num_edges"))
    one = listed(labels, "vertices").crossJoin(listed(triples, "edges")).crossJoin(n).crossJoin(m)
    shape = one.select(F.lit(graph_id).alias("graph_id"), F.lit(business_id).alias("business_id"), "num_vertices", "num_edges", F.size("vertices").alias("num_vertex_labels"), F.size("edges").alias("num_edge_label_triples"), "vertices", "edges")
    shape.coalesce(1).write.json(f"{path}/graph_structure", compression=compression)
    ids = found.select(F.lit(graph_id).alias("graph_id"), F.lit(business_id).alias("business_id"), F.col("pivot").alias("pivot_graph_id")).distinct()
    ids.write.json(f"{path}/pivot_graph_ids", compression=compression)
    pivot_documents(found, graph_id, business_id, time, pivot_time, kinds, edge_label).write.json(f"{path}/pivot_graphs", compression=compression)

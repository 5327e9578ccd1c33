"""PageRank, breadth-first levels, label propagation, walks, Boolean products and neighbourhoods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import bucketed, bucketed_with, released, rows_total, stored
from .components import connected_components
from .partition import width_of
from .products import Rows, every_pair, pairs, product
from .structure import endpoints


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, max_rounds: int = 10) -> tuple[DataFrame, list[float]]:
    """((id, rank), greatest change of each round).

    Ranks start at 1/N; a vertex without out-edges keeps what flows into it. Ends
    when no rank changes by more than ``tolerance``, or after ``max_rounds``.
    Edges, with 1/out-degree, lie in buckets of their source and ranks in buckets
    of their vertex, so a round shuffles only partial sums of what vertices get.
    """
    if not 0 < damping < 1 or tolerance <= 0 or max_rounds < 1:
        raise ValueError("damping lies between 0 and 1, tolerance and rounds are positive")
    vertices, facts = bucketed_with(endpoints(edges), "vertices", ("id",), rows_total())
    n = facts["n"]
    if not n:
        return vertices.withColumn("rank", F.lit(0.0)), []
    out = edges.groupBy("src").agg(F.count("*").alias("n"))
    weighted = bucketed(edges.join(out, "src").select("src", "dst", (1 / F.col("n")).alias("w")), "weighted", "src")
    now, changes = vertices.withColumn("rank", F.lit(1.0 / n)), []
    held = vertices
    while len(changes) < max_rounds:
        given = weighted.join(now, weighted["src"] == now["id"]).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        after = ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0))).alias("next")
        step = now.join(given, now["id"] == given["to"], "left").select("id", after, F.col("rank").alias("last"))
        ranks, facts = bucketed_with(step, "ranks", ("id",), F.max(F.abs(F.col("next") - F.col("last"))).alias("change"))
        released(held)
        held, now = ranks, ranks.select("id", F.col("next").alias("rank"))
        changes.append(facts["change"])
        if changes[-1] <= tolerance:
            break
    released(weighted)
    return now, changes


def _doubled(jumps: DataFrame) -> tuple[DataFrame, int]:
    """Jumps of twice the length, of those whose end can jump on; and their number."""
    on = jumps.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("hops").alias("more"))
    found = jumps.join(on, "dst").select("src", F.col("to").alias("dst"), (F.col("hops") + F.col("more")).alias("hops"))
    out, facts = bucketed_with(found.repartition("src"), "jumps", ("src",), rows_total())
    return out, facts["n"]


def _spread(start: DataFrame, edges: DataFrame, value: str, step: int) -> DataFrame:
    """The least value each vertex gets when values flow along edges, ``step`` more an edge.

    A round sends the values that fell along all edges, and takes those that are
    less than what is known. Where a vertex has a single out-edge there is no
    choice, so such chains are also jumped: each round sends all values along
    jumps of twice the length of the round before, and a path of L such vertices
    takes about log2(L) rounds instead of L. A jump is worth its number of edges,
    so results are those of the edges alone. Known values, edges and jumps lie in
    buckets; a round shuffles only what was sent.
    """
    links = bucketed(edges.select("src", "dst").filter("src <> dst").distinct().withColumn("hops", F.lit(1).cast("long")), "edges", "src")
    jumps, facts = bucketed_with(links.groupBy("src").agg(F.min("dst").alias("dst"), F.count("*").alias("n")).filter("n = 1").select("src", "dst", F.lit(1).cast("long").alias("hops")), "jumps", ("src",), rows_total())
    chained = left = facts["n"]
    known, facts = bucketed_with(start.select("id", value).repartition("id").withColumn("fell", F.lit(True)), "values", ("id",), rows_total())
    fell, longest = facts["n"], 1
    sent = lambda values, ways: values.join(ways, values["id"] == ways["src"]).select(F.col("dst").alias("to"), (F.col(value) + step * F.col("hops")).alias("got"))
    while fell:
        got = sent(known.filter("fell"), links)
        if longest > 1 and left:
            got = got.unionByName(sent(known, jumps))
        got = got.groupBy("to").agg(F.min("got").alias("got"))
        less = F.col(value).isNull() | (F.col("got") < F.col(value))
        merged = known.join(got, known["id"] == got["to"], "full").select(F.coalesce("id", "to").alias("id"), F.least(value, "got").alias(value), F.coalesce(F.col("got").isNotNull() & less, F.lit(False)).alias("fell"))
        after, facts = bucketed_with(merged, "values", ("id",), F.count_if("fell").alias("fell"))
        released(known)
        known, fell = after, facts["fell"]
        if fell and left and longest <= chained:  # a cycle could be jumped for ever
            further, left = _doubled(jumps)
            released(jumps)
            jumps, longest = further, longest * 2
    released(links, jumps)
    return known.select("id", value)


def bfs(edges: DataFrame, source: int) -> DataFrame:
    """id, level: hops from ``source`` along edges; what is not reached is not there."""
    spark = edges.sparkSession
    return _spread(spark.createDataFrame([(source, 0)], "id long, level long"), edges, "level", 1)


def unreached(edges: DataFrame, levels: DataFrame) -> DataFrame:
    return endpoints(edges).join(levels, "id", "left_anti")


def wcc(edges: DataFrame) -> DataFrame:
    """id, component: weakly connected, named by the least id."""
    return connected_components(edges)


def ancestor_labels(edges: DataFrame) -> DataFrame:
    """id, label: the least id among a vertex and all that reach it along edges."""
    return _spread(endpoints(edges).withColumn("label", F.col("id")), edges, "label", 0)


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def _walk_sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    return left.filter("src <> dst").select(F.col("src").alias("i"), F.col("dst").alias("k")), right.filter("src <> dst").select(F.col("src").alias("k"), F.col("dst").alias("j"))


def walks(left: DataFrame, right: DataFrame) -> DataFrame:
    """src, dst: distinct pairs a -> b -> c with a, b, c all different."""
    return pairs(*_walk_sides(left, right), "src", "dst", others=True)


def walk_count(left: DataFrame, right: DataFrame, name: str = "n") -> DataFrame:
    """How many such pairs there are; a row for each a leaves the workers."""
    return _total(product(*_walk_sides(left, right), "n long", lambda found: (found[1],), others=True), name)


def walk_scope(left: DataFrame, right: DataFrame, chunks: int) -> int:
    """``partition.scope_of`` of the walks."""
    greatest = lambda found: (np.array([max(found[0][found[1] > 0].max(), found[2].max())]),)
    high = product(*_walk_sides(left, right), "high long", greatest, others=True).agg(F.max("high")).first()[0]
    return -(-((high or 0) + 1) // chunks)


def walk_blocks(left: DataFrame, right: DataFrame, chunks: int) -> DataFrame:
    """block_x, block_y, n_edges of the walks cut into a grid; sums of blocks leave the workers."""
    scope = walk_scope(left, right, chunks)

    def counted(found: Rows) -> tuple:
        src, dst = every_pair(found)
        cells, n = np.unique(src // scope * chunks + dst // scope, return_counts=True)
        return cells // chunks, cells % chunks, n

    found = product(*_walk_sides(left, right), "block_x long, block_y long, n long", counted, others=True)
    return found.groupBy("block_x", "block_y").agg(F.sum("n").alias("n_edges"))


def walk_tile_rows(left: DataFrame, right: DataFrame, chunks: int, tile_size: int) -> tuple[DataFrame, int]:
    """(block_x, block_y, tile_x, tile_y, x_in, cols of the walks cut into a grid and tiles, scope of the grid): each row of a tile once, made where its walks are."""
    scope = walk_scope(left, right, chunks)
    size = width_of(scope, tile_size)
    strips = -(-scope // size)

    def cut(found: Rows) -> tuple:
        src, dst = every_pair(found)
        strip = dst // scope * strips + dst % scope // size
        heads = np.flatnonzero(np.r_[True, (src[1:] != src[:-1]) | (strip[1:] != strip[:-1])])
        x, strip = src[heads], strip[heads]
        cols = pa.ListArray.from_arrays(pa.array(np.r_[heads, len(src)].astype(np.int32)), pa.array(dst % scope % size))
        return x // scope, strip // strips, x % scope // size, strip % strips, x % scope % size, cols

    schema = "block_x long, block_y long, tile_x long, tile_y long, x_in long, cols array<long>"
    strip = F.expr(f"j div {scope} * {strips} + j % {scope} div {size}")
    return product(*_walk_sides(left, right), schema, cut, others=True, deal=strip), scope


def _total(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))


def _product_sides(left: DataFrame, right: DataFrame, right_transposed: bool) -> tuple[DataFrame, DataFrame]:
    k, j = ("dst", "src") if right_transposed else ("src", "dst")
    return left.select(F.col("src").alias("i"), F.col("dst").alias("k")), right.select(F.col(k).alias("k"), F.col(j).alias("j"))


def boolean_product(left: DataFrame, right: DataFrame, right_transposed: bool = False) -> DataFrame:
    """i, j of the entries of A·B that are not zero; with ``right_transposed`` of A·Bᵀ."""
    return pairs(*_product_sides(left, right, right_transposed), "i", "j")


def boolean_count(left: DataFrame, right: DataFrame, right_transposed: bool = False, name: str = "nnz") -> DataFrame:
    """How many such entries there are; a row for each i leaves the workers."""
    return _total(product(*_product_sides(left, right, right_transposed), "n long", lambda found: (found[1],)), name)


def khop_edges(edges: DataFrame, hops: int = 2) -> DataFrame:
    """center, src, dst: out-edges of all vertices within ``hops - 1`` steps of each endpoint; hops 0: of all it reaches."""
    sets = stored(endpoints(edges).select(F.col("id").alias("center"), "id"), "reach")
    frontier, turn = sets, 1
    while hops == 0 or turn < hops:
        fresh = frontier.join(edges, frontier["id"] == edges["src"]).select("center", F.col("dst").alias("id")).distinct().join(sets, ["center", "id"], "left_anti")
        if hops == 0 or hops > 3:
            fresh = stored(fresh, "fresh")
            if not fresh.count():
                break
        sets, frontier, turn = sets.union(fresh), fresh, turn + 1
    return sets.join(edges, sets["id"] == edges["src"]).select("center", "src", "dst")


def khop_stats(found: DataFrame) -> DataFrame:
    """center, n_vertices, n_edges of each neighbourhood that has edges."""
    n = found.groupBy("center").agg(F.count("*").alias("n_edges"))
    v = found.select("center", F.explode(F.array("src", "dst")).alias("id")).distinct().groupBy("center").agg(F.count("*").alias("n_vertices"))
    return v.join(n, "center").select("center", "n_vertices", "n_edges")

"""The registered graph queries and the SQL that gives the same rows.

Every query runs over whole tables. g1 is the order graph, g2 the supply graph,
g3 the labelled property graph (see ``sources.tables``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions import hashes, linalg, training, vectors
from .operators import documents, filters, matching, partition, sets, structure, tiled, traversal
from .plans.pattern import Pattern
from .sources import formats
from .sources.tables import CUSTOMER, NATION, ORDER, PART, SUPPLIER, order_graph, property_graph, supply_graph, table, vectors_long
from .storage import new_path, stored

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def keep(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return keep


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}


G1 = "g1 AS (SELECT DISTINCT o_orderkey::BIGINT src, o_custkey::BIGINT dst FROM orders)"
G2 = "g2 AS (SELECT DISTINCT l_partkey::BIGINT src, l_suppkey::BIGINT dst FROM lineitem)"
G3 = """v3 AS (SELECT (1000000000 + c_custkey)::BIGINT id, 1::BIGINT lab FROM customer UNION ALL SELECT (2000000000 + o_orderkey)::BIGINT, 2 FROM orders
 UNION ALL SELECT (3000000000 + p_partkey)::BIGINT, 3 FROM part UNION ALL SELECT (4000000000 + s_suppkey)::BIGINT, 4 FROM supplier UNION ALL SELECT (5000000000 + n_nationkey)::BIGINT, 5 FROM nation),
 g3 AS (SELECT DISTINCT (1000000000 + o_custkey)::BIGINT src, (2000000000 + o_orderkey)::BIGINT dst, 0::BIGINT lab, 1::BIGINT sl, 2::BIGINT dl FROM orders
 UNION ALL SELECT DISTINCT (2000000000 + l_orderkey)::BIGINT, (3000000000 + l_partkey)::BIGINT, 1, 2, 3 FROM lineitem
 UNION ALL SELECT DISTINCT (2000000000 + l_orderkey)::BIGINT, (4000000000 + l_suppkey)::BIGINT, 2, 2, 4 FROM lineitem
 UNION ALL SELECT DISTINCT (1000000000 + c_custkey)::BIGINT, (5000000000 + c_nationkey)::BIGINT, 3, 1, 5 FROM customer
 UNION ALL SELECT DISTINCT (4000000000 + s_suppkey)::BIGINT, (5000000000 + s_nationkey)::BIGINT, 4, 4, 5 FROM supplier)"""
E0 = "e0 AS (SELECT DISTINCT (1000000000 + o_custkey)::BIGINT src, (2000000000 + o_orderkey)::BIGINT dst FROM orders)"
E1 = "e1 AS (SELECT DISTINCT (2000000000 + l_orderkey)::BIGINT src, (3000000000 + l_partkey)::BIGINT dst FROM lineitem)"
E2 = "e2 AS (SELECT DISTINCT (2000000000 + l_orderkey)::BIGINT src, (4000000000 + l_suppkey)::BIGINT dst FROM lineitem)"
E3 = "e3 AS (SELECT DISTINCT (1000000000 + c_custkey)::BIGINT src, (5000000000 + c_nationkey)::BIGINT dst FROM customer)"
E4 = "e4 AS (SELECT DISTINCT (4000000000 + s_suppkey)::BIGINT src, (5000000000 + s_nationkey)::BIGINT dst FROM supplier)"
ENDS = "ends AS (SELECT src id FROM {g} UNION SELECT dst FROM {g})"
DEG = "outd AS (SELECT src id, count(*) n FROM {g} GROUP BY 1), ind AS (SELECT dst id, count(*) n FROM {g} GROUP BY 1), deg AS (SELECT coalesce(outd.id, ind.id) id, coalesce(ind.n, 0)::BIGINT in_degree, coalesce(outd.n, 0)::BIGINT out_degree FROM outd FULL JOIN ind ON outd.id = ind.id)"


# -- structure ----------------------------------------------------------------


@query(f"WITH {G1}, {ENDS.format(g='g1')} SELECT (SELECT count(*) FROM ends)::BIGINT n_vertices, (SELECT count(*) FROM g1)::BIGINT n_edges, (SELECT min(id) FROM ends) min_vid, (SELECT max(id) FROM ends) max_vid")
def edge_stats(spark, sf_dir):
    return structure.edge_stats(order_graph(spark, sf_dir))


@query(f"WITH {G2}, {DEG.format(g='g2')} SELECT * FROM deg")
def degrees(spark, sf_dir):
    return structure.degrees(supply_graph(spark, sf_dir))


@query(f"WITH {G2} SELECT dst src, src dst FROM g2")
def transpose_edges(spark, sf_dir):
    return structure.transpose(supply_graph(spark, sf_dir))


@query(f"WITH {G2} SELECT src, dst FROM g2 UNION SELECT dst, src FROM g2")
def symmetric_edges(spark, sf_dir):
    return structure.symmetric(supply_graph(spark, sf_dir))


@query(f"WITH {G2} SELECT vertex, count(*)::BIGINT n FROM (SELECT src vertex FROM g2 UNION ALL SELECT dst FROM g2) GROUP BY 1")
def store_strategy(spark, sf_dir):
    return structure.induced_view(supply_graph(spark, sf_dir), "both").groupBy("vertex").agg(F.count("*").alias("n"))


@query(f"WITH {G2} SELECT dst vertex, count(*)::BIGINT n, sum(src)::BIGINT s FROM g2 GROUP BY 1")
def store_strategy_in(spark, sf_dir):
    return structure.induced_view(supply_graph(spark, sf_dir), "in").groupBy("vertex").agg(F.count("*").alias("n"), F.sum("other").alias("s"))


@query(f"WITH {G2} SELECT src vertex, count(*)::BIGINT n, sum(dst)::BIGINT s FROM g2 GROUP BY 1")
def store_strategy_out(spark, sf_dir):
    return structure.induced_view(supply_graph(spark, sf_dir), "out").groupBy("vertex").agg(F.count("*").alias("n"), F.sum("other").alias("s"))


@query(f"WITH {G1}, {ENDS.format(g='g1')}, ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 d FROM ends) SELECT a.d src, b.d dst FROM g1 JOIN ids a ON a.id = src JOIN ids b ON b.id = dst")
def local_edges(spark, sf_dir):
    g = order_graph(spark, sf_dir)
    return structure.local_edges(g, structure.dense_ids(structure.endpoints(g)))


@query(f"WITH {G1} SELECT src, dst FROM g1")
def global_edges(spark, sf_dir):
    """Dense ids and back."""
    g = order_graph(spark, sf_dir)
    ids = structure.dense_ids(structure.endpoints(g))
    return structure.global_edges(structure.local_edges(g, ids), ids)


@query(f"WITH {G1}, {ENDS.format(g='g1')} SELECT id, row_number() OVER (ORDER BY id) - 1 dense_id FROM ends")
def dense_ids(spark, sf_dir):
    return structure.dense_ids(structure.endpoints(order_graph(spark, sf_dir)))


@query("WITH p AS (SELECT o_custkey::BIGINT src, (o_orderkey + 10000000)::BIGINT dst, o_orderkey::BIGINT pos FROM orders), s AS (SELECT src id, pos * 2 f FROM p UNION ALL SELECT dst, pos * 2 + 1 FROM p), m AS (SELECT id, min(f) f FROM s GROUP BY 1) SELECT id, row_number() OVER (ORDER BY f) - 1 dense_id FROM m")
def first_appearance_ids(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("src"), (F.col("o_orderkey") + 10000000).cast("long").alias("dst"), F.col("o_orderkey").cast("long").alias("pos"))
    return structure.first_appearance_ids(edges, "pos")


@query(f"WITH {G2}, {DEG.format(g='g2')} SELECT id, row_number() OVER (ORDER BY out_degree DESC, id) - 1 rank FROM deg")
def degree_order(spark, sf_dir):
    return structure.degree_order(supply_graph(spark, sf_dir))


@query(f"WITH {G2}, {DEG.format(g='g2')} SELECT id, coalesce(sum(out_degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT out_offset FROM deg")
def csr_offsets(spark, sf_dir):
    return structure.csr_offsets(supply_graph(spark, sf_dir))


@query(f"WITH {G2} SELECT src id, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 pos, dst nbr FROM g2")
def adjacency_explode(spark, sf_dir):
    return structure.adjacency_edges(structure.adjacency(supply_graph(spark, sf_dir)))


@query(f"WITH {G2} SELECT dst id, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 pos, src nbr FROM g2")
def adjacency_in(spark, sf_dir):
    rows = structure.adjacency(supply_graph(spark, sf_dir))
    return rows.select("id", F.posexplode("in_nbrs").alias("pos", "nbr")).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {G1}, {ENDS.format(g='g1')} SELECT id, (('0x' || substr(md5('3_' || id), 1, 15))::BIGINT + id) % 5 AS label FROM ends")
def random_labels(spark, sf_dir):
    return structure.random_labels(structure.endpoints(order_graph(spark, sf_dir)), seed=3)


FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({t}, ''), lambda c: ord(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


@query(f"WITH t AS (SELECT c_custkey k, c_name t FROM customer UNION ALL SELECT c_custkey, c_custkey::VARCHAR FROM customer) SELECT k::BIGINT k, t, CASE WHEN regexp_full_match(t, '[0-9]+') THEN TRY_CAST(t AS BIGINT) ELSE {FNV.format(t='t')} END::BIGINT id FROM t")
def stable_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.explode(F.array("c_name", F.col("c_custkey").cast("string"))).alias("t"))
    return c.withColumn("id", formats.stable_id("t"))


MUL = "((({x}) & 65535) * {by} + (((({x}) >> 16) * {by}) & 65535) * 65536) & 4294967295"
MIX1 = MUL.format(x="xor(k, k >> 16)", by=2246822507)
MIX2 = MUL.format(x="xor(a, a >> 13)", by=3266489909)


@query(f"WITH t AS (SELECT DISTINCT o_custkey::BIGINT k FROM orders), u AS (SELECT k, {MIX1} a FROM t), v AS (SELECT k, {MIX2} b FROM u) SELECT k, xor(b, b >> 16) h, ([12, 3, 11, 9, 15, 2, 8, 4, 13, 10, 5, 7, 14, 6, 1, 0])[k % 16 + 1]::INT p FROM v")
def hash_functions(spark, sf_dir):
    k = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("k")).distinct()
    return k.select("k", hashes.scattered(F.col("k")).alias("h"), hashes.permuted(F.col("k") % 16).alias("p"))


@query(f"WITH {G2}, {DEG.format(g='g2')} SELECT id, id % 5 AS label, in_degree, out_degree FROM deg ORDER BY in_degree + out_degree DESC, id LIMIT 20")
def graph_report(spark, sf_dir):
    return sinks.graph_report(*formats.graph_of(supply_graph(spark, sf_dir)), 20)


@query(f"WITH {G1}, {ENDS.format(g='g1')} SELECT id, id % 5 AS label FROM ends")
def vertex_labels(spark, sf_dir):
    return structure.modulo_labels(structure.endpoints(order_graph(spark, sf_dir)))


@query(f"WITH {G2}, {ENDS.format(g='g2')} SELECT id, d::BIGINT dim, (CASE WHEN id % 5 = d THEN 1.0 ELSE 0.0 END)::DOUBLE v FROM ends, generate_series(0, 63) t(d)")
def onehot(spark, sf_dir):
    return structure.one_hot(structure.modulo_labels(structure.endpoints(supply_graph(spark, sf_dir))))


@query(f"WITH {G3} SELECT sl src_label, lab AS label, dl dst_label, count(*)::BIGINT cnt FROM g3 GROUP BY ALL")
def label_schema(spark, sf_dir):
    return structure.label_schema(property_graph(spark, sf_dir)[1])


@query(f"WITH {G2}, a AS (SELECT v, row_number() OVER (ORDER BY v) - 1 i FROM (SELECT DISTINCT src v FROM g2)), b AS (SELECT v, row_number() OVER (ORDER BY v) - 1 i FROM (SELECT DISTINCT dst v FROM g2)) SELECT a.i idx_a, b.i idx_b FROM a JOIN b USING (v)")
def set_intersection_idx(spark, sf_dir):
    g = supply_graph(spark, sf_dir)
    return structure.set_intersection(g.select(F.col("src").alias("v")), g.select(F.col("dst").alias("v")))


@query(f"WITH {G2} SELECT src AS key, dst // 32 AS word, bit_or((1::BIGINT << (dst % 32)::INT)) bits FROM g2 GROUP BY 1, 2")
def packed_sets(spark, sf_dir):
    return structure.packed_sets(supply_graph(spark, sf_dir).withColumnRenamed("src", "key"), "key", "dst")


# -- partitions and tiles -----------------------------------------------------

CHUNKS, TILE = 4, 256
SCOPE = "sc AS (SELECT (max(greatest(src, dst)) + 1 + 3) // 4 s FROM g2)"
TILED = "t AS (SELECT (src // s) * 4 + dst // s block_id, (src % s) // 256 tile_x, (dst % s) // 256 tile_y, (src % s) % 256 x_in, (dst % s) % 256 y_in FROM g2, sc)"


def _grid(spark, sf_dir) -> tuple[DataFrame, int]:
    g = supply_graph(spark, sf_dir)
    scope = partition.scope_of(g, CHUNKS)
    return partition.grid(g, CHUNKS, scope), scope


@query(f"WITH {G2}, {SCOPE}, b AS (SELECT src, dst, src // s block_x, dst // s block_y FROM g2, sc), n AS (SELECT block_x, block_y, count(DISTINCT id) n FROM (SELECT block_x, block_y, src id FROM b UNION ALL SELECT block_x, block_y, dst FROM b) GROUP BY 1, 2) SELECT block_x, block_y, count(*)::BIGINT n_edges, any_value(n)::BIGINT n_vertices, min(least(src, dst)) min_vid, max(greatest(src, dst)) max_vid FROM b JOIN n USING (block_x, block_y) GROUP BY 1, 2")
def grid_block_stats(spark, sf_dir):
    return partition.block_stats(_grid(spark, sf_dir)[0])


@query(f"WITH {G2}, {SCOPE} SELECT src // s block_x, dst // s block_y, count(*)::BIGINT n_edges FROM g2, sc GROUP BY 1, 2")
def grid_blocks(spark, sf_dir):
    return _grid(spark, sf_dir)[0].groupBy("block_x", "block_y").agg(F.count("*").alias("n_edges"))


@query(f"WITH {G2}, {SCOPE} SELECT src, dst FROM g2, sc WHERE src // s = 0 AND dst // s = 0")
def grid_block_scan(spark, sf_dir):
    path = partition.stored_blocks(_grid(spark, sf_dir)[0])
    return partition.read_block(spark, path, 0, 0).select("src", "dst")


@query(f"WITH {G2}, {SCOPE}, {TILED} SELECT block_id, tile_x, tile_y, count(*)::BIGINT nnz, row_number() OVER (PARTITION BY block_id ORDER BY tile_x, tile_y) - 1 tile_idx FROM t GROUP BY 1, 2, 3")
def tile_stats(spark, sf_dir):
    blocks, scope = _grid(spark, sf_dir)
    return partition.tile_stats(partition.tiles(blocks, scope, TILE))


@query(f"WITH {G2}, {SCOPE}, {TILED} SELECT block_id, tile_x, tile_y, x_in, y_in // 32 word, bit_or(1::BIGINT << (y_in % 32)::INT) bits FROM t GROUP BY 1, 2, 3, 4, 5")
def bit_tiles(spark, sf_dir):
    blocks, scope = _grid(spark, sf_dir)
    return partition.bit_tiles(partition.tiles(blocks, scope, TILE))


@query(f"WITH {G2} SELECT count(*)::BIGINT nnz FROM g2")
def bit_tile_count(spark, sf_dir):
    return partition.bit_tile_count(bit_tiles(spark, sf_dir))


@query(f"WITH {G2}, t AS (SELECT DISTINCT src // 256 x, dst // 256 k FROM g2) SELECT DISTINCT a.x tile_i, b.x tile_j FROM t a JOIN t b USING (k)")
def tile_layout_product(spark, sf_dir):
    t = supply_graph(spark, sf_dir).select(F.expr("src div 256").alias("tile_x"), F.expr("dst div 256").alias("tile_y"))
    return partition.tile_layout_product(t, t)


@query(f"WITH {G2}, {SCOPE}, w AS (SELECT (s + 6) // 7 w FROM sc), t AS (SELECT (src // s) * 4 + dst // s block_id, (src % s) // w tile_x, (dst % s) // w tile_y FROM g2, sc, w) SELECT block_id, tile_x, tile_y, count(*)::BIGINT nnz, row_number() OVER (PARTITION BY block_id ORDER BY tile_x, tile_y) - 1 tile_idx FROM t GROUP BY 1, 2, 3")
def tile_strips(spark, sf_dir):
    """A tile size under 128 is a number of strips."""
    blocks, scope = _grid(spark, sf_dir)
    return partition.tile_stats(partition.tiles(blocks, scope, 7))


@query(f"WITH {G2} SELECT ('0x' || substr(md5(src::VARCHAR), 1, 15))::BIGINT % 8 part, count(*)::BIGINT n_edges FROM g2 GROUP BY 1")
def hash_edge_cut(spark, sf_dir):
    return partition.part_sizes(partition.edge_cut(supply_graph(spark, sf_dir), 8))


@query(f"WITH {G2} SELECT ('0x' || substr(md5(src || '_' || dst), 1, 15))::BIGINT % 8 part, count(*)::BIGINT n_edges FROM g2 GROUP BY 1")
def hash_vertex_cut(spark, sf_dir):
    return partition.part_sizes(partition.vertex_cut(supply_graph(spark, sf_dir), 8))


# -- analytics ----------------------------------------------------------------


def _rank_sql(last: str) -> str:
    rounds = ["r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM ends) rank FROM ends)"]
    for i in range(10):
        rounds.append(f"r{i + 1} AS (SELECT e.id, 0.15::DOUBLE / (SELECT count(*) FROM ends) + 0.85::DOUBLE * coalesce(s.x, 0) rank FROM ends e LEFT JOIN (SELECT g2.dst id, sum(r.rank / o.n) x FROM g2 JOIN od o ON o.id = g2.src JOIN r{i} r ON r.id = g2.src GROUP BY 1) s ON s.id = e.id)")
    return f"WITH {G2}, {ENDS.format(g='g2')}, od AS (SELECT src id, count(*) n FROM g2 GROUP BY 1), " + ", ".join(rounds) + " " + last


@query(_rank_sql("SELECT id, round(rank, 9) rank FROM r10"))
def pagerank(spark, sf_dir):
    ranks, _ = traversal.pagerank(supply_graph(spark, sf_dir), tolerance=1e-12)
    return ranks.select("id", F.round("rank", 9).alias("rank"))


RESIDUALS = " UNION ALL ".join(f"SELECT {i + 1}::BIGINT iter, max(abs(a.rank - b.rank)) d FROM r{i} a JOIN r{i + 1} b USING (id)" for i in range(10))


@query(_rank_sql(f"SELECT iter, round(d, 9) max_diff FROM (SELECT iter, d, lag(d) OVER (ORDER BY iter) p FROM ({RESIDUALS})) WHERE p IS NULL OR p > 1e-12"))
def pagerank_residual(spark, sf_dir):
    _, changes = traversal.pagerank(supply_graph(spark, sf_dir), tolerance=1e-12)
    return spark.createDataFrame(list(enumerate(changes, 1)), "iter long, max_diff double").withColumn("max_diff", F.round("max_diff", 9))


BFS = f"WITH RECURSIVE {G1}, b AS (SELECT 0::BIGINT id, 0::BIGINT level UNION SELECT g1.dst, b.level + 1 FROM b JOIN g1 ON g1.src = b.id WHERE b.level < 1000), l AS (SELECT id, min(level) level FROM b GROUP BY 1)"


@query(f"{BFS} SELECT * FROM l")
def bfs_levels(spark, sf_dir):
    return traversal.bfs(order_graph(spark, sf_dir), 0)


@query(f"{BFS} SELECT DISTINCT id FROM (SELECT src id FROM g1 UNION SELECT dst FROM g1) WHERE id NOT IN (SELECT id FROM l)")
def bfs_unreached(spark, sf_dir):
    g = order_graph(spark, sf_dir)
    return traversal.unreached(g, traversal.bfs(g, 0))


def _label_sql(both: bool, doublings: int = 200) -> str:
    edges = "SELECT src a, dst b FROM g1 UNION SELECT dst, src FROM g1" if both else "SELECT src a, dst b FROM g1"
    return f"WITH RECURSIVE {G1}, {ENDS.format(g='g1')}, e AS ({edges} UNION SELECT id, id FROM ends), l AS (SELECT id, id lab, 0 k FROM ends UNION ALL (SELECT e.b, min(l.lab), l.k + 1 FROM l JOIN e ON e.a = l.id WHERE l.k < {doublings} GROUP BY e.b, l.k)), w AS (SELECT id, lab FROM l WHERE k = {doublings})"


@query(f"{_label_sql(True)} SELECT id, lab component FROM w")
def wcc(spark, sf_dir):
    return traversal.wcc(order_graph(spark, sf_dir))


@query(f"{_label_sql(False)} SELECT id, lab AS label FROM w")
def hashmin_directed(spark, sf_dir):
    return traversal.ancestor_labels(order_graph(spark, sf_dir))


@query(f"{_label_sql(True)} SELECT lab component, count(*)::BIGINT size FROM w GROUP BY 1")
def component_sizes(spark, sf_dir):
    return traversal.component_sizes(traversal.wcc(order_graph(spark, sf_dir)))


WALK = f"WITH {G2}, w AS (SELECT DISTINCT a.src, b.dst FROM g2 a JOIN g2 b ON a.dst = b.src WHERE a.src <> a.dst AND b.src <> b.dst AND a.src <> b.dst)"


@query(f"{WALK} SELECT src, dst FROM w")
def walk2(spark, sf_dir):
    g = supply_graph(spark, sf_dir)
    return traversal.walks(g, g)


@query(f"{WALK} SELECT count(*)::BIGINT n FROM w")
def walk2_count(spark, sf_dir):
    g = supply_graph(spark, sf_dir)
    return traversal.walk_count(g, g)


@query(f"{WALK}, sc AS (SELECT (max(greatest(src, dst)) + 1 + 3) // 4 s FROM w) SELECT src // s block_x, dst // s block_y, count(*)::BIGINT n_edges FROM w, sc GROUP BY 1, 2")
def walk2_grid(spark, sf_dir):
    g = supply_graph(spark, sf_dir)
    return traversal.walk_blocks(g, g, CHUNKS)


@query(f"{WALK}, sc AS (SELECT (max(greatest(src, dst)) + 1 + 3) // 4 s FROM w) SELECT src // s block_x, dst // s block_y, (src % s) // 256 tile_x, (dst % s) // 256 tile_y, count(*)::BIGINT nnz FROM w, sc GROUP BY 1, 2, 3, 4")
def walk2_tiles(spark, sf_dir):
    """The walks cut into a grid again, tiled, written and read."""
    path = new_path(spark, "walks")
    g = supply_graph(spark, sf_dir)
    rows, scope = traversal.walk_tile_rows(g, g, CHUNKS, TILE)
    tiled.write_csr_rows(rows, path, CHUNKS, scope, TILE)
    return tiled.stored_tile_stats(spark, path)


@query(f"WITH {G2} SELECT DISTINCT a.src i, b.dst j FROM g2 a JOIN g2 b ON a.dst = b.src")
def bool_matmul(spark, sf_dir):
    g = supply_graph(spark, sf_dir)
    return traversal.boolean_product(g, g)


@query(f"WITH {G2} SELECT count(*)::BIGINT nnz FROM (SELECT DISTINCT a.src, b.dst FROM g2 a JOIN g2 b ON a.dst = b.src)")
def bool_nnz(spark, sf_dir):
    """The same product with its right operand stored transposed."""
    g = supply_graph(spark, sf_dir)
    return traversal.boolean_count(g, structure.transpose(g), right_transposed=True)


KHOP = f"WITH {G1}, {ENDS.format(g='g1')}, r AS (SELECT id center, id FROM ends UNION SELECT e.id, g1.dst FROM ends e JOIN g1 ON g1.src = e.id), h AS (SELECT center, src, dst FROM r JOIN g1 ON g1.src = r.id)"
PIVOT = "SELECT {p} pivot_id, count(DISTINCT v)::BIGINT n_vertices, count(DISTINCT src || '_' || dst)::BIGINT n_edges FROM (SELECT {c}, src, dst, unnest([src, dst]) v FROM {t}) GROUP BY 1"


@query(f"{KHOP} SELECT * FROM h")
def khop_edges(spark, sf_dir):
    return traversal.khop_edges(order_graph(spark, sf_dir), 2)


@query(f"{KHOP} SELECT center, count(DISTINCT v)::BIGINT n_vertices, count(DISTINCT (src, dst))::BIGINT n_edges FROM (SELECT center, src, dst, unnest([src, dst]) v FROM h) GROUP BY 1")
def khop_stats(spark, sf_dir):
    return traversal.khop_stats(khop_edges(spark, sf_dir))


@query(f"WITH {G2} {PIVOT.format(p="'pg_' || src", c='1', t='g2')}")
def pivot_source(spark, sf_dir):
    return documents.pivot_stats(documents.pivot_edges(supply_graph(spark, sf_dir), "source"))


@query(f"{KHOP} {PIVOT.format(p="'pg_' || center", c='center', t='h')}")
def pivot_khop(spark, sf_dir):
    return documents.pivot_stats(documents.pivot_edges(order_graph(spark, sf_dir), "k_hop"))


@query(f"WITH {G2} {PIVOT.format(p="'pg_0'", c='1', t='g2')}")
def pivot_single(spark, sf_dir):
    return documents.pivot_stats(documents.pivot_edges(supply_graph(spark, sf_dir), "single"))


@query(f"WITH {G2} SELECT 7::BIGINT graph_id, 'pg_' || src pivot_graph_id, src, dst, 'default' AS label FROM g2")
def pivot_round_trip(spark, sf_dir):
    """Documents written as JSON lines and read again with the filter at the reader."""
    path = new_path(spark, "pivots")
    documents.pivot_documents(documents.pivot_edges(supply_graph(spark, sf_dir), "source"), 7, 1, "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z").write.json(path, compression="gzip")
    return formats.read_pivots(spark, path, graph_id=7, business_id=1).select("graph_id", "pivot_graph_id", "src", "dst", "label")


# -- matching -----------------------------------------------------------------

PATH = Pattern((CUSTOMER, ORDER, PART), ((0, 1, 0), (1, 2, 1)))
CYCLE = Pattern((CUSTOMER, ORDER, SUPPLIER, NATION), ((0, 1, 0), (1, 2, 2), (2, 3, 4), (0, 3, 3)))
STAR = Pattern((ORDER, PART, PART), ((0, 1, 1), (0, 2, 1)))
TRIANGLE = Pattern((None, None, None), ((0, 1, None), (1, 2, None), (2, 0, None)))
CHAIN = Pattern((None, None, None), ((0, 1, None), (1, 2, None)))
NEEDY = Pattern((ORDER, PART, PART, SUPPLIER, CUSTOMER), ((0, 1, 1), (0, 2, 1), (0, 3, 2), (4, 0, 0)))


def _plain(g: DataFrame) -> DataFrame:
    return g.select("src", "dst", *[F.lit(None).cast("long").alias(c) for c in ("label", "src_label", "dst_label")])


@query(f"WITH {E0}, {E1} SELECT e0.src u0, e0.dst u1, e1.dst u2 FROM e0 JOIN e1 ON e0.dst = e1.src")
def match_path_homo(spark, sf_dir):
    return matching.match(property_graph(spark, sf_dir)[1], PATH, injective=False)


@query(f"WITH {G2} SELECT a.src u0, a.dst u1, b.dst u2 FROM g2 a JOIN g2 b ON a.dst = b.src WHERE a.src <> a.dst AND b.src <> b.dst AND a.src <> b.dst")
def match_path_iso(spark, sf_dir):
    return matching.match(_plain(supply_graph(spark, sf_dir)), CHAIN)


@query(f"WITH {G2} SELECT a.src u0, a.dst u1, b.dst u2 FROM g2 a JOIN g2 b ON a.dst = b.src JOIN g2 c ON c.src = b.dst AND c.dst = a.src WHERE a.src <> a.dst AND b.src <> b.dst AND a.src <> b.dst")
def match_triangle_iso(spark, sf_dir):
    return matching.match(_plain(supply_graph(spark, sf_dir)), TRIANGLE)


@query(f"WITH {G2} SELECT a.src u0, a.dst u1, b.dst u2 FROM g2 a JOIN g2 b ON a.dst = b.src JOIN g2 c ON c.src = b.dst AND c.dst = a.src")
def match_triangle_homo(spark, sf_dir):
    return matching.match(_plain(supply_graph(spark, sf_dir)), TRIANGLE, injective=False)


@query(f"WITH {E1} SELECT a.src u0, a.dst u1, b.dst u2 FROM e1 a JOIN e1 b ON a.src = b.src WHERE a.dst <> b.dst")
def match_star_iso(spark, sf_dir):
    return matching.match(property_graph(spark, sf_dir)[1], STAR)


CIRCLE = f"WITH {E0}, {E2}, {E3}, {E4}, m AS (SELECT e0.src u0, e0.dst u1, e2.dst u2, e4.dst u3 FROM e0 JOIN e2 ON e2.src = e0.dst JOIN e4 ON e4.src = e2.dst JOIN e3 ON e3.src = e0.src AND e3.dst = e4.dst)"


@query(f"{CIRCLE} SELECT u0, u1, u2, u3 FROM m")
def match_cycle_labelled(spark, sf_dir):
    return matching.match(property_graph(spark, sf_dir)[1], CYCLE)


@query(f"{CIRCLE} SELECT DISTINCT u0 root FROM m")
def match_roots(spark, sf_dir):
    return matching.roots(match_cycle_labelled(spark, sf_dir))


@query(f"WITH {G2} SELECT a.src u0, b.dst u1 FROM g2 a JOIN g2 b ON a.src = b.src WHERE a.src = a.dst AND b.dst <> a.src")
def match_self_loop(spark, sf_dir):
    """A first binding that is an edge from a vertex to itself."""
    return matching.match(_plain(supply_graph(spark, sf_dir)), Pattern((None, None), ((0, 0, None), (0, 1, None))))


@query(f"WITH {G3}, {E4} SELECT e4.src u0, e4.dst u1, id u2 FROM e4, v3 WHERE lab = 5 AND id <> e4.dst")
def match_disconnected(spark, sf_dir):
    """A pattern of two parts, one of them a vertex without edges."""
    vertices, edges = property_graph(spark, sf_dir)
    return matching.match(edges, Pattern((SUPPLIER, NATION, NATION), ((0, 1, 4),)), vertices=vertices)


@query(f"WITH {G3} SELECT id u0 FROM v3 WHERE lab = 4")
def match_single_vertex(spark, sf_dir):
    vertices, edges = property_graph(spark, sf_dir)
    return matching.match(edges, Pattern((SUPPLIER,), ()), vertices=vertices)


@query("SELECT * FROM (VALUES (0, 0, 'out', 1, 2), (1, 1, 'out', 2, 4), (2, 2, 'out', 4, 5), (3, 3, 'close', 1, 5)) t(step, edge, how, src_label, dst_label)")
def dfs_plan(spark, sf_dir):
    """The walk of the cyclic pattern, in which each of its edges comes once."""
    rows = [(i, k, how, CYCLE.labels[CYCLE.edges[k][0]], CYCLE.labels[CYCLE.edges[k][1]]) for i, (k, how) in enumerate(CYCLE.walk())]
    return spark.createDataFrame(rows, "step int, edge int, how string, src_label int, dst_label int")


GAR = f"WITH {E1}, m AS (SELECT a.src u0, a.dst u1, b.dst u2 FROM e1 a JOIN e1 b ON a.src = b.src WHERE a.dst <> b.dst), r AS (SELECT DISTINCT u0 \"pivot\", unnest([0, 1, 2])::INT pos, unnest([u0, u1, u2]) matched_id FROM m)"


@query(f'{GAR} SELECT "pivot", pos, matched_id FROM r')
def gar_grouped(spark, sf_dir):
    return matching.association_groups(matching.match(property_graph(spark, sf_dir)[1], STAR, given_order=True))


@query(f"{GAR} SELECT \"pivot\", pos cond_j, pos, count(*)::INT cnt, string_agg(matched_id::VARCHAR, ',' ORDER BY matched_id) matched FROM r GROUP BY 1, 2, 3")
def gar_rows(spark, sf_dir):
    """The sorted ids of each group as one text, so that they can be compared."""
    return matching.association_rows(gar_grouped(spark, sf_dir)).withColumn("matched", F.array_join(F.transform("matched", lambda x: x.cast("string")), ","))


@query(f"{GAR} SELECT \"pivot\", pos, count(*)::BIGINT cnt, min(matched_id) AS least FROM r GROUP BY 1, 2 ORDER BY cnt DESC, 1, 2 LIMIT 15")
def match_report(spark, sf_dir):
    return sinks.match_report(gar_grouped(spark, sf_dir), 15)


FOREST = f"WITH {E0}, {E1}, f AS (SELECT src root, 0 k, src, dst FROM e0 UNION ALL SELECT DISTINCT e0.src, 1, e1.src, e1.dst FROM e0 JOIN e1 ON e0.dst = e1.src), n AS (SELECT root, k, count(*) n FROM f GROUP BY 1, 2)"
ROUND = f"WITH {E0}, {E2}, {E3}, {E4}, f1 AS (SELECT DISTINCT e0.src root, e2.src, e2.dst FROM e0 JOIN e2 ON e0.dst = e2.src), f2 AS (SELECT DISTINCT root, e4.src, e4.dst FROM f1 JOIN e4 ON f1.dst = e4.src), f3 AS (SELECT src root, src, dst FROM e3 WHERE (src, dst) IN (SELECT (root, dst) FROM f2)), n AS (SELECT src root, 0 k, count(*) n FROM e0 GROUP BY 1 UNION ALL SELECT root, 1, count(*) FROM f1 GROUP BY 1 UNION ALL SELECT root, 2, count(*) FROM f2 GROUP BY 1 UNION ALL SELECT root, 3, count(*) FROM f3 GROUP BY 1)"


def _counted(forest: DataFrame, plan_edges: int) -> DataFrame:
    """Counts have up to 38 digits, which not every reader of numbers keeps: as text."""
    return matching.factorised_counts(forest, plan_edges).withColumn("n", F.col("n").cast("string"))


@query(f"{FOREST} SELECT a.root, (a.n * b.n)::VARCHAR n FROM n a JOIN n b ON a.root = b.root AND a.k = 0 AND b.k = 1")
def factorized_count(spark, sf_dir):
    return _counted(matching.factorised(property_graph(spark, sf_dir)[1], PATH), 2)


@query(f"{ROUND} SELECT a.root, (a.n::HUGEINT * b.n * c.n * d.n)::VARCHAR n FROM n a JOIN n b USING (root) JOIN n c USING (root) JOIN n d USING (root) WHERE a.k = 0 AND b.k = 1 AND c.k = 2 AND d.k = 3")
def factorized_cycle(spark, sf_dir):
    return _counted(matching.factorised(property_graph(spark, sf_dir)[1], CYCLE), 4)


@query(f"{ROUND} SELECT (1000000000 + c_custkey)::BIGINT root FROM customer WHERE (1000000000 + c_custkey) NOT IN (SELECT root FROM n GROUP BY 1 HAVING count(*) = 4)")
def incomplete_roots(spark, sf_dir):
    vertices, edges = property_graph(spark, sf_dir)
    customers = vertices.filter(F.col("label") == CUSTOMER).select(F.col("id").alias("root"))
    return matching.incomplete_roots(matching.factorised(edges, CYCLE), 4, customers)


@query(f"""WITH {G3}, c AS (SELECT DISTINCT a.src u0, a.dst u1, b.dst u2 FROM g3 a JOIN g3 b ON a.dst = b.src WHERE a.lab = 0 AND b.lab = 1)
 SELECT 0::BIGINT u, u0 v FROM c UNION SELECT 1, u1 FROM c UNION SELECT 2, u2 FROM c""")
def refine_path(spark, sf_dir):
    return matching.refine(*property_graph(spark, sf_dir), PATH)


WANTS = f"WITH {G3}, q AS (SELECT * FROM (VALUES (0, 2, 1, 3), (1, 3, 1, 0), (2, 3, 1, 0), (3, 4, 1, 0), (4, 1, 0, 1)) t(u, lab, nin, nout)), p AS (SELECT DISTINCT src, dst FROM g3), {DEG.format(g='p')}, c AS (SELECT q.u, v3.id v, nin, nout FROM q JOIN v3 USING (lab))"


@query(f"{WANTS} SELECT u::BIGINT u, v FROM c")
def cand_label(spark, sf_dir):
    return filters.filtered(*property_graph(spark, sf_dir), NEEDY)


@query(f"{WANTS} SELECT u::BIGINT u, v FROM c LEFT JOIN deg ON deg.id = v WHERE coalesce(in_degree, 0) >= nin AND coalesce(out_degree, 0) >= nout")
def cand_label_degree(spark, sf_dir):
    return filters.filtered(*property_graph(spark, sf_dir), NEEDY, "degree")


VARIETY = "nv AS (SELECT coalesce(a.id, b.id) id, coalesce(a.k, 0) ki, coalesce(b.k, 0) ko FROM (SELECT dst id, count(DISTINCT sl) k FROM g3 GROUP BY 1) a FULL JOIN (SELECT src id, count(DISTINCT dl) k FROM g3 GROUP BY 1) b ON a.id = b.id), w AS (SELECT * FROM (VALUES (0, 1, 2), (1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 0, 1)) t(u, wi, wo))"


@query(f"{WANTS}, {VARIETY} SELECT c.u::BIGINT u, v FROM c JOIN w ON w.u = c.u LEFT JOIN nv ON nv.id = v WHERE coalesce(ki, 0) >= wi AND coalesce(ko, 0) >= wo")
def cand_nlc(spark, sf_dir):
    return filters.filtered(*property_graph(spark, sf_dir), NEEDY, "variety")


MULTI = "o AS (SELECT DISTINCT src, dst, sl, dl FROM g3), i1 AS (SELECT dst id, sl l, count(*) n FROM o GROUP BY 1, 2), o1 AS (SELECT src id, dl l, count(*) n FROM o GROUP BY 1, 2)"


@query(f"""{WANTS}, {MULTI} SELECT u::BIGINT u, v FROM c WHERE
 (u = 0 AND v IN (SELECT id FROM i1 WHERE l = 1) AND v IN (SELECT id FROM o1 WHERE l = 3 AND n >= 2) AND v IN (SELECT id FROM o1 WHERE l = 4))
 OR (u IN (1, 2, 3) AND v IN (SELECT id FROM i1 WHERE l = 2)) OR (u = 4 AND v IN (SELECT id FROM o1 WHERE l = 2))""")
def cand_multiset(spark, sf_dir):
    return filters.filtered(*property_graph(spark, sf_dir), NEEDY, "multiset")


@query(f"""{WANTS}, b AS (SELECT g3.dst v, sl, max(deg.in_degree) d FROM g3 JOIN (SELECT id, in_degree FROM deg) deg ON deg.id = g3.src GROUP BY 1, 2) SELECT u::BIGINT u, v FROM c WHERE u = 4
 OR (u = 0 AND v IN (SELECT v FROM b WHERE sl = 1 AND d >= 0)) OR (u IN (1, 2, 3) AND v IN (SELECT v FROM b WHERE sl = 2 AND d >= 1))""")
def cand_steady(spark, sf_dir):
    return filters.filtered(*property_graph(spark, sf_dir), NEEDY, "steady")


@query(f"{WANTS} SELECT u::BIGINT u, v FROM c LEFT JOIN deg ON deg.id = v WHERE coalesce(out_degree, 0) >= nout")
def cand_out_degree(spark, sf_dir):
    return filters.filtered(*property_graph(spark, sf_dir), NEEDY, "out_degree")


SKETCH = """h AS (SELECT v, side, ('0x' || substr(md5(l::VARCHAR), 1, 15))::BIGINT h, n FROM (SELECT id v, 'in' side, l, n FROM i1 UNION ALL SELECT id, 'out', l, n FROM o1)),
 sk AS (SELECT v, side, h, least(n, 7 - b)::BIGINT c FROM (SELECT *, sum(n) OVER (PARTITION BY v, side ORDER BY h) - n b FROM h) WHERE b < 7)"""
OWN = "pk AS (SELECT u, side, ('0x' || substr(md5(l::VARCHAR), 1, 15))::BIGINT h, c FROM (VALUES (0, 'in', 1, 1), (0, 'out', 3, 2), (0, 'out', 4, 1), (1, 'in', 2, 1), (2, 'in', 2, 1), (3, 'in', 2, 1), (4, 'out', 2, 1)) t(u, side, l, c))"


@query(f"""{WANTS}, {MULTI}, {SKETCH}, {OWN}, w AS (SELECT u, side, min(h) need FROM pk GROUP BY 1, 2), b AS (SELECT v, side, min(h) has FROM h GROUP BY 1, 2)
 SELECT u::BIGINT u, v FROM c WHERE NOT EXISTS (SELECT 1 FROM w LEFT JOIN b ON b.side = w.side AND b.v = c.v WHERE w.u = c.u AND (has IS NULL OR has > need))""")
def cand_least_hash(spark, sf_dir):
    return filters.filtered(*property_graph(spark, sf_dir), NEEDY, "least_hash")


@query(f"WITH {G3}, {MULTI}, {SKETCH} SELECT v, side, h, c FROM sk")
def kmin_sketches(spark, sf_dir):
    return filters.kmin_sketch(property_graph(spark, sf_dir)[1])


@query(f"""{WANTS}, {MULTI}, {SKETCH}, {OWN}, val AS (SELECT u, v, side, h, sum(a) a, sum(b) b FROM (SELECT c.u, c.v, pk.side, pk.h, pk.c a, 0 b FROM c JOIN pk USING (u) UNION ALL SELECT c.u, c.v, sk.side, sk.h, 0, sk.c FROM c JOIN sk USING (v)) GROUP BY ALL),
 lf AS (SELECT u, v, min(h) FILTER (WHERE a > b) x, min(h) FILTER (WHERE b > a) y FROM val GROUP BY u, v, side)
 SELECT u::BIGINT u, v FROM c WHERE (u, v) NOT IN (SELECT (u, v) FROM lf WHERE x IS NOT NULL AND (y IS NULL OR x < y))""")
def cand_kmin(spark, sf_dir):
    return filters.filtered(*property_graph(spark, sf_dir), NEEDY, "kmin")


COMPOSED = f"{WANTS}, {VARIETY}, d1 AS (SELECT c.* FROM c JOIN w ON w.u = c.u LEFT JOIN nv ON nv.id = v WHERE coalesce(ki, 0) >= wi AND coalesce(ko, 0) >= wo), d2 AS (SELECT d1.* FROM d1 LEFT JOIN deg ON deg.id = v WHERE coalesce(in_degree, 0) >= nin AND coalesce(out_degree, 0) >= nout)"


@query(f"{COMPOSED} SELECT u::BIGINT u, v FROM d2")
def cand_composed(spark, sf_dir):
    return filters.filtered(*property_graph(spark, sf_dir), NEEDY, "variety", "degree")


@query(f"{COMPOSED} SELECT 0::BIGINT step, 'label' AS name, count(*)::BIGINT n FROM c UNION ALL SELECT 1, 'variety', count(*) FROM d1 UNION ALL SELECT 2, 'degree', count(*) FROM d2")
def filter_counters(spark, sf_dir):
    return filters.filtered_counts(*property_graph(spark, sf_dir), NEEDY, "variety", "degree")[1]


@query(f"{COMPOSED} SELECT q.u::BIGINT u, id v, (d2.v IS NOT NULL)::INT AS valid FROM q CROSS JOIN v3 LEFT JOIN d2 ON d2.u = q.u AND d2.v = id")
def valid_mask(spark, sf_dir):
    vertices, edges = property_graph(spark, sf_dir)
    return filters.mask(vertices, filters.filtered(vertices, edges, NEEDY, "variety", "degree"), NEEDY)


@query(f"{COMPOSED} SELECT src, dst FROM g3 WHERE lab = 1 AND src IN (SELECT v FROM d2 WHERE u = 0) AND dst IN (SELECT v FROM d2 WHERE u = 1)")
def feasible_edges(spark, sf_dir):
    return filters.feasible_edges(*property_graph(spark, sf_dir), NEEDY, 0, "variety", "degree")


@query(f"WITH {E0}, {E2} SELECT src, dst FROM e0 WHERE dst IN (SELECT src FROM e2 WHERE dst % 7 = 0)")
def semi_filter_rows(spark, sf_dir):
    edges = property_graph(spark, sf_dir)[1]
    return sets.semi_filter(edges.filter("label = 0").select("src", "dst"), edges.filter("label = 2 and dst % 7 = 0"), "dst", "src")


@query(f"WITH {G2}, p AS (SELECT DISTINCT l_partkey::BIGINT src, (l_suppkey + l_linenumber)::BIGINT dst FROM lineitem) SELECT p.src, p.dst, g2.src IS NOT NULL AS connected FROM p LEFT JOIN g2 ON g2.src = p.src AND g2.dst = p.dst")
def connected_pairs(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("src"), (F.col("l_suppkey") + F.col("l_linenumber")).cast("long").alias("dst")).distinct()
    return sets.connected(supply_graph(spark, sf_dir), pairs)


@query(f"WITH {G2}, r AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 i, count(*) OVER () n FROM g2) SELECT (CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE (n % 7) + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END)::BIGINT slice, count(*)::BIGINT n_rows, min(src) first_src FROM r GROUP BY 1")
def row_split(spark, sf_dir):
    return sets.row_split(supply_graph(spark, sf_dir), 7, ["src", "dst"]).groupBy("slice").agg(F.count("*").alias("n_rows"), F.min("src").alias("first_src"))


@query(f"WITH {G2} SELECT row_number() OVER (ORDER BY src, dst) - 1 pos, src, dst FROM g2")
def sorted_edges(spark, sf_dir):
    return sets.sorted_edges(supply_graph(spark, sf_dir))


BITS = "a AS (SELECT DISTINCT l_suppkey::BIGINT k, l_partkey::BIGINT x FROM lineitem WHERE l_quantity < 25), b AS (SELECT DISTINCT l_suppkey::BIGINT k, l_partkey::BIGINT x FROM lineitem WHERE l_tax < 0.04)"


def _bitmaps(spark, sf_dir) -> list[DataFrame]:
    rows = table(spark, sf_dir, "lineitem").withColumns({"key": F.col("l_suppkey").cast("long"), "x": F.col("l_partkey").cast("long")})
    return [structure.packed_sets(rows.filter(c), "key", "x") for c in ("l_quantity < 25", "l_tax < 0.04")]


@query(f"WITH {BITS}, j AS (SELECT coalesce(a.k, b.k) k, a.x p, b.x q FROM a FULL JOIN b ON a.k = b.k AND a.x = b.x) SELECT k AS key, count(p)::BIGINT n_a, count(q)::BIGINT n_b, count(*) FILTER (WHERE p = q)::BIGINT n_and, count(p) = count(q) AND count(p) = count(*) AS equal, count(p) = 0 AS a_empty FROM j GROUP BY 1")
def bitmap_facts(spark, sf_dir):
    return sets.bitmap_facts(*_bitmaps(spark, sf_dir))


@query(f"WITH {BITS}, o AS (SELECT 'and' AS op, k, x FROM a WHERE (k, x) IN (SELECT (k, x) FROM b) UNION ALL SELECT 'or', k, x FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'minus', k, x FROM a WHERE (k, x) NOT IN (SELECT (k, x) FROM b) UNION ALL SELECT 'fill', k, x FROM (SELECT DISTINCT k FROM a), generate_series(0, 69) t(x)) SELECT op, k AS key, x // 32 AS word, bit_or(1::BIGINT << (x % 32)::INT) bits FROM o GROUP BY 1, 2, 3")
def bitmap_algebra(spark, sf_dir):
    a, b = _bitmaps(spark, sf_dir)
    parts = [("and", sets.bitmap_and(a, b)), ("or", sets.bitmap_or(a, b)), ("minus", sets.bitmap_minus(a, b)), ("fill", sets.bitmap_fill(a.select("key").distinct(), 70))]
    return sets.merged(*[df.select(F.lit(op).alias("op"), "key", "word", "bits") for op, df in parts])


@query(f"WITH {BITS} SELECT p.k AS key, p.x place, a.x IS NOT NULL AS \"set\" FROM (SELECT DISTINCT k, x + 1 x FROM b) p LEFT JOIN a ON a.k = p.k AND a.x = p.x")
def bitmap_has(spark, sf_dir):
    a, _ = _bitmaps(spark, sf_dir)
    asked = table(spark, sf_dir, "lineitem").filter("l_tax < 0.04").select(F.col("l_suppkey").cast("long").alias("key"), (F.col("l_partkey") + 1).cast("long").alias("place")).distinct()
    return sets.bitmap_has(a, asked)


@query(f"WITH {G3} SELECT src, dst FROM g3 WHERE lab = 1 AND src IN (SELECT src FROM g3 WHERE lab = 1 GROUP BY 1 HAVING count(*) >= 2)")
def edge_candidates(spark, sf_dir):
    vertices, edges = property_graph(spark, sf_dir)
    return matching.edge_candidates(edges, STAR, 0, filters.filtered(vertices, edges, STAR, "multiset"))


# -- linear algebra, vectors, evaluation --------------------------------------

MAT = "mat AS (SELECT vec_id::BIGINT i, (unnest(generate_series(1, len(embedding))) - 1)::BIGINT j, unnest(embedding)::DOUBLE v FROM embeddings)"
PAIR = "ab AS (SELECT x.vec_id::BIGINT a, y.vec_id::BIGINT b, unnest(generate_series(1, len(y.embedding))) - 1 k, unnest(x.embedding)::DOUBLE p, unnest(y.embedding)::DOUBLE q FROM embeddings x, embeddings y WHERE x.vec_id = 0)"


@query(f"WITH {MAT} SELECT a.j i, b.j, round(sum(a.v * b.v), 6) v FROM mat a JOIN mat b ON a.i = b.i GROUP BY 1, 2")
def matmul(spark, sf_dir):
    m = vectors_long(spark, sf_dir)
    return linalg.matmul(m, m, transposed_a=True).withColumn("v", F.round("v", 6))


@query(f"WITH {MAT}, gram AS (SELECT a.j i, b.j, sum(a.v * b.v) v FROM mat a JOIN mat b ON a.i = b.i GROUP BY 1, 2) SELECT m.i, g.i j, round(sum(m.v * g.v), 5) v FROM mat m JOIN gram g ON m.j = g.j GROUP BY 1, 2")
def matmul_bt(spark, sf_dir):
    m = vectors_long(spark, sf_dir)
    return linalg.matmul(m, linalg.matmul(m, m, transposed_a=True), transposed_b=True).withColumn("v", F.round("v", 5))


@query(f"WITH {MAT} SELECT i, j, round(v + v, 7) v FROM mat")
def matadd(spark, sf_dir):
    m = vectors_long(spark, sf_dir)
    return linalg.add(m, m).withColumn("v", F.round("v", 7))


@query(f"WITH {MAT} SELECT j i, i j, v FROM mat")
def mat_transpose(spark, sf_dir):
    return linalg.transposed(vectors_long(spark, sf_dir))


@query(f"WITH {MAT} SELECT i, j, greatest(v, 0.0::DOUBLE) v FROM mat")
def relu(spark, sf_dir):
    return linalg.applied(vectors_long(spark, sf_dir), "relu")


@query(f"WITH {MAT} SELECT i, j, round(1 / (1 + exp(-v)), 8) v FROM mat")
def sigmoid(spark, sf_dir):
    return linalg.applied(vectors_long(spark, sf_dir), "sigmoid").withColumn("v", F.round("v", 8))


@query(f"WITH {MAT} SELECT i, j, round((v - w) * (v - w), 8) v FROM mat JOIN (SELECT j, v w FROM mat WHERE i = 0) USING (j)")
def sqdiff(spark, sf_dir):
    m = vectors_long(spark, sf_dir)
    row = m.filter("i = 0").select("j", F.col("v").alias("w"))
    other = m.join(F.broadcast(row), "j").select("i", "j", F.col("w").alias("v"))
    return linalg.squared_difference(m, other).withColumn("v", F.round("v", 8))


@query(f"WITH {MAT} SELECT i, j, greatest(least(trunc(v * 100.0)::INT, 127), -127) v FROM mat")
def quantise(spark, sf_dir):
    return vectors_long(spark, sf_dir).withColumn("v", linalg.quantised(F.col("v"), 100.0))


def _scored(spark, sf_dir, f) -> DataFrame:
    rows = vectors.against(table(spark, sf_dir, "embeddings"), 0)
    return rows.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.round(f(F.col("va"), F.col("vb")), 7).alias("s"))


COS = "sum(p * q) / (greatest(sqrt(sum(p * p)), 1e-8) * greatest(sqrt(sum(q * q)), 1e-8))"


@query(f"WITH {PAIR} SELECT a, b, round({COS}, 7) s FROM ab GROUP BY 1, 2")
def sim_cosine(spark, sf_dir):
    return _scored(spark, sf_dir, vectors.cosine)


@query(f"WITH {PAIR} SELECT a, b, round(sum(p * q), 7) s FROM ab GROUP BY 1, 2")
def sim_dot(spark, sf_dir):
    return _scored(spark, sf_dir, vectors.dot)


@query(f"WITH {PAIR} SELECT a, b, round(sum((p - q) * (p - q)), 7) s FROM ab GROUP BY 1, 2")
def sim_l2(spark, sf_dir):
    return _scored(spark, sf_dir, vectors.squared_l2)


@query(f"WITH {PAIR} SELECT a, b, round(1 / (1 + sum(abs(p - q))), 7) s FROM ab GROUP BY 1, 2")
def sim_l1(spark, sf_dir):
    return _scored(spark, sf_dir, vectors.manhattan)


@query(f"WITH {PAIR} SELECT a, b, round(0.5 * {COS}, 6) s0, round(0.3 * (sum(p * q) + 1) / 2, 6) s1, round(0.2 * sum((p - q) * (p - q)), 6) s2 FROM ab GROUP BY 1, 2")
def sim_combined(spark, sf_dir):
    rows = vectors.against(table(spark, sf_dir, "embeddings"), 0).withColumn("s", vectors.combined(F.col("va"), F.col("vb")))
    return rows.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), *[F.round(F.col("s")[i], 6).alias(f"s{i}") for i in range(3)])


#: Fixed weights of the demonstration network, by rule.
W1 = [[((h * 7 + k * 3) % 11 - 5) / 50 for k in range(64)] for h in range(4)]
B1, W2, B2 = [0.1 * h for h in range(4)], [0.5, -0.5, 0.5, -0.5], 0.05


@query(f"WITH {PAIR}, h AS (SELECT a, b, n, greatest(sum((((n * 7 + k * 3) % 11 - 5) / 50.0)::DOUBLE * (p - q) * (p - q)) + 0.1::DOUBLE * n, 0) z FROM ab, generate_series(0, 3) t(n) GROUP BY 1, 2, 3), o AS (SELECT a, b, 1 / (1 + exp(-(0.05::DOUBLE + sum(CASE WHEN n % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5 END * z)))) p FROM h GROUP BY 1, 2) SELECT a, b, round(p, 7) p FROM o WHERE p >= 0.1")
def mlp_filter(spark, sf_dir):
    found = vectors.learned_filter(vectors.against(table(spark, sf_dir, "embeddings"), 0), W1, B1, W2, B2)
    return found.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.round("p", 7).alias("p"))


NET = "h AS (SELECT a, b, n, greatest(sum((((n * 7 + k * 3) % 11 - 5) / 50.0)::DOUBLE * x) + 0.1::DOUBLE * n, 0) z FROM dx, generate_series(0, 3) t(n) GROUP BY 1, 2, 3), o AS (SELECT a, b, 1 / (1 + exp(-(0.05::DOUBLE + sum(CASE WHEN n % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5 END * z)))) p FROM h GROUP BY 1, 2)"


@query(f"WITH {PAIR}, dx AS (SELECT a, b, k, (p - q) * (p - q) x FROM ab), {NET.replace('0.5::DOUBLE ELSE -0.5', '-20::DOUBLE ELSE 20')} SELECT a, b, round(p, 6) p FROM o WHERE p >= 0.8")
def mlp_filter_high(spark, sf_dir):
    """The same network, its last weights times -40, at the other threshold."""
    found = vectors.learned_filter(vectors.against(table(spark, sf_dir, "embeddings"), 0), W1, B1, [-40 * w for w in W2], B2, threshold=0.8)
    return found.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.round("p", 6).alias("p"))


@query(f"WITH {PAIR}, dx AS (SELECT a, b, k, q x FROM ab), {NET} SELECT b::BIGINT vec_id, round(p, 7) p, (p > 0.5)::INT predicted FROM o")
def mlp_predict(spark, sf_dir):
    """Parameters taken out as text and put in again."""
    network = training.set_parameters(training.get_parameters({"w1": W1, "b1": B1, "w2": W2, "b2": B2}))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return training.predict(rows, network, "embedding").select("vec_id", F.round("p", 7).alias("p"), "predicted")


MEAN = f"WITH {G2}, {ENDS.format(g='g2')}, x AS (SELECT id, d::BIGINT dim, ((id * (d + 1)) % 7)::DOUBLE v FROM ends, generate_series(0, 3) t(d))"


def _mean_step(name: str, of: str) -> str:
    return f"{name} AS (SELECT x.id, x.dim, coalesce(m, 0) v FROM x LEFT JOIN (SELECT g2.dst id, dim, avg(v) m FROM g2 JOIN {of} o ON o.id = g2.src GROUP BY 1, 2) USING (id, dim))"


def _mean_sql(rounds: int) -> str:
    parts = [_mean_step("y0", "x")]
    for r in range(rounds):
        parts += [_mean_step(f"m{r}", f"y{r}"), f"y{r + 1} AS (SELECT a.id, a.dim, a.v + b.v v FROM y{r} a JOIN m{r} b USING (id, dim))"]
    return f"{MEAN}, {', '.join(parts)} SELECT id, dim, round(v, 6) v FROM y{rounds}"


def _mean(spark, sf_dir, rounds: int) -> DataFrame:
    g = supply_graph(spark, sf_dir)
    x = structure.endpoints(g).select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("dim")).select("id", "dim", ((F.col("id") * (F.col("dim") + 1)) % 7).cast("double").alias("v"))
    return vectors.mean_embedding(x, g, rounds).withColumn("v", F.round("v", 6))


@query(_mean_sql(1))
def mean_agg_embedding(spark, sf_dir):
    return _mean(spark, sf_dir, 1)


@query(_mean_sql(3))
def mean_agg_embedding3(spark, sf_dir):
    return _mean(spark, sf_dir, 3)


TRUTH = "SELECT doc_id::BIGINT vid FROM labels WHERE quality = 1"


def _ids(spark, sf_dir, name: str, condition: str = "true") -> DataFrame:
    return table(spark, sf_dir, name).filter(condition).select(F.col("doc_id").cast("long").alias("vid"))


@query("WITH m AS (SELECT (quality = 1) t, (toxic = 0) p FROM labels), s AS (SELECT count(*) FILTER (t AND p)::BIGINT tp, count(*) FILTER (NOT t AND p)::BIGINT fp, count(*) FILTER (t AND NOT p)::BIGINT fn, count(*) FILTER (NOT t AND NOT p)::BIGINT tn FROM m) SELECT tp, fp, fn, tn, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) recall, round(2.0 * tp / (2 * tp + fp + fn), 8) f1, round((tp + tn) / (tp + fp + fn + tn), 8) accuracy FROM s")
def f1_metrics(spark, sf_dir):
    found = vectors.metrics(_ids(spark, sf_dir, "labels", "quality = 1"), _ids(spark, sf_dir, "labels", "toxic = 0"), _ids(spark, sf_dir, "labels"))
    return found.select("tp", "fp", "fn", "tn", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(f"WITH t AS ({TRUTH}), n AS (SELECT DISTINCT doc_id::BIGINT vid FROM documents WHERE doc_id NOT IN (SELECT vid FROM t)), r AS (SELECT vid, row_number() OVER (ORDER BY md5(vid::VARCHAR), vid) k FROM n) SELECT vid, 1 y FROM t UNION ALL SELECT vid, 0 FROM r WHERE k <= (SELECT count(*) FROM t)")
def train_samples(spark, sf_dir):
    return vectors.training_samples(_ids(spark, sf_dir, "labels", "quality = 1"), _ids(spark, sf_dir, "documents"))


@query(f"WITH t AS ({TRUTH}), n AS (SELECT DISTINCT doc_id::BIGINT vid FROM documents WHERE doc_id NOT IN (SELECT vid FROM t)), r AS (SELECT vid, row_number() OVER (ORDER BY md5(vid::VARCHAR), vid) k FROM n), s AS (SELECT vid, 1 y FROM t UNION ALL SELECT vid, 0 FROM r WHERE k <= (SELECT count(*) FROM t)), {PAIR}, x AS (SELECT b, round(0.5 * {COS}, 6) s0, round(0.3 * (sum(p * q) + 1) / 2, 6) s1, round(0.2 * sum((p - q) * (p - q)), 6) s2 FROM ab GROUP BY 1), z AS (SELECT vid, y, s0, s1, s2, row_number() OVER (PARTITION BY y ORDER BY ('0x' || substr(md5('7_' || vid), 1, 15))::BIGINT, vid) k, count(*) OVER (PARTITION BY y) n FROM s JOIN x ON b = vid) SELECT vid, y, s0, s1, s2, CASE WHEN k <= floor(n * 90 / 100) THEN 'train' ELSE 'test' END part FROM z")
def train_features(spark, sf_dir):
    """Samples with their similarities to vector 0 and a stratified split."""
    rows = vectors.training_set(_ids(spark, sf_dir, "labels", "quality = 1"), _ids(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), 0)
    return rows.select("vid", "y", *[F.round(F.col("x")[i], 6).alias(f"s{i}") for i in range(3)], "part")


@query("SELECT doc_id::BIGINT vid FROM labels WHERE quality = 1 UNION ALL SELECT doc_id::BIGINT FROM labels WHERE toxic = 1")
def merge_ids(spark, sf_dir):
    return sets.merged(_ids(spark, sf_dir, "labels", "quality = 1"), _ids(spark, sf_dir, "labels", "toxic = 1"))


from . import queries_io  # noqa: E402, F401  (registers its queries)

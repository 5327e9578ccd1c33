"""The registered queries of formats, conversions and generators: what is written is read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import convert
from .operators import documents, structure, tiled
from .operators.structure import running
from .queries import DEG, E0, ENDS, G1, G2, MAT, query
from .sources import formats
from .sources.tables import order_graph, property_graph, supply_graph, table
from .storage import new_path

# -- text formats -------------------------------------------------------------

LINES = f"WITH {G2}, {DEG.format(g='g2')}, v AS (SELECT id, id % 5 l, in_degree, out_degree FROM deg)"


def _graph(spark, sf_dir):
    return formats.graph_of(supply_graph(spark, sf_dir))


@query(f"{LINES} SELECT 't ' || (SELECT count(*) FROM v) || ' ' || (SELECT count(*) FROM g2) line UNION ALL SELECT 'v ' || id || ' ' || l || ' ' || (in_degree + out_degree) FROM v UNION ALL SELECT 'e ' || src || ' ' || dst FROM g2")
def egsm_lines(spark, sf_dir):
    return formats.egsm_lines(*_graph(spark, sf_dir)).select("line")


@query(f"{LINES} SELECT 't # 0' line UNION ALL SELECT 'v ' || id || ' ' || l || ' ' || (in_degree + out_degree) FROM v UNION ALL SELECT 'e ' || src || ' ' || dst || ' 0' FROM g2")
def ceci_lines(spark, sf_dir):
    return formats.ceci_lines(*_graph(spark, sf_dir)).select("line")


@query(f"{LINES} SELECT 'v ' || id || ' ' || l || ' ' || (in_degree + out_degree) line FROM v UNION ALL SELECT 'e ' || src || ' ' || dst || ' 0' FROM g2")
def gnnpe_lines(spark, sf_dir):
    return formats.gnnpe_lines(*_graph(spark, sf_dir)).select("line")


@query(f"{LINES} SELECT (SELECT count(*) FROM v)::VARCHAR line UNION ALL SELECT id || ' ' || l FROM v UNION ALL SELECT out_degree::VARCHAR FROM v UNION ALL SELECT src || ' ' || dst FROM g2")
def vf3_lines(spark, sf_dir):
    return formats.vf3_lines(*_graph(spark, sf_dir)).select("line")


@query(f"WITH {G2} SELECT src, dst FROM g2")
def text_round_trip(spark, sf_dir):
    """The graph written as text lines and scanned again."""
    path = new_path(spark, "lines")
    formats.write_lines(formats.egsm_lines(*_graph(spark, sf_dir)), path)
    return formats.read_text_graph(spark, path)[1]


@query(f"WITH {G2} SELECT src, dst FROM g2")
def csv_round_trip(spark, sf_dir):
    path = new_path(spark, "csv")
    supply_graph(spark, sf_dir).write.csv(path)
    return formats.read_csv_edges(spark, path)


@query(f"{LINES}, n AS (SELECT 0 section, 0::BIGINT a, 0::BIGINT b, (SELECT count(*) FROM v)::VARCHAR line UNION ALL SELECT 1, id, 0, id || ' ' || l FROM v UNION ALL SELECT 2, id, -1, out_degree::VARCHAR FROM v UNION ALL SELECT 2, src, dst, src || ' ' || dst FROM g2) SELECT row_number() OVER (ORDER BY section, a, b) - 1 pos, line FROM n")
def vf3_positions(spark, sf_dir):
    """Each line with its place, on which this format rests."""
    return running(formats.vf3_lines(*_graph(spark, sf_dir)), ["section", "a", "b"], "pos").select("pos", "line")


def _egsm(spark, sf_dir) -> str:
    path = new_path(spark, "lines")
    formats.write_lines(formats.egsm_lines(*_graph(spark, sf_dir)), path)
    return path


VERTICES = f"WITH {G2}, {ENDS.format(g='g2')} SELECT id, id % 5 AS label FROM ends"


@query(VERTICES)
def text_vertices(spark, sf_dir):
    return formats.read_text_graph(spark, _egsm(spark, sf_dir))[0]


@query(f"WITH {G2} SELECT dst src, src dst FROM g2")
def text_reversed(spark, sf_dir):
    return formats.read_text_graph(spark, _egsm(spark, sf_dir), reverse=True)[1]


@query(f"WITH {G2} SELECT src, dst FROM g2")
def text_to_csr(spark, sf_dir):
    """Text lines converted to compressed rows, which are then read."""
    target = new_path(spark, "csr")
    convert.convert(spark, "egsm2csrbin", _egsm(spark, sf_dir), target)
    return formats.read_csr(spark, target)[1]


@query(f"WITH {G2} SELECT src, dst FROM g2")
def csv_to_csr(spark, sf_dir):
    path, target = new_path(spark, "csv"), new_path(spark, "csr")
    supply_graph(spark, sf_dir).write.csv(path, sep="\t")
    convert.convert(spark, "edgelistcsv2csrbin", path, target, sep="\t")
    return formats.read_csr(spark, target)[1]


@query(f"WITH {G2} SELECT dst src, src dst FROM g2")
def transposed_edge_list(spark, sf_dir):
    path, target = new_path(spark, "edges"), new_path(spark, "turned")
    vertices, edges = _graph(spark, sf_dir)
    formats.write_edge_list(edges, vertices, path)
    convert.convert(spark, "edgelistbin2transposededgelistbin", path, target)
    return formats.read_edge_list(spark, target)[1]


def _edge_list(spark, sf_dir):
    path = new_path(spark, "edges")
    vertices, edges = _graph(spark, sf_dir)
    formats.write_edge_list(edges, vertices, path)
    return formats.read_edge_list(spark, path)


@query(f"WITH {G2} SELECT src, dst FROM g2")
def edge_list_round_trip(spark, sf_dir):
    return _edge_list(spark, sf_dir)[1]


@query(VERTICES)
def edge_list_vertices(spark, sf_dir):
    return _edge_list(spark, sf_dir)[0]


@query(f"WITH {G2}, {ENDS.format(g='g2')} SELECT 'max_vid' AS key, max(id)::BIGINT AS value FROM ends UNION ALL SELECT 'min_vid', min(id) FROM ends UNION ALL SELECT 'num_edges', 2 * count(*) FROM g2 UNION ALL SELECT 'num_vertices', count(*) FROM ends UNION ALL SELECT 'num_incoming_edges', count(*) FROM g2 UNION ALL SELECT 'num_subgraphs', 1 UNION ALL SELECT 'count_border_vertices', 0")
def csr_metadata(spark, sf_dir):
    """The YAML file beside compressed rows, with one key of its nested part."""
    path = new_path(spark, "csr")
    formats.write_csr(*_graph(spark, sf_dir), path)
    meta = formats.read_yaml(f"{path}/meta.yaml")
    rows = [(k, v) for k, v in meta.items() if k != "subgraphs"] + [("num_incoming_edges", meta["subgraphs"][0]["num_incoming_edges"])]
    return spark.createDataFrame(rows, "key string, value long")


@query(f"WITH {G1} SELECT src, dst FROM g1")
def csr_round_trip(spark, sf_dir):
    """Vertices of the order graph have gaps in their ids at larger sizes."""
    path = new_path(spark, "csr")
    formats.write_csr(*formats.graph_of(order_graph(spark, sf_dir)), path)
    return formats.read_csr(spark, path)[1]


@query(f"WITH {G1}, {ENDS.format(g='g1')} SELECT id, id % 5 AS label FROM ends")
def csr_vertices(spark, sf_dir):
    path = new_path(spark, "csr")
    formats.write_csr(*formats.graph_of(order_graph(spark, sf_dir)), path)
    return formats.read_csr(spark, path)[0]


@query(f"WITH {G2}, {ENDS.format(g='g2')}, ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 d FROM ends), l AS (SELECT a.d src, b.d dst FROM g2 JOIN ids a ON a.id = src JOIN ids b ON b.id = dst) SELECT row_number() OVER (ORDER BY src, dst) - 1 pos, src, dst FROM l")
def native_csr_round_trip(spark, sf_dir):
    path, target = new_path(spark, "edges"), new_path(spark, "native")
    vertices, edges = _graph(spark, sf_dir)
    formats.write_edge_list(edges, vertices, path)
    convert.convert(spark, "edgelistbin2cggraphcsr", path, target)
    return formats.read_native_csr(spark, target)


@query(f"WITH {MAT} SELECT i, j, round(v, 6) v FROM mat")
def matrix_round_trip(spark, sf_dir):
    path = new_path(spark, "matrix")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("i"), F.col("embedding").alias("vec"))
    formats.write_matrix(rows, path, 64)
    found = formats.read_matrix(spark, path).select("i", F.posexplode("vec").alias("j", "v"))
    return found.select("i", F.col("j").cast("long").alias("j"), F.round("v", 6).alias("v"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 pos, o_custkey::BIGINT v0, o_orderkey::BIGINT v1 FROM orders")
def array_round_trip(spark, sf_dir):
    path = new_path(spark, "arrays") + "/pairs.bin"
    formats.write_array(table(spark, sf_dir, "orders").orderBy("o_orderkey").select("o_custkey", "o_orderkey"), path, "<u8")
    return formats.read_array(spark, path, "<u8", width=2)


@query(f"WITH {E0} SELECT DISTINCT src root FROM e0")
def roots_round_trip(spark, sf_dir):
    path = new_path(spark, "roots") + "/roots.bin"
    formats.write_roots(property_graph(spark, sf_dir)[1].filter("label = 0").select(F.col("src").alias("root")).distinct(), path)
    return formats.read_roots(spark, path)


PICK = "('0x' || substr(md5('7_{kind}_' || i), 1, 15))::BIGINT"
RANDOM = f"WITH t AS (SELECT {PICK.format(kind='tree')} % i a, i b FROM range(1, 2000) r(i)), m AS (SELECT {PICK.format(kind='x')} % 2000 x, {PICK.format(kind='y')} % 2000 y FROM range(5000) r(i))"


@query(f"{RANDOM} SELECT a src, b dst FROM t WHERE a <> b UNION SELECT least(x, y), greatest(x, y) FROM m WHERE x <> y")
def random_graph_edges(spark, sf_dir):
    return formats.random_graph(spark, 2000, 5000, seed=7)[1]


@query(f"SELECT i id, {PICK.format(kind='label')} % 5 AS label FROM range(2000) r(i)")
def random_graph_vertices(spark, sf_dir):
    return formats.random_graph(spark, 2000, 5000, seed=7)[0]


@query("SELECT round(sum(o_orderkey % 1000 / 8.0), 3)::DOUBLE total FROM orders")
def log_seconds(spark, sf_dir):
    """Seconds in a log that is written first: every other line holds none."""
    path = new_path(spark, "log")
    rows = table(spark, sf_dir, "orders").select(F.explode(F.array(F.format_string("task done, elapsed: %.3f s", (F.col("o_orderkey") % 1000 / 8).cast("double")), F.lit("task begun"))).alias("value"))
    rows.write.text(path)
    return formats.elapsed_sum(spark, path).select(F.round("total", 3).alias("total"))


def _tiled(kind: str, chunks: int):
    def run(spark, sf_dir):
        path = new_path(spark, "tiled")
        vertices, edges = _graph(spark, sf_dir)
        tiled.write_tiled(edges, path, kind, 256, chunks, vertices if chunks > 1 else None)
        found = tiled.read_tiled(spark, path)
        return found if chunks == 1 else found.join(tiled.read_labels(spark, path).select(F.col("id").alias("src"), "label"), "src").select("src", "dst", "label")

    return run


for _name, _kind, _chunks in (("csr_tiled_round_trip", "csr", 1), ("bit_tiled_round_trip", "bit", 1), ("grid_csr_tiled_round_trip", "csr", 4), ("grid_bit_tiled_round_trip", "bit", 4)):
    _run = _tiled(_kind, _chunks)
    _run.__name__ = _name
    query(f"WITH {G2} SELECT src, dst{', src % 5 AS label' if _chunks > 1 else ''} FROM g2")(_run)


@query(f"WITH {G2}, sc AS (SELECT (max(greatest(src, dst)) + 1 + 3) // 4 s FROM g2) SELECT src, dst FROM g2, sc WHERE src // s = 1 AND dst // s = 0")
def grid_tiled_block(spark, sf_dir):
    """One block of a grid, converted from a grid of edges: only its folder is opened."""
    path, target = new_path(spark, "grid"), new_path(spark, "tiled")
    vertices, edges = _graph(spark, sf_dir)
    edge_list = new_path(spark, "edges")
    formats.write_edge_list(edges, vertices, edge_list)
    convert.convert(spark, "gridcut", edge_list, path, chunks=4)
    convert.convert(spark, "gridedgelistbin2csrtiledmatrix", path, target, chunks=4)
    return tiled.read_tiled(spark, target, (1, 0))


def _pivots(spark, sf_dir, kinds: int = 1) -> str:
    path = new_path(spark, "pivots")
    documents.write_pivots(documents.pivot_edges(supply_graph(spark, sf_dir), "source"), path, 7, 1, "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", kinds, compression="gzip")
    return path


KIND = "'default_' || (('0x' || substr(md5('42_' || {v}), 1, 15))::BIGINT % 3)"


@query(f"WITH {G2}, {ENDS.format(g='g2')}, t AS (SELECT DISTINCT {KIND.format(v='src')} s, {KIND.format(v='dst')} d FROM g2), n AS (SELECT (SELECT count(*) FROM ends) v, (SELECT count(*) FROM g2) e, (SELECT count(DISTINCT {KIND.format(v='id')}) FROM ends) l, (SELECT count(*) FROM t) k) SELECT 7::BIGINT graph_id, v::BIGINT num_vertices, e::BIGINT num_edges, l::BIGINT num_vertex_labels, k::BIGINT num_edge_label_triples, s src_label, 'default' AS label, d dst_label FROM t, n")
def pivot_structure(spark, sf_dir):
    """The side file with the labels and label triples of the graph."""
    rows = spark.read.json(f"{_pivots(spark, sf_dir, 3)}/graph_structure").withColumn("e", F.explode("edges"))
    return rows.select("graph_id", "num_vertices", "num_edges", "num_vertex_labels", "num_edge_label_triples", "e.src_label", "e.label", "e.dst_label")


@query(f"WITH {G2} SELECT DISTINCT 7::BIGINT graph_id, 1::BIGINT business_id, 'pg_' || src pivot_graph_id FROM g2")
def pivot_ids(spark, sf_dir):
    return spark.read.json(f"{_pivots(spark, sf_dir)}/pivot_graph_ids").select("graph_id", "business_id", "pivot_graph_id")


@query(f"WITH {G2}, {ENDS.format(g='g2')} SELECT id, {KIND.format(v='id')} AS label FROM ends")
def pivot_labels(spark, sf_dir):
    """One of three texts for each vertex, by a seeded hash."""
    return structure.endpoints(supply_graph(spark, sf_dir)).select("id", documents.default_label(F.col("id"), 3).alias("label"))


@query("SELECT 12::BIGINT n_documents")
def pivot_limit(spark, sf_dir):
    """A limit at the reader, which counts documents."""
    found = formats.read_pivots(spark, f"{_pivots(spark, sf_dir)}/pivot_graphs", graph_id=7, limit=12)
    return found.agg(F.count_distinct("pivot_graph_id").alias("n_documents"))

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import convert, storage
from lattica.functions import hashes
from lattica.operators import documents, tiled
from lattica.sources import formats
from lattica.streaming.degrees import streaming_degrees

EDGES = [(0, 1), (0, 3), (2, 1), (7, 0)]


@pytest.fixture
def graph(spark):
    vertices = spark.createDataFrame([(0, 4), (1, 1), (2, 2), (3, 3), (7, 0)], "id long, label long")
    return vertices, spark.createDataFrame(EDGES, "src long, dst long")


def edges_of(df):
    return sorted((r.src, r.dst) for r in df.collect())


def labels_of(df):
    return sorted((r.id, r.label) for r in df.collect())


def test_csv_keeps_an_unterminated_last_line(spark, tmp_path):
    (tmp_path / "g.csv").write_text("0,1\n0,3\n2,1\nx,\n7,0")
    assert edges_of(formats.read_csv_edges(spark, str(tmp_path / "g.csv"))) == EDGES


def test_text_graph(spark, graph, tmp_path):
    path = str(tmp_path / "lines")
    formats.write_lines(formats.egsm_lines(*graph), path)
    text = [line for p in sorted(Path(path).glob("part-*")) for line in p.read_text().splitlines()]
    assert text[0] == "t 5 4" and text[1] == "v 0 4 3" and text[-1] == "e 7 0"
    vertices, edges = formats.read_text_graph(spark, path)
    assert labels_of(vertices) == labels_of(graph[0]) and edges_of(edges) == EDGES
    assert edges_of(formats.read_text_graph(spark, path, reverse=True)[1]) == sorted((b, a) for a, b in EDGES)
    vf3 = [r.line for r in formats.vf3_lines(*graph).orderBy("section", "a", "b").collect()]
    assert vf3[:2] == ["5", "0 4"] and vf3[6:9] == ["2", "0 1", "0 3"]
    assert formats.ceci_lines(*graph).filter("line = 't # 0'").count() == 1


def test_binary_edge_list(spark, graph, tmp_path):
    folder = f"file://{tmp_path}/edges"
    formats.write_edge_list(graph[1], graph[0], folder)
    vertices, edges = formats.read_edge_list(spark, folder)
    assert labels_of(vertices) == labels_of(graph[0]) and edges_of(edges) == EDGES
    assert formats.read_yaml(f"{folder}/meta.yaml") == {"num_vertices": 5, "num_edges": 4, "max_vid": 7, "min_vid": 0}


def test_compressed_rows(spark, graph, tmp_path):
    folder = f"file://{tmp_path}/csr"
    formats.write_csr(*graph, folder)
    vertices, edges = formats.read_csr(spark, folder)
    assert labels_of(vertices) == labels_of(graph[0]) and edges_of(edges) == EDGES
    meta = formats.read_yaml(f"{folder}/meta.yaml")
    assert meta["num_edges"] == 8 and meta["num_subgraphs"] == 1 and meta["subgraphs"] == [{"gid": 0, "num_vertices": 5, "num_incoming_edges": 4, "num_outgoing_edges": 4, "max_vid": 7, "min_vid": 0}]
    # ids, in- and out-degrees, offsets, in- and out-neighbours, ids by place, places by id
    expected = [[0, 1, 2, 3, 7], [1, 2, 0, 1, 0], [2, 0, 1, 0, 1], [0, 1, 3, 3, 4, 4], [0, 2, 2, 3, 3, 4], [4, 0, 2, 0], [1, 3, 1, 0], list(range(8)), [0, 1, 2, 3, 2**32 - 1, 2**32 - 1, 2**32 - 1, 4]]
    assert np.fromfile(tmp_path / "csr/graphs/0.bin", "<u4").tolist() == sum(expected, [])
    formats.write_native_csr(graph[1], folder)
    assert (tmp_path / "csr/native_csrDest_u32.bin").stat().st_size == 16


def test_matrix_and_arrays(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.5])], "i long, vec array<double>")
    formats.write_matrix(rows, f"file://{tmp_path}/m", 2)
    assert sorted((r.i, list(r.vec)) for r in formats.read_matrix(spark, f"file://{tmp_path}/m").collect()) == [(0, [1.0, 2.0]), (1, [3.0, 4.5])]
    formats.write_array(spark.range(5), f"file://{tmp_path}/ids.bin", "<u8")
    assert sorted(r.v0 for r in formats.read_array(spark, f"file://{tmp_path}/ids.bin", "<u8").collect()) == [0, 1, 2, 3, 4]


def test_arrays_are_joined_by_their_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "RANGE", 40_000)
    path = f"file://{tmp_path}/long.bin"
    np.arange(100_000, dtype="<u4")[::-1].tofile(f"{tmp_path}/long.bin")
    rows = formats.read_array(spark, path)
    assert rows.filter("pos + v0 = 99999").count() == rows.select("pos").distinct().count() == 100_000
    assert formats.read_array(spark, path, offset=8, count=0).count() == 0
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        joined = rows.join(formats.read_array(spark, path).withColumnRenamed("v0", "w"), "pos")
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.filter("v0 = w").count() == 100_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_pivots(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "src long, dst long")
    found = documents.pivot_edges(edges, "source")
    assert sorted((r.pivot_id, r.n_vertices, r.n_edges) for r in documents.pivot_stats(found).collect()) == [("pg_1", 3, 2), ("pg_4", 2, 1)]
    documents.pivot_documents(found, 3, 9, "t", "p", kinds=2).write.json(str(tmp_path / "a"))
    assert edges_of(formats.read_pivots(spark, str(tmp_path / "a"), 3, 9)) == [(1, 2), (1, 3), (4, 5)]
    assert formats.read_pivots(spark, str(tmp_path / "a"), 4).count() == 0
    (tmp_path / "flat.json").write_text('{"graph_id":1,"business_id":2,"vertices":[{"id":"1","label":"x"}],"edges":[{"src_id":"1","dst_id":"2","label":"y"}]}\n')
    assert edges_of(formats.read_pivots(spark, str(tmp_path / "flat.json"))) == [(1, 2)]


def test_pivots_are_shuffled_as_ids_and_written_packed(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "src long, dst long")
    found = documents.pivot_edges(edges, "source")
    plan = documents.pivot_documents(found, 3, 9, "t", "p")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(struct(src" in plan
    for name, how in (("plain", "none"), ("packed", "gzip")):
        documents.write_pivots(found, str(tmp_path / name), 3, 9, "t", "p", compression=how)
    for part in ("pivot_graphs", "pivot_graph_ids", "graph_structure"):
        plain, packed = (sorted(r.value for r in spark.read.text(str(tmp_path / name / part)).collect()) for name in ("plain", "packed"))
        assert plain == packed and list((tmp_path / "packed" / part).glob("*.json.gz"))
    assert edges_of(formats.read_pivots(spark, str(tmp_path / "packed" / "pivot_graphs"), 3, 9)) == [(1, 2), (1, 3), (4, 5)]


def test_random_graph_and_logs(spark, tmp_path):
    vertices, edges = formats.random_graph(spark, 30, 60, seed=3)
    have = set(edges_of(edges))
    assert vertices.count() == 30 and not {(b, a) for a, b in have} & have
    assert have == set(edges_of(formats.random_graph(spark, 30, 60, seed=3)[1]))
    (tmp_path / "log").write_text("a elapsed: 1.5 s\nnothing\nelapsed 2\n")
    assert formats.elapsed_sum(spark, str(tmp_path / "log")).first().total == 3.5
    ids = spark.createDataFrame([("12",), ("x1",)], "t string").select(formats.stable_id("t").alias("id")).collect()
    assert ids[0].id == 12
    assert [r.h for r in spark.createDataFrame([("",), ("a",), ("foobar",)], "t string").select(hashes.fnv1a32(F.col("t")).alias("h")).collect()] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]


def test_streaming_degrees(spark, tmp_path):
    spark.createDataFrame(EDGES, "src long, dst long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
    query = streaming_degrees(stream).writeStream.format("memory").queryName("degrees_seen").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.sql("select id, in_degree, out_degree from degrees_seen").collect())) == [(0, 1, 2), (1, 2, 0), (2, 0, 1), (3, 1, 0), (7, 0, 1)]


@pytest.mark.parametrize("mode", ["edgelistcsv2edgelistbin", "edgelistcsv2csrbin", "edgelistcsv2egsm", "edgelistcsv2bittiledmatrix", "edgelistcsv2arangodbjson", "edgelistcsv2cggraphcsr"])
def test_conversions(spark, tmp_path, mode):
    (tmp_path / "g.csv").write_text("0,1\n0,3\n2,1\n3,0")
    target = f"file://{tmp_path}/out"
    convert.convert(spark, mode, f"file://{tmp_path}/g.csv", target)
    read = {"edgelistbin": lambda: formats.read_edge_list(spark, target)[1], "csrbin": lambda: formats.read_csr(spark, target)[1], "egsm": lambda: formats.read_text_graph(spark, target)[1], "bittiledmatrix": lambda: tiled.read_tiled(spark, target), "arangodbjson": lambda: formats.read_pivots(spark, f"{target}/pivot_graphs"), "cggraphcsr": lambda: formats.read_native_csr(spark, target)}
    assert edges_of(read[mode.partition("2")[2]]()) == [(0, 1), (0, 3), (2, 1), (3, 0)]
    with pytest.raises(ValueError):
        convert.convert(spark, "x2y", "a", "b")


def test_folders_of_other_schemes():
    assert storage.file_system("/a/b")[1] == storage.file_system("file:///a/b")[1] == "/a/b"
    assert storage.file_system("dbfs:/x/y")[1] == "/dbfs/x/y"
    assert storage.SCHEMES["s3a"] == "s3"


def test_stored_tables_are_deleted(spark):
    a, b = storage.stored(spark.range(3), "a"), storage.bucketed(spark.range(3), "b", "id")
    assert a.count() == b.count() == 3
    storage.released(a, b)
    assert not Path(a._stored_at.removeprefix("file://")).exists() and not Path(b._stored_at.removeprefix("file://")).exists()


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1990
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).filter(F.col("src") == F.col("dst")).count() == 0


def test_workers_need_no_copy_of_the_library(tmp_path):
    """Driver in another folder, workers without a path to the library."""
    root = str(Path(__file__).resolve().parents[1])
    lines = [
        f"import sys; sys.path.insert(0, {root!r})",
        "from pyspark.sql import SparkSession",
        "from lattica.sources import formats",
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()",
        f"formats.write_array(spark.range(5).select('id'), {str(tmp_path / 'a.bin')!r})",
        f"print(formats.read_array(spark, {str(tmp_path / 'a.bin')!r}).count())",
    ]
    known = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", "\n".join(lines)], cwd=tmp_path, env=known, capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["5"], done.stderr[-2000:]

"""Text and binary graph formats. Text goes through Spark's readers and writers.

Binary files are read in byte ranges, one task a range, from any store that
pyarrow opens by URI. They are written as parts, one task a range of the order;
the driver then only puts the parts' bytes one after the other into the single
file that such formats ask for. Parquet is the format to keep large graphs in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashes
from ..operators.structure import csr_offsets, degrees, endpoints, running
from ..shipping import ship_modules
from ..storage import file_system, new_path, released, rows_total, stored, stored_with

RANGE = 1 << 23


# -- text ---------------------------------------------------------------------


def read_csv_edges(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """src, dst of a file without header; lines that are not two numbers are left out."""
    rows = spark.read.csv(path, schema="src long, dst long", sep=sep[0], mode="PERMISSIVE")
    return rows.dropna()


def read_text_graph(spark: SparkSession, path: str, reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """vertices(id, label) and edges(src, dst) of lines ``t ...``, ``v id label degree``, ``e src dst``."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    number = lambda i: F.get("p", F.lit(i)).cast("long")
    vertices = parts.filter(F.get("p", F.lit(0)) == "v").select(number(1).alias("id"), number(2).alias("label"))
    a, b = (2, 1) if reverse else (1, 2)
    return vertices, parts.filter(F.get("p", F.lit(0)) == "e").select(number(a).alias("src"), number(b).alias("dst"))


def _sections(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = vertices.join(degrees(edges), "id", "left").na.fill(0, ["in_degree", "out_degree"])
    return known, edges


def _line(df: DataFrame, section: int, a, b, *words) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.lit(a).cast("long").alias("a") if isinstance(a, int) else F.col(a).alias("a"), F.lit(b).cast("long").alias("b") if isinstance(b, int) else F.col(b).alias("b"), F.concat_ws(" ", *[F.lit(w[1:]) if isinstance(w, str) and w[:1] == "=" else (F.col(w).cast("string") if isinstance(w, str) else w.cast("string")) for w in words]).alias("line"))


def egsm_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """section, a, b, line: header ``t N M``, ``v id label degree``, ``e src dst``."""
    v, e = _sections(vertices, edges)
    n, m = vertices.agg(F.count("*").alias("n")), edges.agg(F.count("*").alias("m"))
    head = _line(n.crossJoin(m), 0, 0, 0, "=t", "n", "m")
    return head.union(_line(v, 1, "id", 0, "=v", "id", "label", F.col("in_degree") + F.col("out_degree"))).union(_line(e, 2, "src", "dst", "=e", "src", "dst"))


def gnnpe_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """As above without header, edges with label 0."""
    v, e = _sections(vertices, edges)
    return _line(v, 1, "id", 0, "=v", "id", "label", F.col("in_degree") + F.col("out_degree")).union(_line(e, 2, "src", "dst", "=e", "src", "dst", "=0"))


def ceci_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """As above with header ``t # 0``."""
    head = _line(vertices.agg(F.count("*").alias("n")), 0, 0, 0, "=t # 0")
    return head.union(gnnpe_lines(vertices, edges))


def vf3_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``N``, ``id label``, then for each vertex its out-degree and ``src dst`` lines."""
    v, e = _sections(vertices, edges)
    head = _line(vertices.agg(F.count("*").alias("n")), 0, 0, 0, "n")
    return head.union(_line(v, 1, "id", 0, "id", "label")).union(_line(v, 2, "id", -1, "out_degree")).union(_line(e, 2, "src", "dst", "src", "dst"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Text parts whose concatenation in name order is the file."""
    lines.orderBy("section", "a", "b").select("line").write.text(path)


def elapsed_sum(spark: SparkSession, path: str, pattern: str = r"elapsed:?\s*([0-9.]+)") -> DataFrame:
    """total: the seconds that log lines report."""
    found = spark.read.text(path).select(F.regexp_extract("value", pattern, 1).alias("s")).filter("s <> ''")
    return found.agg(F.sum(F.col("s").cast("double")).alias("total"))


# -- binary -------------------------------------------------------------------


def _size(path: str) -> int:
    where, at = file_system(path)
    return where.get_file_info(at).size


def read_array(spark: SparkSession, path: str, kind: str = "<u4", offset: int = 0, count: int | None = None, width: int = 1) -> DataFrame:
    """pos and v0, v1, ...: records of ``width`` numbers, read in byte ranges by as many tasks."""
    record = np.dtype(kind).itemsize * width
    total = (_size(path) - offset) // record if count is None else count
    per = max(1, RANGE // record)
    names = [f"v{i}" for i in range(width)]
    real = np.dtype(kind).kind == "f"

    def run(batches):
        where, at = file_system(path)
        with where.open_input_file(at) as source:
            first, values = 0, np.empty((0, width), kind)
            for batch in batches:
                # the places of a task follow each other
                places = batch.column(0).to_numpy()
                low, high = (int(places[0]), int(places[-1]) + 1) if len(places) else (0, 0)
                while low < high:
                    if not first <= low < first + len(values):
                        n = min(per, total - low)
                        first, values = low, np.frombuffer(source.read_at(n * record, offset + low * record), kind).reshape(n, width)
                    end = min(high, first + len(values))
                    rows = values[low - first : end - first]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, end)), *[pa.array(rows[:, i].astype(np.float64 if real else np.int64)) for i in range(width)]], ["pos", *names])
                    low = end

    ship_modules(spark)
    blocks = -(-total // per)
    schema = ", ".join(["pos long", *[f"{n} {'double' if real else 'long'}" for n in names]])
    # one row a record, not one a block: from a few rows the planner would take any array for small enough to broadcast
    return spark.range(0, total, 1, max(1, min(blocks, 10_000))).mapInArrow(run, schema)


def write_parts(rows: DataFrame, path: str, kind: str = "<u4") -> list[tuple[str, int]]:
    """(file, bytes) of the numbers of ``rows``, in their order: a file for each of their partitions."""

    def write(batches):
        where, at = file_system(path)
        where.create_dir(at, recursive=True)
        part, size = TaskContext.get().partitionId(), 0
        name = f"part-{part:06d}-{TaskContext.get().taskAttemptId()}.bin"
        with where.open_output_stream(f"{at}/{name}") as out:
            for batch in batches:
                data = np.column_stack([np.asarray(c) for c in batch.columns]).astype(kind).tobytes()
                out.write(data)
                size += len(data)
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{path}/{name}"], "size": [size]})

    ship_modules(rows.sparkSession)
    found = stored(rows.mapInArrow(write, "part long, file string, size long"), "parts")
    out = [(r.file, r.size) for r in sorted(found.collect())]
    released(found)
    return out


def join_parts(parts: list[tuple[str, int]], path: str) -> int:
    """Puts the parts one after the other into one file and deletes them; how many bytes."""
    where, at = file_system(path)
    where.create_dir(at.rpartition("/")[0], recursive=True)
    with where.open_output_stream(at) as out:
        for file, _ in parts:
            source, name = file_system(file)
            with source.open_input_stream(name) as part:
                while data := part.read(RANGE):
                    out.write(data)
            source.delete_file(name)
    return sum(size for _, size in parts)


def write_array(rows: DataFrame, path: str, kind: str = "<u4") -> int:
    """The columns of ``rows``, in their order, as one file of numbers; how many bytes."""
    return join_parts(write_parts(rows, new_path(rows.sparkSession, "parts"), kind), path)


def _yaml_lines(value, indent: int) -> list[str]:
    pad = "  " * indent
    if isinstance(value, dict):
        return [line for k, v in value.items() for line in ([f"{pad}{k}:", *_yaml_lines(v, indent + 1)] if isinstance(v, (dict, list)) else [f"{pad}{k}: {v}"])]
    out = []
    for item in value:
        lines = _yaml_lines(item, indent + 1)
        out += [f"{pad}- {lines[0].strip()}", *lines[1:]]
    return out


def write_yaml(path: str, section: str, values: dict) -> None:
    """Scalars, dicts of them and lists of dicts under one section."""
    where, at = file_system(path)
    where.create_dir(at.rpartition("/")[0], recursive=True)
    with where.open_output_stream(at) as out:
        out.write(("\n".join([f"{section}:", *_yaml_lines(values, 1)]) + "\n").encode())


def _scalar(text: str):
    text = text.strip()
    return int(text) if text.lstrip("-").isdigit() else text


def _yaml_block(lines: list[tuple[int, str]]):
    """The value of lines (indent, text) of one block."""
    if lines[0][1].startswith("- "):
        starts = [i for i, (n, t) in enumerate(lines) if n == lines[0][0] and t.startswith("- ")]
        items = [lines[a:b] for a, b in zip(starts, [*starts[1:], len(lines)])]
        return [_yaml_block([(n + 2, item[0][1][2:]) for n in [item[0][0]]] + item[1:]) for item in items]
    out, i = {}, 0
    while i < len(lines):
        indent, text = lines[i]
        key, _, rest = text.partition(":")
        end = i + 1
        while end < len(lines) and (lines[end][0] > indent or lines[end][0] == indent and lines[end][1].startswith("- ")):
            end += 1
        out[key.strip()] = _scalar(rest) if rest.strip() or end == i + 1 else _yaml_block(lines[i + 1 : end])
        i = end
    return out


def read_yaml(path: str) -> dict:
    """What the first section of such a file holds."""
    where, at = file_system(path)
    with where.open_input_stream(at) as source:
        lines = [(len(x) - len(x.lstrip()), x.strip()) for x in source.read().decode().splitlines() if x.strip()]
    return next(iter(_yaml_block(lines).values()))


def write_edge_list(edges: DataFrame, vertices: DataFrame, folder: str) -> None:
    """edgelist.bin (pairs), localid2globalid.bin, vlabel.bin and meta.yaml."""
    stats = vertices.agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    n = write_array(edges.select("src", "dst").orderBy("src", "dst"), f"{folder}/edgelist.bin") // 8
    write_array(vertices.select("id").orderBy("id"), f"{folder}/localid2globalid.bin")
    write_array(vertices.orderBy("id").select("label"), f"{folder}/vlabel.bin")
    write_yaml(f"{folder}/meta.yaml", "EdgelistBin", {"num_vertices": stats.n, "num_edges": n, "max_vid": stats.high, "min_vid": stats.low})


def read_edge_list(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """vertices(id, label) and edges(src, dst)."""
    edges = read_array(spark, f"{folder}/edgelist.bin", width=2).select(F.col("v0").alias("src"), F.col("v1").alias("dst"))
    ids = read_array(spark, f"{folder}/localid2globalid.bin").select("pos", F.col("v0").alias("id"))
    labels = read_array(spark, f"{folder}/vlabel.bin").select("pos", F.col("v0").alias("label"))
    return ids.join(labels, "pos").select("id", "label"), edges


def write_csr(vertices: DataFrame, edges: DataFrame, folder: str) -> None:
    """graphs/0.bin (ids, degrees, offsets, neighbours, then the two id maps), label/0.bin, meta.yaml.

    Vertices are numbered by ascending id; neighbours are those numbers, sorted.
    Every array is made and written by ranges; no list is held whole.
    """
    spark = edges.sparkSession
    known, facts = stored_with(running(vertices.select("id", "label"), ["id"], "local"), "local", rows_total(), F.min("id").alias("low"), F.max("id").alias("high"))
    n, low, high = facts["n"], facts["low"] or 0, -1 if facts["high"] is None else facts["high"]
    name = lambda end, to: known.select(F.col("id").alias(end), F.col("local").alias(to))
    links, facts = stored_with(edges.join(name("src", "s"), "src").join(name("dst", "d"), "dst").select("s", "d"), "links", rows_total())
    m = facts["n"]
    count = lambda end, to: links.groupBy(F.col(end).alias("local")).agg(F.count("*").alias(to))
    rows = stored(known.join(count("d", "ins"), "local", "left").join(count("s", "outs"), "local", "left").na.fill(0, ["ins", "outs"]), "rows")
    total = spark.createDataFrame([(m,)], "at long")
    offsets = lambda c: running(rows.select("local", c), ["local"], "at", c).orderBy("local").select("at").union(total)
    every = spark.range(high + 1)
    back = every.join(known.select("id", "local"), "id", "left").orderBy("id").select(F.coalesce("local", F.lit(0xFFFFFFFF)))
    ordered = lambda c: rows.orderBy("local").select(c)
    arrays = [ordered("id"), ordered("ins"), ordered("outs"), offsets("ins"), offsets("outs"), links.orderBy("d", "s").select("s"), links.orderBy("s", "d").select("d"), every, back]
    parts = [part for array in arrays for part in write_parts(array, new_path(spark, "parts"))]
    join_parts(parts, f"{folder}/graphs/0.bin")
    write_array(ordered("label"), f"{folder}/label/0.bin")
    part = {"gid": 0, "num_vertices": n, "num_incoming_edges": m, "num_outgoing_edges": m, "max_vid": high, "min_vid": low}
    write_yaml(f"{folder}/meta.yaml", "GraphMetadata", {"num_vertices": n, "num_edges": 2 * m, "max_vid": high, "min_vid": low, "count_border_vertices": 0, "num_subgraphs": 1, "subgraphs": [part]})
    released(known, links, rows)


def read_csr(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """vertices(id, label) and edges(src, dst) in original ids, read by ranges; no list is held whole."""
    meta = read_yaml(f"{folder}/meta.yaml")
    n, m, file = meta["num_vertices"], meta["num_edges"] // 2, f"{folder}/graphs/0.bin"
    ids = read_array(spark, file, count=n).select("pos", F.col("v0").alias("id"))
    starts = read_array(spark, file, offset=4 * (4 * n + 1), count=n).select("pos", F.col("v0").alias("first"))
    counts = read_array(spark, file, offset=8 * n, count=n).select("pos", F.col("v0").alias("n"))
    owners = starts.join(counts, "pos").filter("n > 0").select(F.col("pos").alias("s"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("at"))
    nbrs = read_array(spark, file, offset=4 * (5 * n + 2 + m), count=m).select(F.col("pos").alias("at"), F.col("v0").alias("d"))
    name = lambda c, to: ids.select(F.col("pos").alias(c), F.col("id").alias(to))
    edges = owners.join(nbrs, "at").join(name("s", "src"), "s").join(name("d", "dst"), "d").select("src", "dst")
    labels = read_array(spark, f"{folder}/label/0.bin").select("pos", F.col("v0").alias("label"))
    return ids.join(labels, "pos").select("id", "label"), edges


def write_native_csr(edges: DataFrame, folder: str) -> None:
    """native_csrOffset_u32.bin, native_csrDest_u32.bin and zero weights, for dense ids from 0."""
    offsets = csr_offsets(edges).orderBy("id").select("out_offset")
    n = write_array(edges.orderBy("src", "dst").select("dst"), f"{folder}/native_csrDest_u32.bin") // 4
    write_array(offsets.union(edges.sparkSession.createDataFrame([(n,)], "out_offset long")), f"{folder}/native_csrOffset_u32.bin")
    write_array(edges.orderBy("src", "dst").select(F.lit(0).alias("w")), f"{folder}/native_csrWeight_u32.bin")


def write_matrix(rows: DataFrame, folder: str, columns: int) -> None:
    """embedding.bin (row-major f32) and meta.yaml of rows (i, vec), by ascending i."""
    n = write_array(rows.orderBy("i").select(*[F.col("vec")[k].alias(f"x{k}") for k in range(columns)]), f"{folder}/embedding.bin", "<f4") // (4 * columns)
    write_yaml(f"{folder}/meta.yaml", "Matrix", {"dtype": "float32", "x": n, "y": columns, "endian": "little", "order": "row"})


def read_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """i, vec of such a folder."""
    meta = read_yaml(f"{folder}/meta.yaml")
    rows = read_array(spark, f"{folder}/embedding.bin", "<f4", width=meta["y"])
    return rows.select(F.col("pos").alias("i"), F.array(*[F.col(f"v{k}") for k in range(meta["y"])]).alias("vec"))


# -- documents and generators -------------------------------------------------


def read_pivots(spark: SparkSession, path: str, graph_id: int | None = None, business_id: int | None = None, limit: int | None = None) -> DataFrame:
    """graph_id, business_id, pivot_graph_id, src, dst, label of exported or flat pivot documents.

    The filters reach the JSON reader; ``limit`` counts documents.
    """
    vertex, edge = "id string, label string", "src_id string, dst_id string, srcId string, dstId string, label string"
    schema = f"graph_id long, business_id long, pivot_graph_id string, vertices array<struct<{vertex.replace(' string', ':string')}>>, edges array<struct<{edge.replace(' string', ':string')}>>, graph struct<main:struct<vertices:array<struct<{vertex.replace(' string', ':string')}>>,edges:array<struct<{edge.replace(' string', ':string')}>>>>"
    docs = spark.read.json(path, schema=schema)
    for name, want in (("graph_id", graph_id), ("business_id", business_id)):
        docs = docs if want is None else docs.filter(F.col(name) == want)
    docs = docs if limit is None else docs.limit(limit)
    rows = docs.select("graph_id", "business_id", "pivot_graph_id", F.explode(F.coalesce("edges", "graph.main.edges")).alias("e"))
    return rows.select("graph_id", "business_id", "pivot_graph_id", F.coalesce("e.src_id", "e.srcId").cast("long").alias("src"), F.coalesce("e.dst_id", "e.dstId").cast("long").alias("dst"), F.col("e.label").alias("label"))


def random_graph(spark: SparkSession, n: int, m: int, classes: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """vertices(id, label) and about ``m`` edges more than a tree from vertex 0; no pair both ways, no loops."""
    pick = lambda kind: hashes.portable(F.lit(seed), F.lit(kind), "id")
    vertices = spark.range(n).select("id", (pick("label") % classes).alias("label"))
    tree = spark.range(1, max(n, 1)).select((pick("tree") % F.col("id")).alias("a"), F.col("id").alias("b"))
    more = spark.range(m).select((pick("x") % n).alias("x"), (pick("y") % n).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return vertices, tree.union(more).filter("a <> b").distinct().select(F.col("a").alias("src"), F.col("b").alias("dst"))


def stable_id(text) -> object:
    """Digits as their number, else FNV-1a with 32 bits."""
    return hashes.stable_id(F.col(text) if isinstance(text, str) else text)


def write_roots(roots: DataFrame, path: str) -> int:
    """The ids of matched roots, ascending, 8 bytes each; how many bytes."""
    return write_array(roots.select("root").orderBy("root"), path, "<u8")


def read_roots(spark: SparkSession, path: str) -> DataFrame:
    return read_array(spark, path, "<u8").select(F.col("v0").alias("root"))


def read_native_csr(spark: SparkSession, folder: str) -> DataFrame:
    """pos, src, dst of such files: ids are places, so they are dense from 0."""
    ends = read_array(spark, f"{folder}/native_csrOffset_u32.bin").select("pos", F.col("v0").alias("first"))
    spans = ends.join(ends.select((F.col("pos") - 1).alias("pos"), F.col("first").alias("past")), "pos").filter("first < past")
    owners = spans.select(F.col("pos").alias("src"), F.explode(F.sequence("first", F.col("past") - 1)).alias("pos"))
    return owners.join(read_array(spark, f"{folder}/native_csrDest_u32.bin"), "pos").select("pos", "src", F.col("v0").alias("dst"))


def graph_of(edges: DataFrame, classes: int = 5) -> tuple[DataFrame, DataFrame]:
    """(vertices with modulo labels, edges)."""
    return endpoints(edges).select("id", F.pmod("id", F.lit(classes)).alias("label")), edges

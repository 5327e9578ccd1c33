"""Conversions between graph formats, and grid partitioning, as functions and from the command line.

    python -m lattica.convert MODE SOURCE TARGET [--sep ,] [--chunks 4] [--tile 256] ...

A mode names what is read and what is written. All compose the scans and sinks
of ``sources.formats`` and ``operators.tiled``; sources and targets are paths
that all executors see.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import documents, structure, tiled
from .operators.partition import grid, write_blocks
from .sources import formats

Graph = tuple[DataFrame, DataFrame]


def _csv(spark: SparkSession, source: str, sep: str = ",", classes: int = 5, **_) -> Graph:
    return formats.graph_of(formats.read_csv_edges(spark, source, sep), classes)


def _blocks(spark: SparkSession, source: str, classes: int = 5, **_) -> Graph:
    return formats.graph_of(spark.read.parquet(source).select("src", "dst"), classes)


SCANS: dict[str, Callable[..., Graph]] = {
    "edgelistcsv": _csv,
    "edgelistbin": lambda spark, source, **_: formats.read_edge_list(spark, source),
    "csrbin": lambda spark, source, **_: formats.read_csr(spark, source),
    "egsm": lambda spark, source, **_: formats.read_text_graph(spark, source),
    "gridedgelistbin": _blocks,
}


def _pivots(graph: Graph, target: str, pivot: str = "source", hops: int = 2, graph_id: int = 0, business_id: int = 0, time: str = "1970-01-01T00:00:00Z", **_) -> None:
    documents.write_pivots(documents.pivot_edges(graph[1], pivot, hops), target, graph_id, business_id, time, time)


def _tiles(kind: str):
    return lambda graph, target, tile=256, chunks=1, **_: tiled.write_tiled(graph[1], target, kind, tile, chunks, graph[0])


def _native(graph: Graph, target: str, **_) -> None:
    ids = structure.dense_ids(graph[0])
    formats.write_native_csr(structure.local_edges(graph[1], ids), target)


SINKS: dict[str, Callable[..., None]] = {
    "edgelistbin": lambda graph, target, **_: formats.write_edge_list(graph[1], graph[0], target),
    "transposededgelistbin": lambda graph, target, **_: formats.write_edge_list(structure.transpose(graph[1]), graph[0], target),
    "csrbin": lambda graph, target, **_: formats.write_csr(*graph, target),
    "cggraphcsr": _native,
    "egsm": lambda graph, target, **_: formats.write_lines(formats.egsm_lines(*graph), target),
    "ceci": lambda graph, target, **_: formats.write_lines(formats.ceci_lines(*graph), target),
    "gnnpe": lambda graph, target, **_: formats.write_lines(formats.gnnpe_lines(*graph), target),
    "vf3": lambda graph, target, **_: formats.write_lines(formats.vf3_lines(*graph), target),
    "arangodbjson": _pivots,
    "tiledmatrix": _tiles("csr"),
    "csrtiledmatrix": _tiles("csr"),
    "bittiledmatrix": _tiles("bit"),
    "grid": lambda graph, target, chunks=4, **_: write_blocks(grid(graph[1], chunks), target),
}


def convert(spark: SparkSession, mode: str, source: str, target: str, **options) -> None:
    """``mode`` is ``<scan>2<sink>``, any of ``SCANS`` and ``SINKS``; ``gridcut`` is edgelistbin2grid."""
    scan, _, sink = ("edgelistbin2grid" if mode == "gridcut" else mode).partition("2")
    if scan not in SCANS or sink not in SINKS:
        raise ValueError(f"no conversion {mode!r}")
    SINKS[sink](SCANS[scan](spark, source, **options), target, **options)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("mode", "source", "target"):
        parser.add_argument(name)
    for name, kind in (("sep", str), ("classes", int), ("chunks", int), ("tile", int), ("pivot", str), ("hops", int), ("graph-id", int), ("business-id", int), ("time", str)):
        parser.add_argument(f"--{name}", type=kind, dest=name.replace("-", "_"))
    given = vars(parser.parse_args())
    convert(SparkSession.builder.getOrCreate(), given.pop("mode"), given.pop("source"), given.pop("target"), **{k: v for k, v in given.items() if v is not None})


if __name__ == "__main__":
    main()

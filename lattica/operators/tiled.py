"""Tiled matrices on disk: Parquet in folders of blocks, each tile in rows of its own.

A matrix is cut into ``chunks`` x ``chunks`` blocks and each block into tiles (see
``partition``); only tiles that are not empty are kept. ``csr``: a row for each
row of a tile, with its columns and where they begin among the tile's entries.
``bit``: 32-bit words of each row of a tile. Beside the tiles lie the shape
(``meta``) and, for grids, the labels of the vertices. A single matrix is a grid
of one block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .partition import bit_tiles, grid, scope_of, tiles, width_of

TILE = ["block_x", "block_y", "tile_x", "tile_y"]


def csr_tiles(tiled: DataFrame) -> DataFrame:
    """block_x, block_y, tile_x, tile_y, x_in, first (entries of the tile before this row), cols (sorted; at most a tile's width)."""
    return _with_first(tiled.groupBy(*TILE, "x_in").agg(F.sort_array(F.collect_set("y_in")).alias("cols")))


def _with_first(rows: DataFrame) -> DataFrame:
    before = F.sum(F.size("cols")).over(Window.partitionBy(*TILE).orderBy("x_in").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(*TILE, "x_in", F.coalesce(before, F.lit(0)).alias("first"), "cols")


def write_csr_rows(rows: DataFrame, path: str, chunks: int, scope: int, tile_size: int) -> None:
    """``write_tiled`` of rows of tiles (block_x, block_y, tile_x, tile_y, x_in, cols), each there once."""
    strips = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block_x", "block_y", "tile_x")
    _write(_with_first(strips), path, "csr", chunks, scope, tile_size)


def _write(rows: DataFrame, path: str, kind: str, chunks: int, scope: int, tile_size: int) -> None:
    rows.sortWithinPartitions(*TILE, "x_in").write.partitionBy("block_x", "block_y").parquet(f"{path}/tiles")
    rows.sparkSession.createDataFrame([(kind, chunks, scope, width_of(scope, tile_size))], "kind string, chunks long, scope long, tile_size long").coalesce(1).write.parquet(f"{path}/meta")


def write_tiled(edges: DataFrame, path: str, kind: str, tile_size: int, chunks: int = 1, vertices: DataFrame | None = None) -> None:
    """Cuts ``edges`` into blocks and tiles and writes them under ``path``; ``kind`` is ``csr`` or ``bit``."""
    scope = scope_of(edges, chunks)
    tiled = tiles(grid(edges.select("src", "dst"), chunks, scope), scope, tile_size)
    if kind == "csr":
        rows = csr_tiles(tiled)
    elif kind == "bit":
        rows = bit_tiles(tiled).withColumns({"block_x": F.expr(f"block_id div {chunks}"), "block_y": F.col("block_id") % chunks}).drop("block_id")
    else:
        raise ValueError(f"no kind of tiles {kind!r}")
    # a block that holds many of the rows is written by as many tasks as it has strips of tiles
    _write(rows.repartition("block_x", "block_y", "tile_x"), path, kind, chunks, scope, tile_size)
    if vertices is not None:
        vertices.select("id", "label").write.parquet(f"{path}/labels")


def read_tiles(spark: SparkSession, path: str, block: tuple[int, int] | None = None) -> DataFrame:
    """The tile rows; ``block``: only that block's folder is opened."""
    rows = spark.read.parquet(f"{path}/tiles")
    return rows if block is None else rows.filter((F.col("block_x") == block[0]) & (F.col("block_y") == block[1]))


def read_tiled(spark: SparkSession, path: str, block: tuple[int, int] | None = None) -> DataFrame:
    """src, dst of the matrix, or of one block of it."""
    meta = spark.read.parquet(f"{path}/meta").first()
    rows = read_tiles(spark, path, block)
    if meta.kind == "csr":
        entries = rows.withColumn("y_in", F.explode("cols"))
    else:
        bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.getbit(F.col("bits"), b) == 1)
        entries = rows.withColumn("__b", F.explode(bits)).withColumn("y_in", F.col("word") * 32 + F.col("__b"))
    at = lambda block, tile, within: (F.col(block).cast("long") * meta.scope + F.col(tile) * meta.tile_size + F.col(within)).cast("long")
    return entries.select(at("block_x", "tile_x", "x_in").alias("src"), at("block_y", "tile_y", "y_in").alias("dst"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """id, label of a grid's vertices."""
    return spark.read.parquet(f"{path}/labels")


def stored_tile_stats(spark: SparkSession, path: str) -> DataFrame:
    """block_x, block_y, tile_x, tile_y, nnz of the tiles on disk."""
    meta = spark.read.parquet(f"{path}/meta").first()
    size = F.sum(F.size("cols") if meta.kind == "csr" else F.bit_count("bits")).cast("long")
    rows = read_tiles(spark, path).groupBy(*TILE).agg(size.alias("nnz"))
    return rows.select(*[F.col(c).cast("long").alias(c) for c in TILE], "nnz")

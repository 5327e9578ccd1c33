"""Grid blocks, tiles and hash cuts of an edge set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashes
from ..storage import new_path
from .products import pairs


def scope_of(edges: DataFrame, chunks: int) -> int:
    """Ids along one side of a block: ceil((greatest id + 1) / chunks)."""
    greatest = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return -(-((greatest if greatest is not None else 0) + 1) // chunks)


def grid(edges: DataFrame, chunks: int, scope: int | None = None) -> DataFrame:
    """Edges with block_x, block_y and block_id = block_x * chunks + block_y."""
    scope = scope or scope_of(edges, chunks)
    x, y = F.expr(f"src div {scope}"), F.expr(f"dst div {scope}")
    return edges.withColumns({"block_x": x, "block_y": y, "block_id": x * chunks + y})


def block_stats(blocks: DataFrame) -> DataFrame:
    """block_x, block_y, n_edges, n_vertices, min_vid, max_vid."""
    counts = blocks.groupBy("block_x", "block_y").agg(F.count("*").alias("n_edges"), F.min(F.least("src", "dst")).alias("min_vid"), F.max(F.greatest("src", "dst")).alias("max_vid"))
    vertices = blocks.select("block_x", "block_y", F.explode(F.array("src", "dst")).alias("id")).distinct().groupBy("block_x", "block_y").agg(F.count("*").alias("n_vertices"))
    return counts.join(vertices, ["block_x", "block_y"]).select("block_x", "block_y", "n_edges", "n_vertices", "min_vid", "max_vid")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """One folder a block; a reader that asks for a block opens only its folder. A block of many rows is written by many tasks."""
    blocks.repartition("block_x", "block_y", F.pmod(F.xxhash64("src", "dst"), F.lit(64))).write.partitionBy("block_x", "block_y").parquet(path)


def read_block(spark, path: str, x: int, y: int) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("block_x") == x) & (F.col("block_y") == y))


def width_of(scope: int, tile_size: int) -> int:
    """Ids along one side of a tile: a tile size under 128 counts strips."""
    return -(-scope // tile_size) if tile_size < 128 else tile_size


def tiles(blocks: DataFrame, scope: int, tile_size: int) -> DataFrame:
    """Blocks' edges with tile_x, tile_y inside the block and x_in, y_in inside the tile.

    A tile size under 128 counts strips: tiles are then ceil(scope / tile_size) wide.
    """
    size = width_of(scope, tile_size)
    return blocks.withColumns({n: F.expr(e) for n, e in (("tile_x", f"(src % {scope}) div {size}"), ("tile_y", f"(dst % {scope}) div {size}"), ("x_in", f"(src % {scope}) % {size}"), ("y_in", f"(dst % {scope}) % {size}"))})


def tile_stats(tiled: DataFrame) -> DataFrame:
    """block_id, tile_x, tile_y, tile_idx (place among the block's tiles that are not empty), nnz."""
    counts = tiled.groupBy("block_id", "tile_x", "tile_y").agg(F.count("*").alias("nnz"))
    return counts.withColumn("tile_idx", F.row_number().over(Window.partitionBy("block_id").orderBy("tile_x", "tile_y")).cast("long") - 1)


def bit_tiles(tiled: DataFrame) -> DataFrame:
    """block_id, tile_x, tile_y, x_in, word, bits: each row of a tile as 32-bit words held in longs."""
    bit = F.expr("shiftleft(1L, cast(y_in % 32 as int))")
    return tiled.groupBy("block_id", "tile_x", "tile_y", "x_in", F.expr("y_in div 32").alias("word")).agg(F.bit_or(bit).alias("bits"))


def bit_tile_count(packed: DataFrame) -> DataFrame:
    """nnz: all bits set."""
    return packed.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("nnz"))


def tile_layout_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """tile_i, tile_j: tiles of A and of B that are not empty in a common tile column."""
    a = left.select(F.col("tile_x").alias("i"), F.col("tile_y").alias("k")).distinct()
    b = right.select(F.col("tile_y").alias("k"), F.col("tile_x").alias("j")).distinct()
    return pairs(a, b, "tile_i", "tile_j")


def edge_cut(edges: DataFrame, parts: int, hashed: bool = True) -> DataFrame:
    """Edges with part, by a hash of the source (or the source itself): all out-edges of a vertex together."""
    return edges.withColumn("part", F.pmod(hashes.portable("src") if hashed else F.col("src"), F.lit(parts)))


def vertex_cut(edges: DataFrame, parts: int, hashed: bool = True) -> DataFrame:
    """Edges with part, by both ends: a vertex's edges may lie apart."""
    return edges.withColumn("part", F.pmod(hashes.portable("src", "dst") if hashed else F.col("src") * 31 + F.col("dst"), F.lit(parts)))


def part_sizes(edges: DataFrame) -> DataFrame:
    return edges.groupBy("part").agg(F.count("*").alias("n_edges"))


def stored_blocks(blocks: DataFrame) -> str:
    """Writes blocks to the shared folder; the path."""
    path = new_path(blocks.sparkSession, "blocks")
    write_blocks(blocks, path)
    return path

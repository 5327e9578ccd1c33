"""Boolean products of edge sets, row by row of the left one.

The left rows (i, k) are dealt and sorted by i. The right rows (k, j) of any k
that the left side has are written in blocks to the shared folder, and a worker
holds one block at a time: so two-paths are united where they are made, and
neither they nor the pairs are shuffled or written. Left rows travel once a
block of the right side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_modules
from ..storage import file_system, new_path, released, rows_total, stored_with

#: Right entries in a block, about; and two-paths that a worker has before it unites them.
HELD, MADE = 1 << 23, 1 << 21
#: Stands for an id that is null while rows are arrays.
NONE = -(1 << 63)
_HELD: dict[tuple[str, int], "_Block"] = {}

Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


class _Block:
    """A block of right rows as compressed rows; also as bits where one place in 32 or more is taken."""

    def __init__(self, path: str, block: int):
        import pyarrow.parquet as pq

        where, at = file_system(path)
        table = pq.read_table(f"{at}/block={block}", filesystem=where, columns=["k", "j"], partitioning=None)
        k, j = (table[c].to_numpy() for c in "kj")
        if np.any(k[1:] < k[:-1]):
            order = np.argsort(k, kind="stable")
            k, j = k[order], j[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        self.keys, self.starts = k[first], np.r_[first, len(k)]
        self.names, at = np.unique(j, return_inverse=True)
        self.columns = at.astype(np.int32)
        self.words = None
        if 32 * len(k) >= len(self.keys) * len(self.names):
            self.words = np.zeros((len(self.keys), -(-len(self.names) // 64)), np.uint64)
            rows = np.repeat(np.arange(len(self.keys)), np.diff(self.starts))
            np.bitwise_or.at(self.words, (rows, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))

    def found(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``k`` have a row here, and the numbers of those rows."""
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        has = self.keys[at] == k
        return has, at[has]

    def cost(self, rows: np.ndarray) -> np.ndarray:
        return np.diff(self.starts)[rows] if self.words is None else np.full(len(rows), len(self.names) // 8 + 1)

    def united(self, group: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """group * width + column, ascending and once each, for ascending groups of rows."""
        if self.words is None:
            sizes = self.starts[rows + 1] - self.starts[rows]
            before = np.cumsum(sizes) - sizes
            at = np.repeat(self.starts[rows] - before, sizes) + np.arange(sizes.sum())
            return np.unique(np.repeat(group * len(self.names), sizes) + self.columns[at])
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        bits = np.bitwise_or.reduceat(self.words[rows], heads, axis=0)
        row, column = np.nonzero(np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1, bitorder="little", count=len(self.names)))
        return row * len(self.names) + column


def _held(path: str, block: int) -> _Block:
    if (path, block) not in _HELD:
        while len(_HELD) > 1:  # two at most, so that blocks in turn are not read each time
            del _HELD[next(iter(_HELD))]
        _HELD[path, block] = _Block(path, block)
    return _HELD[path, block]


def _unions(path: str, batches, most: int) -> Iterator[Rows]:
    """(ids, sizes, js): for each i of rows (block, i, k), sorted so, the ascending union of the held rows of its k."""
    open_at, open_js = None, None  # the block and i that may go on, and its columns so far

    def closed() -> Rows:
        return np.array([open_at[1]]), np.array([len(open_js)]), _held(path, open_at[0]).names[open_js]

    for batch in batches:
        blocks, i, k = (c.to_numpy() for c in batch.columns)
        turns = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1
        for low, high in zip(np.r_[0, turns], np.r_[turns, len(blocks)]):
            if low == high:
                continue
            block = int(blocks[low])
            if open_at and open_at[0] != block:
                yield closed()
                open_at = None
            held = _held(path, block)
            has, rows = held.found(k[low:high])
            mine, width = i[low:high][has], len(held.names)
            part = np.cumsum(held.cost(rows)) // most
            cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(rows)]):
                if a == b:
                    continue
                fresh = np.r_[True, mine[a + 1 : b] != mine[a : b - 1]]
                ids = mine[a:b][fresh]
                codes = held.united(np.cumsum(fresh) - 1, rows[a:b])
                ends = np.searchsorted(codes, np.arange(1, len(ids) + 1) * width)
                if open_at and open_at[1] == ids[0]:
                    flags = np.zeros(width, bool)
                    flags[open_js] = flags[codes[: ends[0]]] = True
                    merged = np.flatnonzero(flags)
                    codes, ends = np.r_[merged, codes[ends[0] :]], ends + len(merged) - ends[0]
                elif open_at:
                    yield closed()
                last = ends[-2] if len(ids) > 1 else 0
                open_at, open_js = (block, int(ids[-1])), codes[last:] % width
                if len(ids) > 1:
                    yield ids[:-1], np.diff(np.r_[0, ends[:-1]]), held.names[codes[:last] % width]
    if open_at:
        yield closed()


def _others(found: Rows) -> Rows:
    """Without the pairs of an id with itself."""
    ids, sizes, js = found
    keep = np.repeat(ids, sizes) != js
    before = np.r_[0, np.cumsum(keep)]
    ends = np.cumsum(sizes)
    return ids, before[ends] - before[ends - sizes], js[keep]


def product(left: DataFrame, right: DataFrame, schema: str, made: Callable[[Rows], tuple], others: bool = False, deal: Column | None = None) -> DataFrame:
    """Rows of ``schema`` that ``made`` gives as columns for some i of left(i, k), their numbers of different j over right(k, j), and those j.

    ``others``: pairs of an id with itself are left out. An i comes once for each
    block that has a j of it; ``deal``: an expression over j by which j are dealt
    to blocks, those of equal values together.
    """
    spark = left.sparkSession
    needed, facts = stored_with(right.join(left.select("k").distinct(), "k", "left_semi").select("k", F.coalesce("j", F.lit(NONE)).alias("j")), "right", rows_total())
    blocks = max(1, -(-facts["n"] // HELD))
    block = F.pmod(F.xxhash64(F.col("j") if deal is None else deal), F.lit(blocks)).cast("int")
    path = new_path(spark, "product")
    needed.withColumn("block", block).repartition(blocks, "block").sortWithinPartitions("block", "k", "j").write.partitionBy("block").parquet(path)
    there = [r.block for r in spark.read.parquet(path).select("block").distinct().collect()] if facts["n"] else []
    released(needed)
    names = [c.split()[0] for c in schema.split(", ")]

    most = MADE

    def run(batches):
        for found in _unions(path, batches, most):
            found = _others(found) if others else found
            if len(found[2]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made(found)], names)

    ship_modules(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = left.filter("k is not null").select(F.explode(F.array(*[F.lit(b) for b in sorted(there)]).cast("array<int>")).alias("block"), F.coalesce("i", F.lit(NONE)).alias("i"), "k")
    return rows.repartition(parts, "block", "i").sortWithinPartitions("block", "i").mapInArrow(run, schema)


def every_pair(found: Rows) -> tuple[np.ndarray, np.ndarray]:
    ids, sizes, js = found
    return np.repeat(ids, sizes), js


def pairs(left: DataFrame, right: DataFrame, i: str, j: str, others: bool = False) -> DataFrame:
    """The different pairs i, j of the product under the given names."""
    found = product(left, right, f"{i} long, {j} long", every_pair, others)
    return found.select(*[F.nullif(F.col(c), F.lit(NONE)).alias(c) for c in (i, j)])

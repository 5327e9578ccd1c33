"""All pairs of each group, compared in blocks: no pair of rows is ever made.

A group's rows are dealt to blocks by a hash of their id; a task gets two blocks
(or one, against itself), so its rows are bounded whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that a table of who holds what has at a time.
COLUMNS = 8192


def dealt(rows: DataFrame, key: str, block: int) -> DataFrame:
    """key, i, j, upper and the other columns (id among them), a group's blocks i and j together and in order."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / block).alias("__blocks"))
    own = rows.join(sizes, key).withColumn("__own", F.pmod(F.xxhash64("id"), F.col("__blocks")))
    pairs = own.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    placed = pairs.withColumns({"i": F.greatest("__own", "__other"), "j": F.least("__own", "__other"), "upper": (F.col("__own") > F.col("__other")).cast("int")})
    placed = placed.drop("__own", "__other", "__blocks")
    return placed.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "upper")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[bool, pa.Table]]:
    """(whether it is one block against itself, rows) of each pair of blocks in a task's batches."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.column_stack([np.asarray(batch.column(c)) for c in (key, "i", "j")])
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
        for low, high in zip(cuts, cuts[1:]):
            mark = tuple(marks[low].tolist())
            if mark != now and held:
                yield now[1] == now[2], pa.Table.from_batches(held)
                held = []
            now = mark
            held.append(batch.slice(low, high - low))
    if held:
        yield now[1] == now[2], pa.Table.from_batches(held)


def shared_counts(sets: list[np.ndarray], top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How many values each of the sets ``top`` has in common with each of ``low``; a set has no value twice."""
    out = np.zeros((len(top), len(low)), np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    keep = times[code] > 1
    owner, code = owner[keep], number[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [first, first + COLUMNS])
        table = np.zeros((len(sets), min(COLUMNS, int(code[-1]) + 1 - first)), np.float32)
        table[owner[a:b], code[a:b] - first] = 1
        out += table[top] @ table[low].T
    return out


def compared(tasks: DataFrame, key: str, values: Callable[[pa.ChunkedArray], list[np.ndarray]], near: Callable, result: Callable, schema: str, columns: list[str]) -> DataFrame:
    """``result(ids, hits)`` of each pair of blocks, as batches with ``columns``.

    ``near(shared, n_top, n_low)`` says which pairs count; pairs of one component never do.
    """

    def run(batches):
        for same, rows in groups(batches, key):
            ids, component, n, upper = (rows.column(c).to_numpy() for c in ("id", "component", "n", "upper"))
            every = np.arange(len(ids))
            top, low = (every, every) if same else (every[upper == 1], every[upper == 0])
            if not len(top) or not len(low) or len(np.unique(component)) == 1:
                continue
            hits = near(shared_counts(values(rows.column("set")), top, low), n[top][:, None], n[low][None, :])
            hits &= component[top][:, None] != component[low][None, :]
            a, b = np.nonzero(hits)
            if len(a):
                yield pa.RecordBatch.from_arrays(result(ids[top[a]], ids[low[b]]), columns)

    return tasks.mapInArrow(run, schema)

"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets the concatenated signs of random projections;
vectors are sorted by them, equal keys in an order of the pass's own, and each is
compared with the ``window`` before it. Where more vectors than a window share the
first ``bits`` signs, they are compared in blocks, however many they are. So a pair
is met in each pass in which its first signs agree, whatever lies around it. By one
rule for every size the signs follow the number of vectors, and the passes the
signs, so that a link at the threshold is missed with a chance of at most ``MISS``.
Dense surroundings cost time with the square of a run.

Verified pairs of all passes are united to components. Inside a component every
pair is then compared in blocks, so the number of links does not depend on the
passes; only a whole group that no pass has tied to another can be missed.

Equal vectors are one class that counts for as many. All cosines are taken in
double precision between unit vectors. A vector that is null, has no component,
is zero, or holds a null or a non-finite component links with nothing, and so
does a row with a null id (component null, not kept); vectors of different
lengths are never linked. Rows that repeat count each for itself.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import blocks
from .common import column, stored
from .forest import Forest

#: Passes at least, and window; signs of a key; vectors of a block inside a component, and in a long run.
PASSES, WINDOW, BITS, BLOCK, RUN_BLOCK = 16, 128, 32, 1024, 4096
#: Classes that share the first signs where nothing is dense; the chance to miss a link at the threshold.
RUN, MISS = 64, 0.001


def effort(n: int, cosine: float, passes: int | None = None, window: int = WINDOW) -> tuple[int, int]:
    """(first signs that a run shares, passes) for ``n`` classes.

    A window and one have all their pairs in any pass, so there is nothing to divide;
    nor do signs tell vectors apart that are a right angle or more from each other.
    """
    bits = 0 if n <= window + 1 or cosine <= 0 else min(26, max(0, math.ceil(math.log2(n / RUN))))
    agree = (1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi) ** bits
    return bits, passes or max(PASSES, math.ceil(math.log(MISS) / math.log1p(-agree)) if 0 < agree < 1 else 0)


def _packed(x: np.ndarray) -> bytes:
    """A vector as bytes: single numbers if they are the same, else doubles; the first byte is their width."""
    short = x.astype("<f4")
    return b"\4" + short.tobytes() if (short == x).all() else b"\10" + x.astype("<f8").tobytes()


def _unpacked(data) -> np.ndarray:
    raw = memoryview(data)
    return np.frombuffer(raw, "<f4" if raw[0] == 4 else "<f8", offset=1).astype(np.float64)


def _units(data: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors, in double precision, of packed rows; all of one length."""
    rows = np.array([_unpacked(x.as_buffer()) for x in data])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dim, h1 and h2 (128 bits that equal vectors share; null for those that link with nothing), data."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = row.values
                x = None if values is None or doc_id is None or values.null_count else np.asarray(values, np.float64)
                largest = np.abs(x).max(initial=0) if x is not None else 0
                if not largest or not np.isfinite(largest):
                    out.append((doc_id, None, None, None, None))
                    continue
                x = x / largest + 0.0 if not 1e-100 < largest < 1e100 else x + 0.0  # squares neither vanish nor overflow
                digest = np.frombuffer(hashlib.blake2b(x.astype("<f8").tobytes(), digest_size=16).digest(), "<i8")
                out.append((doc_id, len(x), int(digest[0]), int(digest[1]), _packed(x)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], ["id", "dim", "h1", "h2", "data"])

    rows = vectors.select(column(vectors, id_col).cast("long").alias("id"), column(vectors, vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, dim long, h1 long, h2 long, data binary")


def keyed(classes: DataFrame, passes: int, data: bool = True) -> DataFrame:
    """A row for each pass: pass, dim, key (signs of the pass's projections), id and, if asked for, data."""
    columns = ["pass", "dim", "key", "id", *["data"] * data]

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([9, dim]).standard_normal((dim, passes * BITS))
                rows = batch.filter(pa.array(dims == dim))
                signs = (_units(rows.column("data")) @ planes[dim] > 0).reshape(-1, passes, BITS)
                keys = signs @ weights
                for p in range(passes):
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p)), rows.column("dim"), pa.array(keys[:, p]), rows.column("id"), *[rows.column("data")] * data], columns)

    return classes.select("id", "dim", "data").mapInArrow(run, "pass long, dim long, key long, id long" + ", data binary" * data)


def _window_links(units: np.ndarray, ids: np.ndarray, first: int, window: int, cosine: float):
    """Pairs of ids, one of them at ``first`` or later, at most ``window`` apart and as near as ``cosine``."""
    for at in range(first, len(ids), 256):
        low, high = max(0, at - window), min(at + 256, len(ids))
        near = units[at:high] @ units[low:high].T >= cosine
        gap = np.arange(at, high)[:, None] - np.arange(low, high)[None, :]
        i, j = np.nonzero(near & (gap > 0) & (gap <= window))
        yield from zip(ids[i + at].tolist(), ids[j + low].tolist())


def window_links(rows: DataFrame, window: int, cosine: float) -> DataFrame:
    """Links a, b within the windows of sorted ``rows``; where partitions meet, from their ends.

    The last rows of a partition meet as many of those that follow, in as many
    partitions as it takes, so partitions may be short or empty.
    """

    def run(batches):
        forest, held, part, head, place = Forest(), None, TaskContext.get().partitionId(), [], 0
        for batch in batches:
            kinds = np.asarray(batch.column("pass")) * (1 << 32) + np.asarray(batch.column("dim"))
            cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                own = batch.slice(low, high - low)
                units, ids = _units(own.column("data")), np.asarray(own.column("id"))
                first = 0
                if held and held[0] == kinds[low]:
                    first = len(held[2])
                    units, ids = np.vstack([held[1], units]), np.concatenate([held[2], ids])
                found = forest.joining(_window_links(units, ids, first, window, cosine))
                if found:
                    yield ends_of("link", 0, np.array([a for a, _ in found]), np.array([b for _, b in found]), [None] * len(found))
                held = (int(kinds[low]), units[-window:], ids[-window:])
            if place < window:
                n = min(window - place, batch.num_rows)
                head.append(ends_of("head", part, np.arange(place, place + n), np.asarray(batch.column("id"))[:n], batch.column("data").slice(0, n).to_pylist(), kinds[:n]))
            place += batch.num_rows
        yield from head
        if held:
            # the same unit vectors as data: their cosines are the same
            yield ends_of("tail", part, np.arange(len(held[2])) - len(held[2]), held[2], [b"\10" + x.astype("<f8").tobytes() for x in held[1]], np.full(len(held[2]), held[0]))

    def ends_of(what, part, a, b, data, kinds=None):
        n = len(b)
        return pa.RecordBatch.from_arrays([pa.array([what] * n, pa.string()), pa.array(np.full(n, part, np.int64)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.zeros(n, np.int64) if kinds is None else kinds.astype(np.int64)), pa.array(data, pa.binary())], ["what", "part", "a", "b", "kind", "data"])

    def meet(batches):
        forest, now, ids, kinds, data = Forest(), None, [], [], []

        def links():
            for kind in set(kinds):
                pick = [i for i, x in enumerate(kinds) if x == kind]
                if len(pick) > 1:
                    yield from forest.joining(_window_links(_units(pa.array([data[i] for i in pick], pa.binary())), np.array([ids[i] for i in pick]), 1, window, cosine))

        def out():
            found = list(links())
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for part, b, kind, vector in zip(*(batch.column(c).to_pylist() for c in ("part", "b", "kind", "data"))):
                if part != now:
                    if ids:
                        yield out()
                    now, ids, kinds, data = part, [], [], []
                ids.append(b)
                kinds.append(kind)
                data.append(vector)
        if ids:
            yield out()

    seen = stored(rows.mapInArrow(run, "what string, part long, a long, b long, kind long, data binary"), "windows")
    sizes = {r.part: r["count"] for r in seen.filter("what = 'head'").groupBy("part").count().collect()}
    parts, meets = sorted(sizes), []
    for i, part in enumerate(parts):
        before = 0  # rows between the partition whose tail is met and this one
        for earlier in reversed(parts[:i]):
            if before >= window:
                break
            meets.append((part, earlier, before))
            before += sizes[earlier]
    spark = rows.sparkSession
    meets = F.broadcast(spark.createDataFrame(meets, "part long, with long, before long"))  # a few rows a partition
    heads = seen.filter("what = 'head'").join(meets, "part").select(F.col("with").alias("part"), (F.col("a") + F.col("before")).alias("a"), "b", "kind", "data")
    ends = seen.filter("what = 'tail'").select("part", "a", "b", "kind", "data").unionByName(heads).repartition("part").sortWithinPartitions("part", "a")
    return seen.filter("what = 'link'").select("a", "b").union(ends.mapInArrow(meet, "a long, b long"))


def run_links(reps: DataFrame, parts: DataFrame, passes: int, bits: int, window: int, cosine: float) -> DataFrame | None:
    """Links a, b between components of a run longer than a window, from all its pairs, block by block; None without such runs."""
    spread = passes if bits else 1
    run = (F.col("dim") * spread + F.col("pass")) * (1 << bits) + F.shiftright("key", BITS - bits)
    keys = keyed(reps, spread, data=False).select(run.alias("run"), "id")
    long_ = keys.groupBy("run").agg(F.count("*").alias("n")).filter(F.col("n") > window + 1).select("run")
    placed = keys.join(long_, "run").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = stored(placed, "runs")
    # runs that are one component need no more
    open_ = placed.groupBy("run").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("run")
    rest = placed.join(open_, "run")
    if rest.isEmpty():
        return None
    tasks = blocks.dealt(rest.join(reps.select("id", "data"), "id"), "run", RUN_BLOCK)

    def compare(batches):
        for same, rows in blocks.groups(batches, "run"):
            component, upper = rows.column("component").to_numpy(), rows.column("upper").to_numpy()
            every = np.arange(len(upper))
            top, low = (every, every) if same else (every[upper == 1], every[upper == 0])
            if not len(top) or not len(low) or len(np.unique(component)) == 1:
                continue
            units, forest, found = _units(rows.column("data")), Forest(), []
            others, owners = units[low].T, component[low]
            for at in range(0, len(top), 512):
                own = top[at : at + 512]
                a, b = np.nonzero((units[own] @ others >= cosine) & (component[own][:, None] != owners))
                found += forest.joining(np.unique(np.column_stack([component[own][a], owners[b]]), axis=0).tolist())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return tasks.mapInArrow(compare, "a long, b long")


def link_counts(members: DataFrame, cosine: float) -> DataFrame:
    """id, links: over all pairs of a component, block by block. ``members``: component, id, m, data."""
    tasks = blocks.dealt(members, "component", BLOCK)

    def run(batches):
        for same, rows in blocks.groups(batches, "component"):
            units, ids, m, upper = _units(rows.column("data")), *(rows.column(c).to_numpy() for c in ("id", "m", "upper"))
            if same:
                near = units @ units.T >= cosine
                np.fill_diagonal(near, False)
                links = near @ m
            else:
                top, low = upper == 1, upper == 0
                near = units[top] @ units[low].T >= cosine
                ids, links = np.concatenate([ids[top], ids[low]]), np.concatenate([near @ m[low], near.T @ m[top]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64())], ["id", "links"])

    return tasks.mapInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.95, passes: int | None = None, window: int = WINDOW, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id (least id reachable by links), kept (it is the least) for each row."""
    every = stored(packed(vectors, id_col, vector_col), "vectors")
    sound = every.filter("h1 is not null")
    classes = sound.groupBy("h1", "h2", "dim").agg(F.min("id").alias("id"), F.count("*").alias("m"))
    reps = stored(sound.select("id", "h1", "h2", "dim", "data").join(classes, ["id", "h1", "h2", "dim"]).dropDuplicates(["id", "h1", "h2"]), "classes")
    n = reps.count()
    bits, passes = effort(n, cosine, passes, window)
    # where partitions meet rows are compared again, so none should be much shorter than a few windows
    pieces = max(1, min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * passes // (4 * window)))
    order = ["pass", "dim", "key", "tie"]
    ordered = keyed(reps, passes).withColumn("tie", F.xxhash64("id", "pass")).repartitionByRange(pieces, *order).sortWithinPartitions(*order).drop("tie")
    links = stored(window_links(ordered, window, cosine).distinct(), "links")
    parts = stored(connected_components(links, "a", "b"), "components")
    more = run_links(reps, parts, passes, bits, window, cosine)
    if more is not None:
        links = stored(links.union(more).distinct(), "links")
        parts = stored(connected_components(links, "a", "b"), "components")
    counts = link_counts(reps.join(parts, "id").select("component", "id", "m", "data"), cosine)
    whole = reps.select("id", "h1", "h2", "dim", "m").join(parts, "id", "left").join(counts, "id", "left")
    facts = whole.select("h1", "h2", "dim", F.coalesce("component", "id").alias("component"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = every.select("id", "h1", "h2", "dim").join(facts, ["h1", "h2", "dim"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))

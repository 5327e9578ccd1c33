"""Near duplicates by bottom-k sketches of word shingles.

One hash function orders all shingles; a document's sketch is its ``SKETCH``
least. Two sets of similarity 0.8 have four shared elements for each that is not,
so along the order of their union three shared ones follow each other (always,
where a set fits its sketch, but for sets of four and five, whose pairs of values
are listed too; else with a chance of a miss under one in a million over
``RUNS`` places). Inverted lists are therefore kept for runs of three retained
values: a value that many documents hold is split by the values that follow it,
and common word pairs or passages make no long lists. The sketch of the union
estimates a candidate pair's similarity; what may reach the threshold is verified
on the full sets.

Documents with equal sets are one class and stand for each other. In each list
every class is first held against the least one, and verified links make
components. Lists with the same least class are one group; where a group is still
more than one component, all its pairs between components are compared in blocks,
by sketches and then by the full sets. No list is cut short and no pair of a
group is written out unless it is a link.

Below 80 per cent sets are sure of shorter runs only: lists are kept for pairs of
values from 70 per cent on, and for single values below. With a full sketch of 64
the chance that two sets share no value at all is (1 - similarity) ** 64, so under
20 per cent links begin to be missed. Lists grow as the threshold falls.

Defined results: a null text, or one without words, has an empty set, is linked
with nothing and keeps its own id; a text of fewer words than the width is one
shingle; rows with equal ids are one document for links; a row with a null id is
its own class (component null, not kept) unless its set equals another's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import HOT_KEYS
from . import blocks
from .common import column, sliced, stored, stored_with
from .forest import Forest
from .order_minhash import mixed
from .shingles import shingle_set

SKETCH, RUNS = 64, 40
#: Classes of a block, where all pairs of a group are compared.
BLOCK = 512
#: Copies of a class that are joined without a shuffle, more than that and than one of ``HOT_KEYS`` parts of all rows.
HOT_ROWS = 1000
#: Documents whose sets are needed, and of which a bitmap of eight bits each (16 MB at most) goes to the tasks.
FILTER_IDS = 1 << 24


def slack(percent: int) -> float:
    """How far below the similarity an estimate from a full sketch may be: six deviations."""
    share = percent / 100
    return 6 * (share * (1 - share) / SKETCH) ** 0.5


def run_length(percent: int) -> int:
    """Values of a run: as many as sets of this similarity are sure to share in a row.

    With s shared values for each m that are not, some run has s / (m + 1) or more.
    """
    return 3 if percent >= 80 else 2 if percent >= 70 else 1


def sketches(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (size of the set), c1 and c2 (128 bits that equal sets share) and sketch of each row."""

    def run(batches):
        for batch in sliced(batches):
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            marks = np.array([[mixed(s).sum(), mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum()] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "n", "c1", "c2", "sketch"])

    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, c1 long, c2 long, sketch array<long>")


def inverted_lists(reps: DataFrame, percent: int = 80) -> DataFrame:
    """value, id, least: which classes retain a run, and the least of them; runs of one class alone are left out."""
    length = run_length(percent)
    run = lambda i, n: F.xxhash64(*[F.get("sketch", i + j) for j in range(n)])
    last = F.least(F.size("sketch") - length, F.when(F.col("n") > SKETCH, F.lit(RUNS - 1 if length == 3 else SKETCH)).otherwise(F.lit(SKETCH)))
    keys = F.transform(F.sequence(F.lit(0), last), lambda i: run(i, length))
    if length == 3:  # sets of four and five, of which one value differs, are sure of two in a row only
        twos = F.transform(F.sequence(F.lit(0), F.size("sketch") - 2), lambda i: run(i, 2))
        keys = F.when(F.col("n").isin(4, 5), F.concat(keys, twos)).otherwise(keys)
    # sets too small to have a run and differ at this similarity are similar only if equal, and then they are one class
    rows = reps.filter(F.col("n") >= (4 if length == 3 else length)).select("id", F.explode(keys).alias("value"))
    least = rows.groupBy("value").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    return rows.join(least.select("value", "least"), "value").select("value", "id", "least")


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose union sketch does not rule the threshold out."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").filter("na is not null").join(side("b"), "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches):
        for batch in batches:
            sa, sb = batch.column("sa"), batch.column("sb")
            keep = []
            for i in range(batch.num_rows):
                a, b = (np.asarray(s[i].values).view(np.uint64) for s in (sa, sb))
                union = np.union1d(a, b)
                if len(a) == SKETCH or len(b) == SKETCH:
                    union, below = union[:SKETCH], slack(percent)
                else:
                    below = 0.0
                shared = np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)
                keep.append(shared.sum() >= (percent / 100 - below) * len(union) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _sets_of(docs: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, set (its hashes as bytes) of the documents in ``ids``; texts are not shuffled.

    Up to ``FILTER_IDS`` of them a bitmap of the hashed ids goes to every task, and
    the few others it lets through do no harm; of more, the texts are joined.
    """
    of = lambda own, texts: pa.RecordBatch.from_arrays([own, pa.array([shingle_set(t, width).tobytes() for t in texts.to_pylist()], pa.binary())], ["id", "set"])
    n = ids.count()
    rows = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).cast("string").alias("text")).filter("id is not null")
    if n > FILTER_IDS:
        return rows.join(ids, "id", "left_semi").mapInArrow(lambda batches: (of(part.column(0), part.column(1)) for part in sliced(batches)), "id long, set binary")
    bits = max(16, (8 * n).bit_length())
    place = F.xxhash64("id").bitwiseAND((1 << bits) - 1)
    words = ids.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast((xxhash64(id) & {(1 << bits) - 1}) & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    found = words.toArrow()  # in one job; two numbers for each 64 bits at most
    bitmap[found["w"].to_numpy()] = found["bits"].to_numpy()

    def run(batches):
        for batch in batches:
            at = np.asarray(batch.column(1))
            hit = batch.take(pa.array(np.flatnonzero(bitmap[at >> 6] >> (at & 63) & 1)))
            for part in sliced([hit], 2):
                yield of(part.column(0), part.column(2))

    return rows.select("id", place.alias("place"), "text").mapInArrow(run, "id long, set binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on the full sets."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def joining(a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    """Of a block's links those that tie together what the others have not."""
    kept = Forest().joining(zip(a.tolist(), b.tolist()))
    return [pa.array([x for x, _ in kept], pa.int64()), pa.array([y for _, y in kept], pa.int64())]


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links), kept (it is the least) for each row."""
    if not 0 < percent <= 100:
        raise ValueError("a similarity is a share of 100")
    every = stored(sketches(docs, width, id_col, text_col), "sketches")
    classes, sums = stored_with(every.filter("n > 0").groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "class-ids", F.sum("copies").alias("rows"))
    found = every.filter("n > 0 and doc_id is not null").select(F.col("doc_id").alias("id"), "c1", "c2", "n", "sketch")
    reps = stored(found.join(classes, ["id", "c1", "c2", "n"], "left_semi").dropDuplicates(["id", "c1", "c2"]).select("id", "n", "sketch"), "classes")
    lists = stored(inverted_lists(reps, percent), "lists")

    def sets_of(ids: DataFrame) -> DataFrame:
        return _sets_of(docs, ids, width, id_col, text_col).join(ids, "id", "left_semi").dropDuplicates(["id", "set"])

    def rest_links(rest: DataFrame) -> DataFrame:
        """Links between components of a group: by sketches first, then on the full sets of what they leave."""
        sketched = rest.join(reps.select("id", "n", F.col("sketch").alias("set")), "id")
        each = lambda c: [np.asarray(x.values).view(np.uint64) for x in c]
        chance = lambda shared, n, m: (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (shared >= (percent / 100 - slack(percent)) * np.minimum(SKETCH, np.minimum(n, m)))
        both = lambda a, b: [pa.array(np.unique(np.concatenate([a, b])))]
        left = blocks.compared(blocks.dealt(sketched, "leader", BLOCK), "leader", each, chance, both, "id long", ["id"]).distinct()
        left = stored(left, "rest-ids")
        exact = rest.join(left, "id", "left_semi").join(sets_of(left), "id").withColumn("n", (F.length("set") / 8).cast("long"))
        whole = lambda c: [np.frombuffer(x.as_buffer(), np.uint64) for x in c]
        sure = lambda shared, n, m: 100 * shared >= percent * (n + m - shared)
        return blocks.compared(blocks.dealt(exact, "leader", BLOCK), "leader", whole, sure, joining, "a long, b long", ["a", "b"])

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        """Links among the candidate pairs; texts are read again only where an estimate asks for it."""
        chances = stored(likely(pairs, reps, percent), name)
        ids = stored(chances.select(F.explode(F.array("a", "b")).alias("id")).distinct(), name + "-ids")
        return stored(verified(chances, stored(sets_of(ids), name + "-sets"), percent), name + "-links")

    links = checked(lists.filter("least < id").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), "star")
    parts = stored(connected_components(links, "a", "b"), "components")
    # a list's classes all lie in the group of its least; groups that are one component need no more
    placed = lists.select(F.col("least").alias("leader"), "id").distinct().join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = placed.groupBy("leader").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("leader")
    rest = stored(placed.join(open_, "leader"), "rest")
    if not rest.isEmpty():
        links = stored(links.unionByName(rest_links(rest)), "links")
        parts = connected_components(links, "a", "b")
    whole = classes.join(parts, "id", "left").select("c1", "c2", "n", "copies", F.coalesce("component", "id").alias("component"))
    own, key = every.select("doc_id", "n", "c1", "c2"), ["c1", "c2", "n"]
    # the rows of a class of very many copies stay where they are: at most HOT_KEYS classes can be as large
    large = F.col("copies") > max(HOT_ROWS, (sums["rows"] or 0) // HOT_KEYS)
    hot, worded = F.broadcast(whole.filter(large).drop("copies")), own.filter("n > 0")
    cold = worded.join(hot, key, "left_anti").join(whole.filter(~large).drop("copies"), key)
    out = worded.join(hot, key).select("doc_id", "n", "component").union(cold.select("doc_id", "n", "component")).union(own.filter("n = 0").select("doc_id", "n", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(False)).alias("kept"))


def one_row_an_id(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of the rows that share an id one stays, the least by text; null ids all stay.

    Ids that repeat are found on their own; only their rows are compared.
    """
    repeated = stored(docs.filter(column(docs, id_col).isNotNull()).groupBy(column(docs, id_col).alias("__id")).agg(F.count("*").alias("__n")).filter("__n > 1"), "repeated").select("__id")
    alone = docs.join(repeated, column(docs, id_col) == repeated["__id"], "left_anti")
    shared = docs.join(repeated, column(docs, id_col) == repeated["__id"], "left_semi")
    least = shared.groupBy(column(shared, id_col).alias("__id")).agg(F.min_by(F.struct(*[column(shared, c) for c in shared.columns]), F.coalesce("text", F.lit(""))).alias("__row"))
    return alone.unionByName(least.select("__row.*"))

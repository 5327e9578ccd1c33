"""Mixing sources to target weights as a minimum-cost flow.

Documents may belong to several sources. They are summed up by membership
pattern; a pattern can give its words once for free and again, up to ``repeats``
times in all, at a rising price; sources take words from the patterns that
contain them up to their quotas. The flow of least cost among the greatest says
how many words each pattern gives. A pattern's documents are then all taken as
often as that fills, and once more in seeded order for what remains; the document past the cut whose size comes
nearest to the gap there fills it (its repeated rows with it).

Size is the number of words ``[^\\x20\\x09-\\x0D]+`` (null text: 0). A null source
is a source of its own; null in a pattern likewise; a row with no source at all
is never taken. Documents of size 0 are taken 0 times. Rows that repeat count
each for itself; the seed, the id and the text decide the order, so reruns agree.

Only sums by pattern reach the driver, one row each; documents never do. Patterns
of several sources are solved there together, in any number, in about half a
kilobyte of the driver each; a source that stands alone in its pattern gives what
its quota asks for, without a network. Where a pattern's cut lies is found by three rounds
of sums over 256 ranges of the seeded hash, so a pattern may hold any share of
the rows.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, stored

#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
LEVELS, BITS = 3, 8
#: Patterns that are broadcast at most.
MAX_PATTERNS = 10_000


def sized(docs: DataFrame, sources: Column, seed: int, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Every row's id, sources (sorted), size and seeded hash; with ``keep`` all columns of the row beside."""
    size = F.coalesce(F.regexp_count(column(docs, text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    own = [F.struct(*[column(docs, c) for c in docs.columns]).alias("row")] * keep
    # the text is hashed too, so that rows without an id, or of one id, do not all fall in one place
    place = F.xxhash64(column(docs, id_col).cast("long"), column(docs, text_col).cast("string"), F.lit(seed))
    return docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.array_sort(F.array_distinct(sources)).alias("sources"), size.alias("size"), *own, place.alias("place"))


def shares(sizes: dict, weights: dict, repeats: int = 3) -> dict:
    """Targets: all words by weight, none above ``repeats`` times its source's size; what is over is shared again."""
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        if not total:
            return out | dict.fromkeys(open_, 0.0)
        over = {s for s in open_ if left * weights[s] / total > repeats * sizes[s]}
        if not over:
            return out | {s: left * weights[s] / total for s in open_}
        for s in over:
            out[s] = float(repeats * sizes[s])
        left = max(0.0, left - sum(out[s] for s in over))
        open_ -= over
    return out


def least_cost_flow(patterns: dict[tuple, int], quotas: dict, repeats: int = 3) -> dict[tuple, int]:
    """Words that each pattern gives, in the cheapest of the greatest flows.

    Arcs: start -> pattern (one a repetition, at costs 0, 1, 3, 6, ...) -> source
    -> end. A path that adds to the flow leaves the start once and all further
    arcs are free, so it costs what its repetition costs: the least-cost flow is
    the greatest flow over first repetitions, then what second ones can add, and
    so on. Each is found by blocking flows along shortest paths.
    """
    names = [*patterns, *quotas]
    source = {s: i + 2 + len(patterns) for i, s in enumerate(quotas)}
    leaving: list[list[int]] = [[] for _ in range(len(names) + 2)]
    to, left = [], []  # an arc and its way back are neighbours

    def arc(a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            leaving[x].append(len(to))
            to.append(y)
            left.append(c)
        return len(to) - 2

    for i, (p, words) in enumerate(patterns.items()):
        for s in p:
            if s in source:
                arc(i + 2, source[s], repeats * words)
    for s, quota in quotas.items():
        arc(source[s], 1, quota)
    given = [[] for _ in patterns]
    for _ in range(repeats):
        for i, words in enumerate(patterns.values()):
            given[i].append(arc(0, i + 2, words))
        while True:
            depth, queue = {0: 0}, deque([0])
            while queue:
                a = queue.popleft()
                for k in leaving[a]:
                    if left[k] and to[k] not in depth:
                        depth[to[k]] = depth[a] + 1
                        queue.append(to[k])
            if 1 not in depth:
                break
            tried, path, at = [0] * len(leaving), [], 0
            while True:
                if at == 1:
                    amount = min(left[k] for k in path)
                    for k in path:
                        left[k] -= amount
                        left[k ^ 1] += amount
                    cut = next(i for i, k in enumerate(path) if not left[k])
                    at = to[path[cut] ^ 1]
                    del path[cut:]
                while tried[at] < len(leaving[at]):
                    k = leaving[at][tried[at]]
                    if left[k] and depth.get(to[k]) == depth[at] + 1:
                        break
                    tried[at] += 1
                if tried[at] < len(leaving[at]):
                    path.append(k)
                    at = to[k]
                elif path:
                    k = path.pop()
                    at = to[k ^ 1]
                    tried[at] += 1
                else:
                    break
    return {p: sum(left[k ^ 1] for k in ks) for p, ks in zip(patterns, given)}


def given_words(patterns: dict[tuple, int], quotas: dict, repeats: int = 3) -> dict[tuple, int]:
    """``least_cost_flow``, but sources that are in no pattern with others are settled without it."""
    shared = {s for p in patterns if len(p) > 1 for s in p}
    bound = {p: n for p, n in patterns.items() if len(p) > 1 or p and p[0] in shared}
    alone = {p: min(quotas[p[0]], repeats * n) if p else 0 for p, n in patterns.items() if p not in bound}
    return alone | (least_cost_flow(bound, {s: q for s, q in quotas.items() if s in shared}, repeats) if bound else {})


def pattern_sizes(rows: DataFrame) -> dict[tuple, int]:
    sizes = stored(rows.groupBy("sources").agg(F.sum("size").alias("size")), "patterns")
    return {tuple(r["sources"] or ()): r["size"] for r in sizes.collect()}


def small(patterns: DataFrame, n: int) -> DataFrame:
    """A table of ``n`` patterns: broadcast up to ``MAX_PATTERNS``, else joined as any other."""
    return F.broadcast(patterns) if n <= MAX_PATTERNS else patterns


def take(rows: DataFrame, words: dict[tuple, int], patterns: dict[tuple, int]) -> DataFrame:
    """``rows`` with ``times``, how often each is taken, so that patterns give ``words``."""
    spark = rows.sparkSession
    plan = [(list(p), *(divmod(words[p], patterns[p]) if patterns[p] else (0, 0))) for p in patterns]
    plan = spark.createDataFrame(plan, "p array<string>, whole long, rest long")
    rows = rows.join(small(plan, len(patterns)), rows["sources"] == plan["p"]).drop("p")
    rows = rows.withColumns({f"d{i}": F.shiftrightunsigned("place", 64 - BITS * (i + 1)).bitwiseAND((1 << BITS) - 1) for i in range(LEVELS)})
    # the range in which each pattern's cut lies, level by level: one row a pattern
    cut = plan.select(F.col("p").alias("sources"), F.col("rest").alias("left"))
    for i in range(LEVELS):
        inside = rows.join(small(cut, len(patterns)), ["sources", *[f"d{j}" for j in range(i)]]) if i else rows.withColumn("left", F.col("rest"))
        sums = inside.groupBy("sources", "left", *[f"d{j}" for j in range(i + 1)]).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("sources").orderBy(f"d{i}")
        sums = sums.withColumn("before", F.sum("n").over(run) - F.col("n")).filter("before <= left and left < before + n")
        found = sums.select("sources", *[f"d{j}" for j in range(i + 1)], (F.col("left") - F.col("before")).alias("left"))
        cut = spark.createDataFrame(found.collect(), found.schema)
    digits = [f"d{j}" for j in range(LEVELS)]
    marks = cut.select(F.col("sources").alias("p"), *[F.col(d).alias(f"c{d}") for d in digits], F.col("left").alias("left"))
    marked = rows.join(small(marks, len(patterns)), rows["sources"] == marks["p"], "left").drop("p")
    position, limit = F.struct(*digits), F.struct(*[F.col(f"c{d}").alias(d) for d in digits])
    clear = marked.filter(F.col("left").isNull() | (position != limit)).withColumn("times", F.col("whole") + F.coalesce((position < limit).cast("int"), F.lit(0)))
    order = Window.partitionBy("sources").orderBy("place", "doc_id", "size")
    near = marked.filter(position == limit).withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    near = near.withColumn("times", F.col("whole") + (F.col("before") + F.col("size") <= F.col("left")).cast("int"))
    keep = [c for c in rows.columns if c not in digits]
    picked = clear.select(*keep, "times").unionByName(near.select(*keep, "times"))
    # the cut leaves a gap: of the documents past it, the one whose size comes nearest fills it
    gaps = picked.groupBy("sources").agg((F.max("rest") - F.sum(F.col("size") * (F.col("times") - F.col("whole")))).alias("gap")).filter("gap > 0")
    gaps = spark.createDataFrame(gaps.collect(), gaps.schema)
    off = F.abs(F.col("size") - F.col("gap"))
    past = picked.filter("times = whole").join(small(gaps, len(patterns)), "sources").filter(off < F.col("gap"))
    filling = past.groupBy(F.col("sources").alias("p")).agg(F.min_by(F.struct("place", "doc_id", "size"), F.struct(off, "place", "doc_id")).alias("fill"))
    filling = spark.createDataFrame(filling.collect(), filling.schema)
    chosen = picked["sources"].eqNullSafe(filling["p"]) & F.struct("place", "doc_id", "size").eqNullSafe(F.col("fill")) & (F.col("times") == F.col("whole"))
    out = picked.join(small(filling, len(patterns)), picked["sources"] == filling["p"], "left").withColumn("times", F.col("times") + F.coalesce(chosen, F.lit(False)).cast("int"))
    return out.drop("p", "fill", "whole", "rest")


def numbered_weights(sources) -> dict:
    """Weights 1, 2, 3, repeating, along the sources by code point, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: 1 + i % 3 for i, s in enumerate(ordered)}


def mix(docs: DataFrame, sources: Column, weights=numbered_weights, seed: int = 6, repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> tuple[DataFrame, dict, dict]:
    """(rows with ``times``, sizes of the sources, their targets).

    ``sources``: an array column of each row's sources. ``weights``: from the
    sources to a dict. With ``keep`` the row's own columns come along as a struct
    ``row``.
    """
    rows = stored(sized(docs, sources, seed, id_col, text_col, keep), "sized")
    patterns = pattern_sizes(rows)
    sizes: dict = {}
    for p, words in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + words
    targets = shares(sizes, weights(sizes), repeats)
    words = given_words(patterns, {s: round(t) for s, t in targets.items()}, repeats)
    return take(rows, words, patterns), sizes, targets

"""Connected components by alternating stars, in about log2(longest path) rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import released, rows_total, stored_with
from .skew import HOT_KEYS, SHARE


def _hot(now: DataFrame, end: str, n: int) -> DataFrame | None:
    """Nodes with very many edges at this end, at most ``HOT_KEYS``; None if none can be."""
    if n <= SHARE:
        return None
    limit = max(SHARE, n // HOT_KEYS)
    found = now.groupBy(end).count().filter(F.col("count") > limit).select(F.col(end).alias("u")).collect()
    return now.sparkSession.createDataFrame(found, "u long") if found else None


def _tied(edges: DataFrame, least: DataFrame, hot: DataFrame | None) -> DataFrame:
    """v and the least node m of u for each edge (u, v); nodes in ``hot`` get theirs without a shuffle of their edges."""
    if hot is None:
        return edges.join(least, "u").select("v", "m")
    few = F.broadcast(least.join(F.broadcast(hot), "u", "left_semi"))
    return edges.join(F.broadcast(hot), "u", "left_anti").join(least, "u").select("v", "m").union(edges.join(few, "u").select("v", "m"))


def _stars(edges: DataFrame, large: bool, hot: DataFrame | None) -> DataFrame:
    """One round over edges (u, v) with u > v.

    Large: every node ties its greater neighbours to the least node it knows.
    Small: every node ties its lesser neighbours, and itself, to the least of them.
    """
    if large:
        down = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = edges.union(down).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # a node whose least neighbour is below it keeps that tie itself
        tied = _tied(down, least, hot).union(least.filter("m < u").select("u", "m"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = _tied(edges, least, hot).union(least.select("u", "m"))
    return tied.toDF("u", "v").filter("u > v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """id, component (the least id of its weakly connected component) of every endpoint.

    Rows with a null end are left out; self-loops make a component of one. Each
    round is written to the shared folder and the one before deleted; the driver
    sees a few sums a round. Raises if ``max_rounds`` do not suffice.
    """
    pairs = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).filter("a is not null and b is not null")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    facts = (rows_total(), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    now, state = stored_with(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars", *facts)
    for _ in range(max_rounds):
        # what has many edges at its upper end can only lose some before the second half of the round
        lower, upper = (_hot(now, end, state["n"]) for end in ("v", "u"))
        after, found = stored_with(_stars(_stars(now, True, lower), False, upper), "stars", *facts)
        released(now)
        now = after
        if found == state:
            return ends.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        state = found
    raise RuntimeError("components did not settle")

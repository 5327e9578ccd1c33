"""Reports for people: the first rows of an order, and short texts about graphs and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows: each partition passes on ``n`` at most. The limit is the feature."""
    return df.orderBy(*order).limit(n)


def text_of(df: DataFrame, n: int = 20) -> str:
    """The first ``n`` rows as lines of values, under a line of names."""
    rows = [" ".join(df.columns), *(" ".join(map(str, r)) for r in df.limit(n).collect())]
    return "\n".join(rows)


def graph_report(vertices: DataFrame, edges: DataFrame, n: int = 20) -> DataFrame:
    """id, label, in_degree, out_degree of the ``n`` vertices of greatest degree."""
    from .operators.structure import degrees

    rows = vertices.join(degrees(edges), "id", "left").na.fill(0, ["in_degree", "out_degree"])
    return top(rows.select("id", "label", "in_degree", "out_degree"), n, F.desc(F.col("in_degree") + F.col("out_degree")), F.asc("id"))


def match_report(groups: DataFrame, n: int = 20) -> DataFrame:
    """pivot, pos, cnt, least of the ``n`` greatest groups of ``matching.association_groups``."""
    counts = groups.groupBy("pivot", "pos").agg(F.count("*").alias("cnt"), F.min("matched_id").alias("least"))
    return top(counts, n, F.desc("cnt"), F.asc("pivot"), F.asc("pos"))

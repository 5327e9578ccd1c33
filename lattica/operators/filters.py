"""Candidate filters: which data vertices may stand for which pattern vertex.

Each takes and returns candidates(u, v), u a pattern vertex and v a data vertex,
over vertices(id, label) and edges(src, dst, src_label, dst_label). All are
necessary conditions of an injective match, so they only prune.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashes
from ..plans.pattern import Pattern
from ..storage import dealt, rows_total, stored_with
from .structure import degrees

#: How many least hashes the k-min-wise sketch keeps.
KEPT = 7


def by_label(vertices: DataFrame, pattern: Pattern) -> DataFrame:
    """v's label is u's; an unlabelled u takes all."""
    spark = vertices.sparkSession
    wanted = spark.createDataFrame([(u, label) for u, label in enumerate(pattern.labels)], "u long, want long")
    return vertices.join(F.broadcast(wanted), F.col("want").isNull() | (F.col("want") == F.col("label"))).select("u", F.col("id").alias("v")) if None in pattern.labels else vertices.join(F.broadcast(wanted), F.col("want") == F.col("label")).select("u", F.col("id").alias("v"))


def _pattern_table(spark, pattern: Pattern, columns: str, row) -> DataFrame:
    return F.broadcast(spark.createDataFrame([row(u) for u in range(len(pattern.labels))], columns))


def by_degree(candidates: DataFrame, edges: DataFrame, pattern: Pattern, into: bool = True) -> DataFrame:
    """v has at least u's out-degree and, with ``into``, its in-degree."""
    wanted = _pattern_table(edges.sparkSession, pattern, "u long, need_in long, need_out long", lambda u: (u, *pattern.degree(u)))
    have = degrees(edges.select("src", "dst").distinct()).withColumnRenamed("id", "v")
    rows = candidates.join(wanted, "u").join(have, "v", "left")
    enough = F.coalesce("out_degree", F.lit(0)) >= F.col("need_out")
    if into:
        enough &= F.coalesce("in_degree", F.lit(0)) >= F.col("need_in")
    return rows.filter(enough).select("u", "v")


def _label_counts(edges: DataFrame) -> DataFrame:
    """v, side, label, n: distinct neighbours of each label."""
    out = edges.select(F.col("src").alias("v"), F.lit("out").alias("side"), F.col("dst_label").alias("label"), F.col("dst").alias("w"))
    into = edges.select(F.col("dst").alias("v"), F.lit("in").alias("side"), F.col("src_label").alias("label"), F.col("src").alias("w"))
    return dealt(out.union(into), "v", "side", "label", "w").distinct().groupBy("v", "side", "label").agg(F.count("*").alias("n"))


def _variety(counts: dict) -> int:
    """Distinct labels that are sure; unlabelled neighbours add at least one if there is no other."""
    return max(len([x for x in counts if x is not None]), int(bool(counts)))


def by_label_variety(candidates: DataFrame, edges: DataFrame, pattern: Pattern) -> DataFrame:
    """v's neighbours have at least as many distinct labels as u's, on either side."""
    variety = _label_counts(edges).groupBy("v").agg(F.count_if(F.col("side") == "in").alias("has_in"), F.count_if(F.col("side") == "out").alias("has_out"))
    wanted = _pattern_table(edges.sparkSession, pattern, "u long, need_in long, need_out long", lambda u: (u, *map(_variety, pattern.neighbour_labels(u))))
    rows = candidates.join(wanted, "u").join(variety, "v", "left")
    return rows.filter((F.coalesce("has_in", F.lit(0)) >= F.col("need_in")) & (F.coalesce("has_out", F.lit(0)) >= F.col("need_out"))).select("u", "v")


def by_label_multiset(candidates: DataFrame, edges: DataFrame, pattern: Pattern) -> DataFrame:
    """For each label, v has at least as many neighbours of it as u, on either side: what the sketch approximates."""
    needs = [(u, side, label, n) for u in range(len(pattern.labels)) for side, counts in zip(("in", "out"), pattern.neighbour_labels(u)) for label, n in counts.items() if label is not None]
    if not needs:
        return candidates
    wanted = F.broadcast(edges.sparkSession.createDataFrame(needs, "u long, side string, label long, need long"))
    total = F.broadcast(wanted.groupBy("u").agg(F.count("*").alias("conditions")))
    met = candidates.join(wanted, "u").join(_label_counts(edges), ["v", "side", "label"]).filter("n >= need").groupBy("u", "v").agg(F.count("*").alias("met"))
    return candidates.join(total, "u", "left").join(met, ["u", "v"], "left").filter("conditions is null or met = conditions").select("u", "v")


def kmin_sketch(edges: DataFrame, keep: int = KEPT) -> DataFrame:
    """v, side, h, c: the ``keep`` least hashes of each vertex's neighbour labels on either side, repeats included, c times each."""
    hashed = _label_counts(edges).select("v", "side", hashes.portable("label").alias("h"), "n")
    before = F.sum("n").over(Window.partitionBy("v", "side").orderBy("h")) - F.col("n")
    return hashed.withColumn("before", before).filter(F.col("before") < keep).select("v", "side", "h", F.least("n", keep - F.col("before")).alias("c"))


def _pattern_sketch(spark, pattern: Pattern, keep: int) -> DataFrame:
    rows = []
    for u in range(len(pattern.labels)):
        for side, counts in zip(("in", "out"), pattern.neighbour_labels(u)):
            left = keep
            for h, n in sorted((hashes.portable_of(label), n) for label, n in counts.items() if label is not None):
                if left > 0:
                    rows.append((u, side, h, min(n, left)))
                left -= n
    return F.broadcast(spark.createDataFrame(rows, "u long, side string, h long, c long"))


def by_kmin(candidates: DataFrame, edges: DataFrame, pattern: Pattern, keep: int = KEPT) -> DataFrame:
    """Sketches of u and v, common values cancelled: u must not have a value left below all that v has left.

    Were u's neighbour labels among v's, such a value would be in v's sketch too.
    """
    wanted = _pattern_sketch(edges.sparkSession, pattern, keep)
    own = candidates.join(wanted, "u").select("u", "v", "side", "h", F.col("c").alias("a"), F.lit(0).cast("long").alias("b"))
    has = candidates.join(kmin_sketch(edges, keep), "v").select("u", "v", "side", "h", F.lit(0).cast("long").alias("a"), F.col("c").alias("b"))
    values = own.union(has).groupBy("u", "v", "side", "h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    left = values.groupBy("u", "v", "side").agg(F.min(F.when(F.col("a") > F.col("b"), F.col("h"))).alias("x"), F.min(F.when(F.col("b") > F.col("a"), F.col("h"))).alias("y"))
    return candidates.join(left.filter("x is not null and (y is null or x < y)"), ["u", "v"], "left_anti").select("u", "v")


def by_least_hash(candidates: DataFrame, edges: DataFrame, pattern: Pattern) -> DataFrame:
    """On either side the least hash of v's neighbour labels is no greater than that of u's."""
    least = _label_counts(edges).groupBy("v", "side").agg(F.min(hashes.portable("label")).alias("has"))
    wanted = F.broadcast(_pattern_sketch(edges.sparkSession, pattern, 1).select("u", "side", F.col("h").alias("need")))
    missed = candidates.join(wanted, "u").join(least, ["v", "side"], "left").filter("has is null or has > need")
    return candidates.join(missed, ["u", "v"], "left_anti").select("u", "v")


def steady(candidates: DataFrame, edges: DataFrame, pattern: Pattern) -> DataFrame:
    """For each in-neighbour of u, v has one of the same label and at least the same in-degree."""
    spark = edges.sparkSession
    needs = [(u, a, pattern.labels[a], pattern.degree(a)[0]) for u in range(len(pattern.labels)) for a in sorted({a for a, b, _ in pattern.edges if b == u})]
    if not needs:
        return candidates
    wanted = F.broadcast(spark.createDataFrame(needs, "u long, a long, want long, need long"))
    have = degrees(edges.select("src", "dst").distinct()).select(F.col("id").alias("src"), "in_degree")
    # the best in-degree of each label is all that counts
    sided = edges.select("src", "dst", "src_label").distinct().join(have, "src").withColumn("want", F.explode(F.array("src_label", F.lit(None).cast("long"))))
    best = sided.groupBy(F.col("dst").alias("v"), F.col("want").alias("of")).agg(F.max("in_degree").alias("best"))
    met = candidates.join(wanted, "u").join(best, "v").filter(F.col("want").eqNullSafe(F.col("of"))).filter("best >= need").groupBy("u", "v").agg(F.count_distinct("a").alias("met"))
    total = F.broadcast(wanted.groupBy("u").agg(F.count("*").alias("conditions")))
    return candidates.join(total, "u", "left").join(met, ["u", "v"], "left").filter("conditions is null or met = conditions").select("u", "v")


def by_out_degree(candidates: DataFrame, edges: DataFrame, pattern: Pattern) -> DataFrame:
    """v has at least u's out-degree."""
    return by_degree(candidates, edges, pattern, into=False)


STEPS = {"degree": by_degree, "out_degree": by_out_degree, "variety": by_label_variety, "multiset": by_label_multiset, "kmin": by_kmin, "least_hash": by_least_hash, "steady": steady}


def filtered(vertices: DataFrame, edges: DataFrame, pattern: Pattern, *names: str) -> DataFrame:
    """Label candidates through the named filters in turn."""
    out = dealt(by_label(vertices, pattern), "v") if names else by_label(vertices, pattern)
    for name in names:
        out = STEPS[name](out, edges, pattern)
    return out


def filtered_counts(vertices: DataFrame, edges: DataFrame, pattern: Pattern, *names: str) -> tuple[DataFrame, DataFrame]:
    """(``filtered``, stored; rows of step, name, n: the candidates that each filter leaves). Every step runs once."""
    out, facts = stored_with(by_label(vertices, pattern), "candidates", rows_total())
    counts = [(0, "label", facts["n"])]
    for i, name in enumerate(names, 1):
        out, facts = stored_with(STEPS[name](out, edges, pattern), "candidates", rows_total())
        counts.append((i, name, facts["n"]))
    return out, edges.sparkSession.createDataFrame(counts, "step long, name string, n long")


def mask(vertices: DataFrame, candidates: DataFrame, pattern: Pattern) -> DataFrame:
    """u, v, valid (0 or 1) for every pattern vertex and every data vertex."""
    every = vertices.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(pattern.labels) - 1).cast("long"))).alias("u"), F.col("id").alias("v"))
    return every.join(candidates.select("u", "v", F.lit(1).alias("valid")), ["u", "v"], "left").select("u", "v", F.coalesce("valid", F.lit(0)).alias("valid"))


def feasible_edges(vertices: DataFrame, edges: DataFrame, pattern: Pattern, k: int, *names: str) -> DataFrame:
    """src, dst of the data edges that pattern edge ``k`` may be, by its labels and by the filters at both ends."""
    from .matching import edge_candidates

    return edge_candidates(edges, pattern, k, filtered(vertices, edges, pattern, *names))

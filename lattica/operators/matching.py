"""Labelled subgraph matching: embeddings, factorised matches, refinement, association-rule groups."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Pattern
from ..storage import dealt, stored
from .filters import by_label
from .skew import spread_join


def edge_candidates(edges: DataFrame, pattern: Pattern, k: int, candidates: DataFrame | None = None) -> DataFrame:
    """src, dst of the data edges that pattern edge ``k`` may be: by labels, and by candidates(u, v) if given."""
    u, v, label = pattern.edges[k]
    found = edges
    for name, want in (("label", label), ("src_label", pattern.labels[u]), ("dst_label", pattern.labels[v])):
        if want is not None:
            found = found.filter(F.col(name) == want)
    found = found.select("src", "dst").distinct()
    if candidates is not None:
        for end, w in (("src", u), ("dst", v)):
            found = found.join(dealt(candidates.filter(F.col("u") == w).select(F.col("v").alias(end)), end), end, "left_semi")
    return found.filter("src = dst") if u == v else found


def edge_sizes(edges: DataFrame, pattern: Pattern) -> tuple[dict[int, int], dict[tuple[int, int], float]]:
    """How many data edges each pattern edge (k) may be, by labels, and about how many of them a vertex at either end (k, u) has.

    One scan, one row to the driver; ends are counted by sketches, since only the order of joins rests on them.
    """
    if not pattern.edges:
        return {}, {}
    met = []
    for k, (u, v, label) in enumerate(pattern.edges):
        wanted = F.lit(True)
        for name, want in (("label", label), ("src_label", pattern.labels[u]), ("dst_label", pattern.labels[v])):
            if want is not None:
                wanted &= F.col(name) == want
        met.append(F.count_if(wanted).alias(f"k{k}"))
        met += [F.approx_count_distinct(F.when(wanted, F.col(end))).alias(f"{end}{k}") for end in ("src", "dst")]
    row = edges.agg(*met).first()
    sizes = {k: row[f"k{k}"] for k in range(len(pattern.edges))}
    return sizes, {(k, w): sizes[k] / max(1, row[f"{end}{k}"]) for k, (u, v, _) in enumerate(pattern.edges) for w, end in ((u, "src"), (v, "dst"))}


def _different(bound: DataFrame, pattern: Pattern, fresh: list[int], have: list[int]) -> DataFrame:
    """``bound`` where fresh pattern vertices take other data vertices than all others of their label."""
    for i, w in enumerate(fresh):
        for x in [*have, *fresh[:i]]:
            if None in (pattern.labels[w], pattern.labels[x]) or pattern.labels[w] == pattern.labels[x]:
                bound = bound.filter(F.col(f"u{w}") != F.col(f"u{x}"))
    return bound


def _nearest(bound: DataFrame, steps: list[DataFrame], w: int) -> DataFrame:
    """``bound`` with u{w}, which every one of ``steps`` ties to a bound vertex.

    Each row goes on along the tie with the fewest edges from its vertex, and the
    other ties only confirm; so a hub beside a vertex of few edges costs the few.
    """
    ends = [next(c for c in step.columns if c != f"u{w}") for step in steps]
    for i, (step, end) in enumerate(zip(steps, ends)):
        bound = bound.join(step.groupBy(end).agg(F.count("*").alias(f"__n{i}")), end)
    counts = [F.col(f"__n{i}") for i in range(len(steps))]
    least, out = F.least(*counts), None
    for i, step in enumerate(steps):
        mine = counts[i] == least
        for c in counts[:i]:
            mine &= c > least
        part = bound.filter(mine).drop(*[f"__n{j}" for j in range(len(steps))]).join(step, ends[i])
        for j, other in enumerate(steps):
            if j != i:
                part = part.join(other, [ends[j], f"u{w}"], "left_semi")
        out = part if out is None else out.unionByName(part)
    return out


def match(edges: DataFrame, pattern: Pattern, injective: bool = True, candidates: DataFrame | None = None, given_order: bool = False, vertices: DataFrame | None = None) -> DataFrame:
    """All embeddings, columns u0, u1, ...: directed, label-preserving, not induced.

    A fold of equi-joins on every pattern vertex that is bound already, from the
    edge with the fewest candidates on, then always along the edge of which a
    bound vertex has the fewest (``given_order``: as the edges are given, as far
    as they hang together). A vertex that several edges tie to bound ones
    is reached, row by row, along the edge of least fan-out. Keys with very many
    rows are dealt to several tasks. With ``injective`` different pattern vertices
    take different data vertices; the test is left out where their labels differ.

    Parts of the pattern that do not hang together are matched apart and crossed,
    since every combination is a result. A vertex without edges takes the
    ``vertices`` (id, label) of its label. An empty pattern has no match.
    """
    if not pattern.labels:
        return edges.sparkSession.createDataFrame([], "struct<>")
    parts = pattern.parts()
    alone = [min(p) for p in parts if len(p) == 1 and not any(min(p) in e[:2] for e in pattern.edges)]
    if alone and vertices is None:
        raise ValueError("a pattern vertex without edges needs the table of vertices")
    order = pattern.order(as_given=True) if given_order else pattern.order(*edge_sizes(edges, pattern) if len(pattern.edges) > 1 else ())
    step_of = {}
    for k, (u, v, _) in enumerate(pattern.edges):
        found = edge_candidates(edges, pattern, k, candidates)
        step_of[k] = found.select(F.col("src").alias(f"u{u}")) if u == v else found.select(F.col("src").alias(f"u{u}"), F.col("dst").alias(f"u{v}"))
    folded = None
    have: list[int] = []
    for part in parts:
        bound: DataFrame | None = None
        own: list[int] = []
        todo = [k for k in order if pattern.edges[k][0] in part]
        for u in sorted(part & set(alone)):
            rows = vertices if pattern.labels[u] is None else vertices.filter(F.col("label") == pattern.labels[u])
            bound, own = rows.select(F.col("id").alias(f"u{u}")), [u]
            if candidates is not None:
                bound = bound.join(candidates.filter(F.col("u") == u).select(F.col("v").alias(f"u{u}")), f"u{u}", "left_semi")
        while todo:
            u, v, _ = pattern.edges[todo[0]]
            fresh = [w for w in dict.fromkeys((u, v)) if w not in own]
            if bound is None:
                bound = step_of[todo.pop(0)]
            elif not fresh:
                bound = bound.join(step_of[todo.pop(0)], [f"u{w}" for w in dict.fromkeys((u, v))], "left_semi")
            else:
                ties = [k for k in todo if fresh[0] in pattern.edges[k][:2] and set(pattern.edges[k][:2]) <= {*own, fresh[0]} and pattern.edges[k][0] != pattern.edges[k][1]]
                if len(ties) > 1:
                    bound = _nearest(bound, [step_of[k] for k in ties], fresh[0])
                else:
                    shared = f"u{u if u in own else v}"
                    bound = spread_join(bound, step_of[ties[0]], shared) if len(own) == 2 else bound.join(step_of[ties[0]], shared)
                todo = [k for k in todo if k not in ties]
            if injective:
                bound = _different(bound, pattern, fresh, own)
            own += fresh
        folded = bound if folded is None else folded.crossJoin(bound)
        if injective and have:
            folded = _different(folded, pattern, own, have)
        have += own
    return folded.select(*[f"u{w}" for w in sorted(have)])


def roots(matches: DataFrame) -> DataFrame:
    return matches.select(F.col("u0").alias("root")).distinct()


def factorised(edges: DataFrame, pattern: Pattern, root: int = 0) -> DataFrame:
    """root, plan_edge, src, dst: along a walk of the pattern, the pairs of every pattern edge that each root reaches, without caps.

    Plan edges are numbered along ``pattern.walk(root)``; an edge that closes a
    cycle keeps the pairs of which the root reaches both ends. Edges of a part of
    the pattern that does not hang together with the root have a null root.
    """
    out, reached = None, {}
    for place, (k, how) in enumerate(pattern.walk(root)):
        a, b, _ = pattern.edges[k]
        found = edge_candidates(edges, pattern, k)
        if how == "start" or not reached:
            owner = F.lit(None).cast("long") if how == "start" else F.col("src" if a == root else "dst")
            step = found.select(owner.alias("root"), "src", "dst")
            fresh = [(a, "src"), (b, "dst")]
        elif how == "close":
            to_a = reached[a].select("root", F.col("at").alias("src"))
            to_b = reached[b].select(F.col("root").alias("r"), F.col("at").alias("d"))
            step = to_a.join(found, "src").join(to_b, F.col("root").eqNullSafe(F.col("r")) & (F.col("dst") == F.col("d")), "left_semi").select("root", "src", "dst")
            fresh = []
        else:
            at, end = (a, "src") if how == "out" else (b, "dst")
            found = dealt(found, end)
            step = reached[at].join(found, reached[at]["at"] == found[end]).select("root", "src", "dst")
            fresh = [(b, "dst") if how == "out" else (a, "src")]
        for w, end in fresh:
            reached[w] = step.select("root", F.col(end).alias("at")).distinct()
        part = step.select("root", F.lit(place).alias("plan_edge"), "src", "dst")
        out = part if out is None else out.union(part)
    if out is None:
        return edges.select(F.col("src").alias("root"), F.lit(0).alias("plan_edge"), "src", "dst").limit(0)
    return out


def factorised_counts(forest: DataFrame, plan_edges: int) -> DataFrame:
    """root, n (up to 38 digits): the product over plan edges of their pairs; roots that lack one are left out."""
    sizes = forest.groupBy("root", "plan_edge").agg(F.count("*").alias("n"))
    product = F.aggregate("ns", F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))
    lists = sizes.groupBy("root").agg(F.collect_list("n").alias("ns")).select("root", F.size("ns").alias("k"), product.alias("n"))
    # pairs without a root are the same for every root: one row
    shared = lists.filter("root is null").agg(F.coalesce(F.max("k"), F.lit(0)).alias("more"), F.coalesce(F.max("n"), F.lit(1).cast("decimal(38,0)")).alias("times"))
    rows = lists.filter("root is not null").crossJoin(F.broadcast(shared)).filter(F.col("k") + F.col("more") == plan_edges)
    return rows.select("root", (F.col("n") * F.col("times")).cast("decimal(38,0)").alias("n"))


def incomplete_roots(forest: DataFrame, plan_edges: int, roots: DataFrame | None = None) -> DataFrame:
    """Roots of which some plan edge has no pair; with ``roots`` (root) also those that have none at all."""
    found = forest.select("root", "plan_edge").filter("root is not null").distinct().groupBy("root").agg(F.count("*").alias("n"))
    if roots is not None:
        found = roots.select("root").distinct().join(found, "root", "left")
    return found.filter(F.coalesce("n", F.lit(0)) < plan_edges).select("root")


def refine(vertices: DataFrame, edges: DataFrame, pattern: Pattern, max_rounds: int | None = None) -> DataFrame:
    """Candidates u, v left when each keeps a candidate at the other end of every pattern edge.

    Goes on to the fixpoint, at most one round a candidate; where ``max_rounds`` is given and reached before, it raises.
    """
    now = stored(by_label(vertices, pattern), "candidates")
    size = now.count()
    needs = Counter(w for a, b, _ in pattern.edges for w in (a, b))
    wanted = F.broadcast(vertices.sparkSession.createDataFrame([(u, needs[u]) for u in range(len(pattern.labels))], "u long, need long"))
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        met = None
        for k, (a, b, _) in enumerate(pattern.edges):
            live = edge_candidates(edges, pattern, k, now)
            for w, end in ((a, "src"), (b, "dst")):
                part = live.select(F.lit(w).cast("long").alias("u"), F.col(end).alias("v")).distinct()
                met = part if met is None else met.union(part)
        held = met.groupBy("u", "v").agg(F.count("*").alias("n"))
        now = stored(dealt(now, "u", "v").join(wanted, "u").join(held, ["u", "v"], "left").filter(F.coalesce("n", F.lit(0)) == F.col("need")).select("u", "v"), "candidates")
        if (left := now.count()) == size:
            return now
        size = left
    raise RuntimeError("refinement did not settle")


def association_groups(matches: DataFrame) -> DataFrame:
    """pivot, pos, matched_id: for the binding of vertex 0, the distinct ids at each pattern place."""
    places = [c for c in matches.columns if c[0] == "u"]
    rows = matches.select(F.col("u0").alias("pivot"), F.explode(F.array(*[F.struct(F.lit(int(c[1:])).alias("pos"), F.col(c).alias("id")) for c in places])).alias("m"))
    return rows.select("pivot", F.col("m.pos").alias("pos"), F.col("m.id").alias("matched_id")).distinct()


def association_rows(groups: DataFrame) -> DataFrame:
    """pivot, cond_j, pos, cnt, matched (sorted): the grouped result, one condition a place."""
    lists = groups.groupBy("pivot", "pos").agg(F.sort_array(F.collect_list("matched_id")).alias("matched"))
    return lists.select("pivot", F.col("pos").alias("cond_j"), "pos", F.size("matched").alias("cnt"), "matched")

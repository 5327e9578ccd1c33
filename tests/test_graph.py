"""Operators against plain Python on small graphs."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict, deque

import pytest

from lattica.operators import components, filters, matching, partition, products, sets, skew, structure, tiled, traversal
from lattica.plans.pattern import Pattern

README = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 3)]


def graph(seed: int, n: int = 12, m: int = 26):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
    return edges, {v: v % 3 for v in range(n)}


def df(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def pairs(rows, *names):
    return sorted(tuple(r[n] for n in names) for r in rows.collect())


def labelled(spark, edges, label):
    vertices = spark.createDataFrame(sorted(label.items()), "id long, label long")
    rows = [(a, b, 0, label[a], label[b]) for a, b in edges]
    return vertices, spark.createDataFrame(rows, "src long, dst long, label long, src_label long, dst_label long")


def test_components_of_two_cycles(spark):
    assert pairs(traversal.wcc(df(spark, README)), "id", "component") == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)]


def test_empty_graph(spark):
    none = df(spark, [])
    assert traversal.wcc(none).count() == 0
    assert traversal.walks(none, none).count() == 0
    assert traversal.khop_edges(none).count() == 0
    assert traversal.pagerank(none)[0].count() == 0
    assert structure.dense_ids(structure.endpoints(none)).count() == 0
    assert structure.edge_stats(none).first().n_edges == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_and_labels(spark, seed):
    edges, _ = graph(seed)
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    vertices = {v for e in edges for v in e}

    def levels(source):
        found, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for b in out[a]:
                if b not in found:
                    found[b] = found[a] + 1
                    queue.append(b)
        return found

    g = df(spark, edges)
    source = edges[0][0]
    found = traversal.bfs(g, source)
    assert dict(pairs(found, "id", "level")) == levels(source)
    assert {r.id for r in traversal.unreached(g, found).collect()} == vertices - set(levels(source))
    reached = {v: levels(v) for v in vertices}
    assert dict(pairs(traversal.ancestor_labels(g), "id", "label")) == {v: min(u for u in vertices if v in reached[u]) for v in vertices}


def test_pagerank(spark):
    edges, _ = graph(3)
    vertices = sorted({v for e in edges for v in e})
    n, out = len(vertices), Counter(a for a, _ in edges)
    rank = dict.fromkeys(vertices, 1 / n)
    for _ in range(10):
        rank = {v: 0.15 / n + 0.85 * sum(rank[a] / out[a] for a, b in edges if b == v) for v in vertices}
    ranks, changes = traversal.pagerank(df(spark, edges), tolerance=1e-12)
    assert len(changes) == 10
    assert {r.id: pytest.approx(r["rank"]) for r in ranks.collect()} == rank
    assert len(traversal.pagerank(df(spark, edges), tolerance=1.0)[1]) == 1
    with pytest.raises(ValueError):
        traversal.pagerank(df(spark, edges), damping=1.5)


def test_walks_and_products(spark):
    edges, _ = graph(4)
    g = df(spark, edges)
    walk = sorted({(a, c) for a, b in edges for x, c in edges if b == x and len({a, b, c}) == 3})
    product = sorted({(a, c) for a, b in edges for x, c in edges if b == x})
    assert pairs(traversal.walks(g, g), "src", "dst") == walk
    assert pairs(traversal.boolean_product(g, g), "i", "j") == product
    assert set(walk) <= set(product)
    assert pairs(traversal.boolean_product(g, g, True), "i", "j") == sorted({(a, x) for a, b in edges for x, c in edges if b == c})


@pytest.mark.parametrize("hops", [1, 2, 0])
def test_neighbourhoods(spark, hops):
    edges, _ = graph(5)
    expected = []
    for center in {v for e in edges for v in e}:
        seen, frontier, depth = {center}, {center}, 1
        while frontier and (hops == 0 or depth < hops):
            frontier = {b for a, b in edges if a in frontier} - seen
            seen |= frontier
            depth += 1
        expected += [(center, a, b) for a, b in edges if a in seen]
    assert pairs(traversal.khop_edges(df(spark, edges), hops), "center", "src", "dst") == sorted(expected)


def test_structure(spark):
    edges, _ = graph(6)
    g = df(spark, edges)
    vertices = sorted({v for e in edges for v in e})
    out, into = Counter(a for a, _ in edges), Counter(b for _, b in edges)
    assert pairs(structure.degrees(g), "id", "in_degree", "out_degree") == [(v, into[v], out[v]) for v in vertices]
    assert pairs(structure.dense_ids(structure.endpoints(g)), "id", "dense_id") == [(v, i) for i, v in enumerate(vertices)]
    assert pairs(structure.degree_order(g), "rank", "id") == [(i, v) for i, v in enumerate(sorted(vertices, key=lambda v: (-out[v], v)))]
    assert pairs(structure.csr_offsets(g), "id", "out_offset") == [(v, sum(out[u] for u in vertices if u < v)) for v in vertices]
    assert pairs(structure.transpose(structure.transpose(g)), "src", "dst") == edges
    assert pairs(structure.adjacency_edges(structure.adjacency(g)), "id", "nbr") == edges
    placed = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "src long, dst long, pos long")
    first = list(dict.fromkeys(itertools.chain.from_iterable(edges)))
    assert pairs(structure.first_appearance_ids(placed, "pos"), "dense_id", "id") == list(enumerate(first))


def test_grid_and_tiles(spark):
    edges, _ = graph(7)
    g = df(spark, edges)
    scope = partition.scope_of(g, 3)
    assert scope == -(-(max(map(max, edges)) + 1) // 3)
    blocks = partition.grid(g, 3, scope)
    assert all((r.block_x, r.block_y, r.block_id) == (r.src // scope, r.dst // scope, r.src // scope * 3 + r.dst // scope) for r in blocks.collect())
    path = partition.stored_blocks(blocks)
    assert pairs(partition.read_block(spark, path, 0, 1), "src", "dst") == [e for e in edges if e[0] // scope == 0 and e[1] // scope == 1]
    tiled = partition.tiles(blocks, scope, 2)
    assert partition.bit_tile_count(partition.bit_tiles(tiled)).first().nnz == len(edges)
    assert sum(r.nnz for r in partition.tile_stats(tiled).collect()) == len(edges)
    for cut in (partition.edge_cut, partition.vertex_cut):
        for hashed in (False, True):
            assert sum(r.n_edges for r in partition.part_sizes(cut(g, 3, hashed)).collect()) == len(edges)


def embeddings(edges, label, pattern, injective):
    have = set(edges)
    n = len(pattern.labels)
    for bind in itertools.product(sorted(label), repeat=n):
        if injective and len(set(bind)) < n:
            continue
        if all(want is None or label[v] == want for v, want in zip(bind, pattern.labels)) and all((bind[a], bind[b]) in have for a, b, _ in pattern.edges):
            yield bind


PATTERNS = [
    Pattern((None, None, None), ((0, 1, None), (1, 2, None), (2, 0, None))),
    Pattern((0, 1, None), ((0, 1, None), (0, 2, None))),
    Pattern((None, None, None, None), ((0, 1, None), (1, 2, None), (2, 3, None), (0, 3, None))),
    Pattern((1, None), ((0, 1, None), (1, 1, None))),
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_matching(spark, pattern):
    edges, label = graph(8, 8, 26)
    vertices, rows = labelled(spark, edges, label)
    names = [f"u{i}" for i in range(len(pattern.labels))]
    iso = sorted(embeddings(edges, label, pattern, True))
    homo = sorted(embeddings(edges, label, pattern, False))
    assert pairs(matching.match(rows, pattern), *names) == iso
    assert pairs(matching.match(rows, pattern, injective=False), *names) == homo
    assert set(iso) <= set(homo)
    for name in ("degree", "out_degree", "variety", "multiset", "kmin", "least_hash", "steady"):
        kept = {(r.u, r.v) for r in filters.filtered(vertices, rows, pattern, name).collect()}
        assert all((u, v) in kept for bind in iso for u, v in enumerate(bind)), name
    candidates = filters.filtered(vertices, rows, pattern, "degree", "multiset")
    assert pairs(matching.match(rows, pattern, candidates=candidates), *names) == iso
    fixed = {(r.u, r.v) for r in matching.refine(vertices, rows, pattern).collect()}
    assert all((u, v) in fixed for bind in homo for u, v in enumerate(bind))


@pytest.mark.parametrize("held, made", [(1 << 23, 1 << 21), (7, 5), (40, 1)])
def test_products_are_made_in_blocks(spark, monkeypatch, held, made):
    monkeypatch.setattr(products, "HELD", held)
    monkeypatch.setattr(products, "MADE", made)
    rng = random.Random(made)
    # one vertex with very many edges, a thin part with far ids, and ids that are null
    edges = sorted({(0, rng.randrange(60)) for _ in range(200)} | {(rng.randrange(60), rng.randrange(0, 4000, 7)) for _ in range(150)} | {(rng.randrange(60), rng.randrange(60)) for _ in range(150)})
    g = spark.createDataFrame(edges, "src long, dst long")
    walk = {(a, c) for a, b in edges for x, c in edges if b == x and len({a, b, c}) == 3}
    assert pairs(traversal.walks(g, g), "src", "dst") == sorted(walk)
    assert traversal.walk_count(g, g).first().n == len(walk)
    scope = -(-(max(map(max, walk)) + 1) // 4)
    assert {(r.block_x, r.block_y): r.n_edges for r in traversal.walk_blocks(g, g, 4).collect()} == Counter((a // scope, b // scope) for a, b in walk)
    rows, found = traversal.walk_tile_rows(g, g, 4, 256)
    assert found == scope
    cut = sorted((r.block_x * scope + r.tile_x * 256 + r.x_in, r.block_y * scope + r.tile_y * 256 + y) for r in rows.collect() for y in r.cols)
    assert cut == sorted(walk) and rows.select("block_x", "block_y", "tile_x", "tile_y", "x_in").distinct().count() == rows.count()
    null = spark.createDataFrame([(None, 1), (1, None), (1, 2), (2, 1)], "src long, dst long")
    assert {(r.i, r.j) for r in traversal.boolean_product(null, null).collect()} == {(None, None), (None, 2), (1, 1), (2, None), (2, 2)}


def test_hubs_do_not_multiply_what_is_bound(spark):
    # 5 sellers and 40 buyers share one place: along it each seller meets all buyers
    edges = [(100 + b, 200 + b) for b in range(40)] + [(200 + b, 300 + b % 5) for b in range(40)] + [(300 + s, 400) for s in range(5)] + [(100 + b, 400) for b in range(40)]
    label = {v: v // 100 for e in edges for v in e}
    circle = Pattern((1, 2, 3, 4), ((0, 1, None), (1, 2, None), (2, 3, None), (0, 3, None)))
    _, rows = labelled(spark, edges, label)
    order = circle.order(*matching.edge_sizes(rows, circle))
    assert order[0] == 2 and order.index(3) == 3
    assert pairs(matching.match(rows, circle), "u0", "u1", "u2", "u3") == sorted(embeddings(edges, label, circle, True))


def test_shares_of_large_steps_are_not_joined(spark):
    # adaptive execution would make one task of so few rows, and ten of any number: a task's share then grows with the input
    edges, label = graph(5, 8, 26)
    vertices, rows = labelled(spark, edges, label)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert structure.symmetric(rows).rdd.getNumPartitions() == parts
    assert filters.filtered(vertices, rows, PATTERNS[1], "degree").rdd.getNumPartitions() == parts


def test_refinement_goes_on_to_the_fixpoint(spark):
    vertices, rows = labelled(spark, [(i, i + 1) for i in range(43)], dict.fromkeys(range(44), 0))
    circle = Pattern((None, None), ((0, 1, None), (1, 0, None)))
    assert matching.refine(vertices, rows, circle).count() == 0
    with pytest.raises(RuntimeError):
        matching.refine(vertices, rows, circle, max_rounds=2)


def test_groups_by_pivot(spark):
    rows = spark.createDataFrame([(126, 183), (126, 115407), (138, 192)], "u0 long, u1 long")
    found = matching.association_rows(matching.association_groups(rows))
    assert sorted((r.pivot, r.pos, r.cnt, tuple(r.matched)) for r in found.collect()) == [(126, 0, 1, (126,)), (126, 1, 2, (183, 115407)), (138, 0, 1, (138,)), (138, 1, 1, (192,))]


def test_factorised(spark):
    edges, label = graph(9)
    _, rows = labelled(spark, edges, label)
    pattern = Pattern((None, None, None), ((0, 1, None), (1, 2, None)))
    forest = matching.factorised(rows, pattern)
    expected = {}
    for root in {a for a, _ in edges}:
        first = {b for a, b in edges if a == root}
        second = {(a, b) for a, b in edges if a in first}
        if second:
            expected[root] = len(first) * len(second)
    assert dict(pairs(matching.factorised_counts(forest, 2), "root", "n")) == expected
    complete = set(expected)
    starts = {a for a, _ in edges}
    assert {r.root for r in matching.incomplete_roots(forest, 2).collect()} == starts - complete
    every = spark.createDataFrame([(v,) for v in range(12)], "root long")
    assert {r.root for r in matching.incomplete_roots(forest, 2, every).collect()} == set(range(12)) - complete


def test_factorised_circles_and_parts(spark):
    edges, label = graph(11, 7, 22)
    _, rows = labelled(spark, edges, label)
    circle = Pattern((None, None, None), ((0, 1, None), (1, 2, None), (2, 0, None)))
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    expected = {}
    for root in {a for a, _ in edges}:
        one = {(root, b) for b in out[root]}
        two = {(b, c) for _, b in one for c in out[b]}
        three = {(c, root) for _, c in two if root in out[c]}
        if three:
            expected[root] = len(one) * len(two) * len(three)
    assert dict(pairs(matching.factorised_counts(matching.factorised(rows, circle), 3), "root", "n")) == expected
    into = Pattern((None, None, None), ((0, 1, None), (2, 0, None)))
    degree_in, degree_out = Counter(b for _, b in edges), Counter(a for a, _ in edges)
    assert dict(pairs(matching.factorised_counts(matching.factorised(rows, into), 2), "root", "n")) == {v: degree_in[v] * degree_out[v] for v in range(7) if degree_in[v] and degree_out[v]}
    apart = Pattern((None,) * 4, ((0, 1, None), (2, 3, None)))
    assert dict(pairs(matching.factorised_counts(matching.factorised(rows, apart), 2), "root", "n")) == {v: degree_out[v] * len(edges) for v in degree_out}
    many = spark.createDataFrame([(1, k, 0, i) for k in range(3) for i in range(1)], "root long, plan_edge int, src long, dst long")
    big = spark.range(3).selectExpr("1L root", "cast(id as int) plan_edge", "explode(sequence(1L, 3000000L)) src", "0L dst")
    assert str(matching.factorised_counts(big, 3).first().n) == str(3_000_000**3) and matching.factorised_counts(many, 3).first().n == 1


def test_patterns_of_parts_and_none(spark):
    edges, label = graph(12, 6, 14)
    vertices, rows = labelled(spark, edges, label)
    assert matching.match(rows, Pattern((), ())).count() == 0
    assert pairs(matching.match(rows, Pattern((1,), ()), vertices=vertices), "u0") == sorted((v,) for v, x in label.items() if x == 1)
    with pytest.raises(ValueError):
        matching.match(rows, Pattern((1,), ()))
    apart = Pattern((None, 0, 1, None), ((0, 1, None), (2, 3, None)))
    scattered = Pattern((None, None, None, None), ((0, 1, None), (2, 3, None), (1, 2, None)))
    for pattern in (apart, scattered, Pattern((None, None, 2), ((0, 1, None),))):
        for injective in (True, False):
            found = matching.match(rows, pattern, injective, given_order=True, vertices=vertices)
            assert pairs(found, *found.columns) == sorted(embeddings(edges, label, pattern, injective))
    assert scattered.order(as_given=True) == [0, 2, 1]
    assert sorted(k for k, _ in scattered.walk(3)) == [0, 1, 2]


def test_joins_with_hot_keys(spark):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 1), (3, 1)], "k long, a long")
    right = spark.createDataFrame([(1, 7), (1, 8), (2, 9), (4, 9)], "k long, b long")
    assert skew.hot_keys(left, "k", share=100) == {1: 5}
    assert pairs(skew.spread_join(left, right, "k", share=100), "k", "a", "b") == pairs(left.join(right, "k"), "k", "a", "b")


def test_long_paths_and_circles(spark):
    edges = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 302), (302, 300), (302, 5), (400, 400), (150, 3)]
    g = df(spark, edges)
    level = dict(pairs(traversal.bfs(g, 0), "id", "level"))
    assert level == {i: i for i in range(201)}
    least = dict(pairs(traversal.ancestor_labels(g), "id", "label"))
    assert least[302] == 300 and least[400] == 400 and least[200] == 0 and least[4] == 0


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "SHARE", 20)
    monkeypatch.setattr(components, "HOT_KEYS", 8)
    edges = [(1000, i) for i in range(100)] + [(i, 500) for i in range(200, 300)] + [(99, 200), (700, 701)]
    assert dict(pairs(traversal.wcc(df(spark, edges)), "id", "component")) == {v: 0 if v < 700 or v == 1000 else 700 for e in edges for v in e}


def test_sets(spark):
    rows = spark.range(23).selectExpr("id", "id % 3 k")
    assert sorted(r["count"] for r in sets.row_split(rows, 5, ["id"]).groupBy("slice").count().collect()) == [4, 4, 5, 5, 5]
    assert sets.row_split(rows.limit(2), 5, ["id"]).count() == 2
    a = spark.createDataFrame([(1, 3), (1, 40), (2, 5)], "key long, x long")
    b = spark.createDataFrame([(1, 3), (2, 5), (3, 0)], "key long, x long")
    packed = [structure.packed_sets(t, "key", "x") for t in (a, b)]
    found = {r.key: (r.n_a, r.n_b, r.n_and, r.equal, r.a_empty) for r in sets.bitmap_facts(*packed).collect()}
    assert found == {1: (2, 1, 1, False, False), 2: (1, 1, 1, True, False), 3: (0, 1, 0, False, True)}
    assert pairs(sets.bitmap_minus(*packed), "key", "word", "bits") == [(1, 1, 256)]


@pytest.mark.parametrize("kind,chunks,tile", [("csr", 1, 256), ("bit", 2, 128), ("csr", 3, 4)])
def test_tiled_matrices(spark, tmp_path, kind, chunks, tile):
    edges = sorted({(random.Random(i).randrange(900), random.Random(-i - 1).randrange(900)) for i in range(400)})
    path = f"file://{tmp_path}/t"
    tiled.write_tiled(df(spark, edges), path, kind, tile, chunks)
    assert pairs(tiled.read_tiled(spark, path), "src", "dst") == edges
    assert sum(r.nnz for r in tiled.stored_tile_stats(spark, path).collect()) == len(edges)
    with pytest.raises(ValueError):
        tiled.write_tiled(df(spark, edges), path, "other", tile)


def test_packed_sets_and_intersections(spark):
    edges, _ = graph(10)
    g = df(spark, edges)
    bits = {(r.src, r.word): r.bits for r in structure.packed_sets(g, "src", "dst").collect()}
    expected = Counter()
    for a, b in set(edges):
        expected[a, b // 32] += 1 << b % 32
    assert bits == dict(expected)
    left, right = spark.createDataFrame([(3,), (5,), (9,)], "v long"), spark.createDataFrame([(5,), (7,), (9,)], "v long")
    assert pairs(structure.set_intersection(left, right), "idx_a", "idx_b") == [(1, 0), (2, 2)]

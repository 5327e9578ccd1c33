from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lattica.llm import embedding_duplicates, near_duplicates, shingles

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def plain_set(text, width):
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def tie(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def brute(rows, width, percent=80):
    sets = {i: plain_set(t, width) for i, t in rows if i is not None}
    groups = Groups(sets)
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                groups.tie(a, b)
    return {i: (len(sets[i]), groups.root(i), groups.root(i) == i) for i in ids}


def found(rows):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows.collect() if r.doc_id is not None}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = []
    for _ in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 6, 8, 30, 80, 300]))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            copy = [w if rng.random() > 0.04 else rng.choice(vocabulary) for w in text]
            rows.append(" ".join(copy) if rng.random() < 0.7 else "\t".join(copy).upper() + (" " + passage if rng.random() < 0.5 else ""))
    rows += [" ".join(rng.choice(vocabulary) for _ in range(70)) + " " + passage for _ in range(40)]  # many share the passage
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows += [" ".join(w if rng.random() > 0.03 else rng.choice(vocabulary) for w in base) for _ in range(60)]  # one large group
    rows += ["x y z w v", "x y z w", "one", "one", "ONE", "", None, " ", "é è é è", rows[-1], rows[-1]]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,width", [(1, 2), (2, 2), (3, 5)])
def test_components(spark, seed, width):
    rows = corpus(seed)
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, component_id string, n int")
    assert found(near_duplicates.near_duplicates(frame, width)) == brute(rows, width)


def test_groups_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 5)
    rows = corpus(4)[:150]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_duplicates.near_duplicates(frame, 2)) == brute(rows, 2)


def test_sets_of_four_and_five(spark):
    rows = [(0, "a b c d e"), (1, "a b c d e f"), (2, "b c d e f"), (3, "q b c d e f g")]
    assert found(near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)) == brute(rows, 2)


def test_every_order_of_small_sets_shares_a_run():
    """What the lists rest on: at 80 per cent a run of three shared values, or the pair of four and five."""
    for union in range(1, 17):
        for gaps in range(1 << union):
            missing = bin(gaps).count("1")
            if 0 < missing and 100 * (union - missing) >= 80 * union:
                runs = max(map(len, bin(gaps)[2:].zfill(union).split("1")))
                assert runs >= 3 or union == 5 and runs >= 2


def test_sketches_pass_what_may_reach_the_threshold(spark):
    common, a, b = list(range(0, 66, 2)), list(range(1, 33, 2)), list(range(33, 63, 2))
    pad = list(range(100, 200))
    rows = [(1, 100, sorted(common + a + pad)[:64]), (2, 100, sorted(common + b + pad)[:64])]
    union = sorted(set(rows[0][2]) | set(rows[1][2]))[:64]
    assert len(set(union) & set(rows[0][2]) & set(rows[1][2])) == 33
    reps = spark.createDataFrame(rows, "id long, n long, sketch array<long>")
    assert near_duplicates.likely(spark.createDataFrame([(1, 2)], "a long, b long"), reps, 80).count() == 1
    need = math.ceil((0.8 - near_duplicates.slack(80)) * near_duplicates.SKETCH - 1e-9)
    assert sum(math.comb(64, k) * 0.8**k * 0.2 ** (64 - k) for k in range(need)) < 1e-7


def test_edges_of_near_duplicates(spark):
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (6, None), (7, ""), (8, "word " * 50_000), (9, "word " * 50_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_duplicates.near_duplicates(frame, 2).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out} == {(None, 2, 5, False), (5, 2, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False)}
    assert near_duplicates.near_duplicates(frame.limit(0), 2).count() == 0
    kept = near_duplicates.one_row_an_id(frame).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["5", "6", "7", "8", "9", "None"]
    with pytest.raises(ValueError):
        near_duplicates.near_duplicates(frame, 2, percent=0)


def test_classes_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HOT_ROWS", 1)
    rows = corpus(8)[:120]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(40)]
    frame = spark.createDataFrame([*rows, (None, rows[0][1]), (None, "of no other")], "doc_id long, text string")
    out = near_duplicates.near_duplicates(frame, 2)
    assert out.count() == len(rows) + 2
    assert found(out) == brute(rows, 2)


@pytest.mark.parametrize("percent", [95, 70, 40])
def test_other_thresholds(spark, percent):
    rows = corpus(6)[:170]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_duplicates.near_duplicates(frame, 2, percent)) == brute(rows, 2, percent)


def test_every_order_of_sets_shares_a_run_below_80():
    for union in range(1, 15):
        for gaps in range(1, 1 << union):
            missing = bin(gaps).count("1")
            if missing < union and 100 * (union - missing) >= 70 * union:
                assert max(map(len, bin(gaps)[2:].zfill(union).split("1"))) >= near_duplicates.run_length(70)


def test_sets_of_more_documents_than_a_bitmap_takes(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "FILTER_IDS", 3)
    rows = corpus(7)[:100]
    assert found(near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)) == brute(rows, 2)


def test_word_hashes():
    texts = ["A b\tC", "a B c", "ab c", "é É", "x" * 3000 + " y"]
    seen = defaultdict(set)
    for t in texts:
        for w, h in zip(words(t), shingles.word_hashes(t).tolist(), strict=True):
            seen[w].add(h)
    assert all(len(h) == 1 for h in seen.values()) and len(set().union(*seen.values())) == len(seen)


# -- vectors ------------------------------------------------------------------


def brute_vectors(rows, cosine=0.95):
    ids = [i for i, _ in rows]
    sound = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) and i is not None for i, v in rows]
    groups, links = Groups(i for i in ids if i is not None), [0] * len(rows)
    for x in range(len(rows)):
        for y in range(x):
            if sound[x] and sound[y] and len(rows[x][1]) == len(rows[y][1]):
                a, b = (np.array(rows[k][1], np.float64) / np.abs(rows[k][1]).max() for k in (x, y))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links[x] += 1
                    links[y] += 1
                    groups.tie(ids[x], ids[y])
    return sorted(str((i, n, None if i is None else groups.root(i), i is not None and groups.root(i) == i)) for i, n in zip(ids, links))


@pytest.mark.parametrize("window", [4, 128])
def test_vectors(spark, window):
    rng = np.random.default_rng(9)
    rows = []
    for size in [1] * 60 + [2] * 20 + [30, 90]:
        center = rng.standard_normal(16)
        rows += [(center + rng.standard_normal(16) * 0.04).tolist() for _ in range(size)]
    rows += [rows[3]] * 5 + [[0.0] * 16, None, [], [1.0] * 15 + [None], [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")], [1.0] * 8, [1.0] * 8, [1e-300] * 16, [1e200] * 16]
    rows = list(enumerate(rows)) + [(None, [1.0] * 16), (0, rows[0])]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, n_links string")
    out = embedding_duplicates.near_duplicate_vectors(frame, window=window).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in out) == brute_vectors(rows)


def test_windows_across_short_partitions(spark):
    """All vectors of one key in many partitions of a row or none: the windows go on from one to the next."""
    rng = np.random.default_rng(2)
    rows = (np.ones(8) + rng.standard_normal((30, 8)) * 0.01).tolist()
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    packed = embedding_duplicates.packed(frame, "vec_id", "embedding").selectExpr("0L pass", "dim", "0L key", "id", "data").repartition(64, "id").sortWithinPartitions("id")
    links = {frozenset((r.a, r.b)) for r in embedding_duplicates.window_links(packed, 3, 0.9).collect()}
    up = Groups(range(30))
    for a, b in map(sorted, links):
        up.tie(a, b)
    assert len({up.root(i) for i in range(30)}) == 1


def test_packed_vectors_are_exact():
    for x in ([0.5, 1.25, -3.0], [0.1, 1 / 3, 7e-9], [1e300, 1.0]):
        with np.errstate(over="ignore"):
            assert embedding_duplicates._unpacked(embedding_duplicates._packed(np.array(x))).tolist() == x


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_duplicates.near_duplicate_vectors(frame).count() == 0
    assert embedding_duplicates.near_duplicate_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first().n_links == 0


def cone(rng, n, planted, dim=64):
    """``n`` unit vectors of mutual cosine 0.9, and ``planted`` more, the i-th of cosine 0.952 with the i-th of them."""
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    axis = unit(rng.standard_normal(dim))
    around = rng.standard_normal((n, dim))
    members = np.sqrt(0.9) * axis + np.sqrt(0.1) * unit(around - around @ axis[:, None] * axis)
    side = rng.standard_normal((planted, dim))
    side = unit(side - (side * members[:planted]).sum(1, keepdims=True) * members[:planted])
    return np.vstack([members, 0.952 * members[:planted] + np.sqrt(1 - 0.952**2) * side])


@pytest.mark.parametrize("all_pairs", [0, 1 << 14])
def test_links_in_a_dense_cone(spark, monkeypatch, all_pairs):
    monkeypatch.setattr(embedding_duplicates, "ALL_PAIRS", all_pairs, raising=False)
    monkeypatch.setattr(embedding_duplicates, "RUN_BLOCK", 500, raising=False)
    rng = np.random.default_rng(1)
    rows = np.vstack([cone(rng, 2000, 300), rng.standard_normal((3700, 64))])
    frame = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<double>")
    component = {r.vec_id: r.component_id for r in embedding_duplicates.near_duplicate_vectors(frame, window=16).collect()}
    met = sum(component[i] == component[2000 + i] for i in range(300))
    assert met == 300 if all_pairs else met >= 297


def test_passes_follow_the_number_of_vectors():
    assert [embedding_duplicates.effort(n, 0.95) for n in (100, 50_000, 600_000, 77_000_000)] == [(0, 16), (10, 17), (14, 28), (21, 62)]
    assert embedding_duplicates.effort(50_000, 1.0) == (10, 16) and embedding_duplicates.effort(600_000, 0.95, 3)[1] == 3


def test_one_rule_for_signs_at_every_size(spark, monkeypatch):
    assert [embedding_duplicates.effort(n, 0.95)[0] for n in (0, 129, 130, 1000, 10_000, 16_384, 16_385)] == [0, 0, 2, 4, 8, 8, 9]
    assert embedding_duplicates.effort(50_000, -1.0) == (0, 16)  # links of opposite vectors, too
    used, run_links = [], embedding_duplicates.run_links
    monkeypatch.setattr(embedding_duplicates, "run_links", lambda reps, parts, passes, bits, window, cosine: used.append((passes, bits)) or run_links(reps, parts, passes, bits, window, cosine))
    rng = np.random.default_rng(5)
    rows = list(enumerate(np.vstack([cone(rng, 150, 40), rng.standard_normal((150, 64))]).tolist()))
    out = embedding_duplicates.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert used == [(16, 3)]
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in out) == brute_vectors(rows)

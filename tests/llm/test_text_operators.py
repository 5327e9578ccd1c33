from __future__ import annotations

import base64
import hashlib
import itertools
import json
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lattica.llm import language, mixing, order_minhash, quality, secrets, sentence_pieces

PIECES = public_tokenizers.path("piece_bpe_32k.model")
DATA, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def docs(spark, texts, ids=None):
    rows = [(i, t, "clash") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


# -- SentencePiece ------------------------------------------------------------


def test_pieces_as_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = sentence_pieces.ChunkTable(PIECES, limit=300)
    assert table.cuts
    rng = random.Random(2)
    texts = ["".join(rng.choice("  \n\t▁aAébthe日! \x00<s></s>") for _ in range(rng.randrange(30))) for _ in range(5000)] + ["", " ", "  ", "▁", " a", "a ", "long " * 20_000]
    for at in range(0, len(texts), 900):
        part = texts[at : at + 900]
        assert [x.tolist() for x in table.encode(part)] == [library.encode(t, add_bos=True, add_eos=True) for t in part]
    table.cuts = False  # the way for vocabularies that cross marks
    assert [x.tolist() for x in table.encode(texts[:50])] == [library.encode(t, add_bos=True, add_eos=True) for t in texts[:50]]


def test_piece_columns(spark):
    rows = sentence_pieces.encode_documents(docs(spark, ["a b", None, "", "a b"], [1, None, 3, 1]), PIECES, keep=("score",)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded, r.score) for r in rows) == [(0, 2, "", "clash"), (1, 4, "a b", "clash"), (1, 4, "a b", "clash"), (3, 2, "", "clash")]
    digests = sentence_pieces.encode_documents(docs(spark, ["a b"]), PIECES, ids=False, decoded=False, digests=True).first()
    assert digests.ids_sha256 == hashlib.sha256(np.array(rows[0].ids, "<u4").tobytes()).hexdigest()
    assert sentence_pieces.encode_documents(docs(spark, ["x"]).limit(0), PIECES).count() == 0


# -- secrets ------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(a, b, kind) for a, _, b, kind in sorted(spans)]


def test_base_spans_as_a_whole_search():
    rng = random.Random(3)
    bits = ["password", "Secret", "TOKEN", "api_key", "apikey", "passwd", "=", ":", " ", '"', "'", "AKIA", "AKIAAKIA", "0a1b2c3d" * 4, "abcdefgh", "é", "İ", "K", "ſecret", "x-y_z", "\n", "1234567", "akia"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert [s for s in secrets.find(text) if s[2] in ("assign", "access", "hex")] == base(text), text


def test_checksums():
    body = "A1b2" * 7 + "xY"
    good = "ghp_" + body + secrets.checksum62(body)
    bad = "ghp_" + body + ("a" if good[-1] != "a" else "b") * 6
    part = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    jwt = ".".join([part({"alg": "none"}), part({"sub": 1}), "sig"])
    assert secrets.find(f"x {good} y") == [(2, 42, "github")]
    assert secrets.find(f"x {bad} y") == []
    assert secrets.find(jwt) == [(0, len(jwt), "jwt")] and secrets.find("eyJhIjox.eyJh.x") == []
    assert secrets.find(None) == secrets.find("") == []
    assert secrets.cleaned(f"x {good} y password=abcdefgh1") == "x [github] y [assign]"
    long = "word " * 200_000 + good
    assert secrets.find(long) == [(1_000_000, 1_000_040, "github")]


@pytest.mark.parametrize("kind,head", [("RSA PRIVATE KEY", ""), ("RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n"), ("PGP PRIVATE KEY BLOCK", "Version: GnuPG v2.0 (a-b)\r\nComment: x,\n  carried on - here\n\n"), ("PGP PRIVATE KEY BLOCK", "\n")])
def test_private_keys_with_headers(kind, head):
    key = f"-----BEGIN {kind}-----\n{head}" + "MIIEowIBAAKC+/q1\n" * 9 + f"=aB3d\n-----END {kind}-----"
    assert secrets.cleaned(f"before {key} after") == "before [pem] after"
    assert secrets.find(key.replace("MIIE", "M.I,")) == []
    assert not any(kind == "pem" for _, _, kind in secrets.find(f"-----BEGIN {kind}-----\n" + "  a-b: c, d\n  e - f\n" * 5000))


@pytest.mark.parametrize("text", ["eyJ" * 1_000_000, "eyJ.eyJ" * 200_000, "X: -----BEGIN PRIVATE KEY-----\n" * 50_000, "-----BEGIN " * 200_000, "password" * 300_000, "AKIA" * 500_000])
def test_time_is_linear(text):
    began = time.perf_counter()
    secrets.find(text)
    assert time.perf_counter() - began < 6


def test_runs_that_fail_hide_nothing():
    """Skipping what a failed match has read over finds what trying every hit finds."""
    rng = random.Random(7)
    part = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    bits = ["eyJ", "eyJhIjox", ".", part({"a": 1}), part({"b": 2}) + ".x", " ", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "\n", "A: b\n", "abcd", " c: d\n", "\tx\n"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        for kind, word in (("jwt", "eyJ"), ("pem", "-----BEGIN ")):
            plain, past = [], 0
            for m in re.finditer(re.escape(word), text):
                if m.start() >= past and (found := secrets.PATTERNS[kind].match(text, m.start())):
                    past = found.end()
                    plain += [(m.start(), past, kind)] * secrets.holds(kind, found)
            assert [s for s in secrets.find(text) if s[2] == kind] == plain, text


def test_secret_columns(spark):
    clash = spark.createDataFrame([(1, "token = abcdefgh", 5, "x", "y")], "doc_id long, text string, n_assign int, spans string, found string")
    assert secrets.scan(clash, digests=True).columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert secrets.redact(clash).first() == (1, "[assign]", 5, "x", "y")
    rows = docs(spark, ["token = abcdefgh", None, "", "token = abcdefgh"], [1, 2, None, 1])
    found = secrets.scan(rows, digests=True)
    assert sorted((r.doc_id or 0, r.n_assign, r.spans) for r in found.collect()) == [(0, 0, ""), (1, 1, "assign:0:16"), (1, 1, "assign:0:16"), (2, 0, "")]
    assert [len(r.found) for r in secrets.scan(rows).collect()] == [1, 0, 0, 1]
    assert sorted(str(r.text) for r in secrets.redact(rows).collect()) == ["", "None", "[assign]", "[assign]"]
    assert secrets.scan(rows.limit(0)).count() == 0


# -- quality and language -----------------------------------------------------


def test_quality_held_out(spark):
    from lattica.llm.queries import op2_quality

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = op2_quality(spark, DATA).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    marked = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in marked]) > 0.95


def test_quality_edges(spark):
    texts = ["Some plain words of text here. More of them.", None, "", "!!" * 20_000, "A " * 50]
    stats = quality.document_statistics(docs(spark, texts, [1, 2, None, 4, 1]))
    labels = spark.createDataFrame([(1, 1), (4, 0), (2, None), (9, 1), (4, 7)], "doc_id long, quality int")
    model = quality.fit(stats, labels)
    assert quality.Discriminant.from_json(model.to_json()).prior == model.prior
    assert all(0 <= r.score <= 1 for r in quality.score(stats, model).collect())
    one = quality.fit(stats, labels.filter("quality = 1"))
    assert {r.score for r in quality.score(stats, one).collect()} == {1.0}
    none = quality.fit(stats, labels.limit(0))
    assert {r.score for r in quality.score(stats, none).collect()} == {0.5}
    kept = quality.score_documents(docs(spark, texts), model)
    assert kept.columns == ["doc_id", "text", "score", quality.SCORE] and kept.count() == 5
    assert quality.score(stats.limit(0), model).count() == 0


def test_language_held_out(spark):
    from lattica.llm.queries import op3_language

    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = [r for r in op3_language(spark, DATA).collect() if r.held_out]
    assert np.mean([r.lang_pred == known[r.doc_id] for r in rows]) > 0.93


def test_language_edges(spark):
    training = spark.createDataFrame([("the cat and the dog went to the house " * 5, "en"), ("le chat et le chien sont dans la maison " * 5, "fr"), ("x", None), (None, "en")], "text string, lang string")
    contents = language.dictionaries(training)
    assert set(contents) == {"en", "fr"}
    rows = docs(spark, ["the dog and the cat in the house", "la maison et le chien", None, "", "123 !?", "the dog " * 30_000], [1, 2, 3, None, 5, 6])
    found = {r.doc_id: r for r in language.classify(rows, contents).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, None, 5, 6)] == ["en", "fr", "und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in found.values()) and not found[3].confident
    assert {r.lang_pred for r in language.classify(rows, {}).collect()} == {"und"}
    assert language.dictionaries(training.limit(0)) == {}


def test_language_samples_different_texts(spark):
    copies = [(f"Only text number {i} of its language", f"l{i}") for i in range(5) for _ in range(1000)]
    contents = language.dictionaries(spark.createDataFrame(copies, "text string, lang string"), sample_docs=2)
    assert contents == {f"l{i}": f"only text number {i} of its language".encode() for i in range(5)}
    # whole texts are learned from: past a long shared beginning, up to the end
    header = "the licence text in front " * 40
    bodies = spark.createDataFrame([(header + f"own{i} " * 400 + f"end{i}.", "en") for i in range(60)], "text string, lang string")
    learned = language.dictionaries(bodies)["en"]
    assert sum(f"own{i} ".encode() in learned for i in range(60)) == 60 and sum(f"end{i}.".encode() in learned for i in range(60)) == 60
    some = language.dictionaries(bodies, sample_docs=5)["en"]
    assert sum(f"end{i}.".encode() in some for i in range(60)) == 5


def test_language_as_a_plain_loop(spark):
    """Every dictionary tried on every text, at both levels, without the operator's classes."""
    import zstandard as z

    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    contents = language.dictionaries(rows.filter(quality.fold(rows["doc_id"]) != 0))
    assert all(c == c.lower() for c in contents.values()) and all(len(c) <= 48 << 10 for c in contents.values())

    def size(text, lang, level):
        d = z.ZstdCompressionDict(contents[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        c = z.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        data = text.lower().encode()
        return sum(len(c.compress(data[i : i + 4096])) for i in range(0, len(data), 4096))

    found = {r.doc_id: r for r in language.classify(rows, contents).collect()}
    for r in rows.limit(60).collect():
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            assert found[r.doc_id].lang_pred == "und"
            continue
        for level in (6, 12):
            sizes = [size(r.text, lang, level) for lang in contents]
            best, second = sorted(sizes)[:2]
            if second - best >= 0.02 * best:
                break
        assert found[r.doc_id].lang_pred == list(contents)[sizes.index(best)] and found[r.doc_id].confident == (second - best >= 0.02 * best)


def test_language_tie_goes_to_the_first():
    same = b"one text that both languages have " * 20
    both = language.Compressors({"b": same, "a": same})
    assert both.classify("one text that both languages have", 0.02) == ("b", 0.5, False)


def test_quality_as_plain_numpy(spark):
    """The discriminant from its definition: inverses and determinants of shrunk covariances."""
    from lattica.llm.queries import op2_quality

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    x = {i: np.array(quality.statistics(t)) for i, t in texts.items()}
    marks = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    of = {y: np.array([x[i] for i, q in marks if q == y and i in x]) for y in (0, 1)}
    cov = {y: np.cov(of[y].T, bias=True) for y in of}
    n = {y: len(of[y]) for y in of}
    pooled = sum(n[y] * cov[y] for y in of) / sum(n.values())

    def density(v, y):
        s = 0.9 * cov[y] + 0.1 * pooled
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 1e-4 * np.eye(len(s))
        d = v - of[y].mean(0)
        return np.log(n[y]) - (d @ np.linalg.inv(s) @ d + np.linalg.slogdet(s)[1]) / 2

    rows = op2_quality(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        gap = np.clip(density(x[r.doc_id], 1) - density(x[r.doc_id], 0), -500, 500)
        assert r.score == pytest.approx(1 / (1 + np.exp(-gap)), abs=1e-6) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


# -- order min-hash -----------------------------------------------------------


def brute_tuples(text, k=order_minhash.K):
    """The fingerprint from sorting all numbered k-mers in every order."""
    if not text:
        return [0] * order_minhash.HASHES
    k = min(k, len(text))
    words = [text[i : i + k] for i in range(len(text) - k + 1)]
    kmer = order_minhash.kmers(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    assert len(kmer) == len(words) and len(set(zip(words, kmer.tolist()))) == len(set(words)) == len(set(kmer.tolist()))
    seen, number = {}, []
    for w in words:
        number.append(seen.get(w, 0))
        seen[w] = number[-1] + 1
    base = (order_minhash.mixed(kmer + np.array(number, np.uint32) * order_minhash.MIX[0]) >> np.uint64(32)).astype(np.uint32)
    out = []
    for a, b in zip(order_minhash.SHIFT[:, 0], order_minhash.FACTOR[:, 0]):
        order = np.argsort((base ^ a) * b, kind="stable")[:2]
        first, second = kmer[sorted(order)[0]], kmer[sorted(order)[1]] if len(order) > 1 else np.uint64(1)
        out.append(int(order_minhash.mixed(np.array([first * order_minhash.MIX[0] + second]))[0] >> np.uint64(48)))
    return out


@pytest.mark.parametrize("text", ["", "a", "short", "abc" * 30, "The quick brown fox jumps over the lazy dog. " * 3, "é日" * 9 + "x" * 5000])
def test_fingerprint(text):
    with np.errstate(over="ignore"):
        assert order_minhash.fingerprint(text).tolist() == brute_tuples(text)


def test_order_counts():
    rng = random.Random(5)
    blocks = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(12)]
    a, moved = "".join(blocks), "".join(blocks[::-1])
    edited = a[:300] + "X" + a[301:]
    sign = order_minhash.fingerprint
    assert order_minhash.likeness(sign(a), sign(a)) == 1
    assert order_minhash.likeness(sign(a), sign(edited)) > order_minhash.likeness(sign(a), sign(moved)) + 0.2


@pytest.mark.parametrize("n", [0, 1, 2, 37])
def test_edit_likeness(spark, n):
    rng = random.Random(n)
    rows = [(i if i else None, "".join(rng.choice("abcé 日") for _ in range(rng.randrange(60))) if i % 5 else None) for i in range(n)] + [(7, "again")] * (2 if n > 9 else 0)
    found = order_minhash.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(((-(2**63) if i is None else i, t or "") for i, t in rows), reverse=True)
    expected = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        e = order_minhash.edited(t, u)
        s = order_minhash.fingerprint
        expected.append((None if i == -(2**63) else i, len(t), hashlib.sha256(e.encode()).hexdigest(), order_minhash.hexed(s(t)), order_minhash.likeness(s(t), s(e)), order_minhash.likeness(s(t), s(u))))
    assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in found))) == sorted(map(str, expected))


# -- mixing -------------------------------------------------------------------


def test_word_counts(spark):
    texts = ["a b", None, "", " x ", "y", "\t\n", "é日 b\u00a0c", "end ", "a\x0bb\x0cc\rd\x1ce"]
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    sizes = {r.doc_id: r.size for r in mixing.sized(frame, F.array("source"), 1).collect()}
    assert sizes == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


def test_shares():
    got = mixing.shares({"a": 10, "b": 1000, "c": 0, None: 5}, mixing.numbered_weights({"a", "b", "c", None}))
    assert got["a"] == 30 and got["c"] == 0 and got[None] == 15 and sum(got.values()) == pytest.approx(1015)
    assert mixing.numbered_weights({"b", None, "a"}) == {"a": 1, "b": 2, None: 3}


def brute_cost(patterns, quotas, repeats):
    """Least cost among the greatest flows, by trying all whole assignments."""
    options = []
    for p, words in patterns.items():
        spots = [s for s in p if s in quotas]
        options.append([c for c in itertools.product(range(repeats * words + 1), repeat=len(spots)) if sum(c) <= repeats * words] or [()])
    found = {}
    for choice in itertools.product(*options):
        got, cost = dict.fromkeys(quotas, 0), 0
        for (p, words), c in zip(patterns.items(), choice):
            for s, x in zip([s for s in p if s in quotas], c):
                got[s] += x
            cost += sum(max(0, min(words, sum(c) - r * words)) * r * (r + 1) // 2 for r in range(repeats))
        if all(got[s] <= quotas[s] for s in quotas):
            total = sum(got.values())
            found[total] = min(found.get(total, 10**9), cost)
    return max(found), found[max(found)]


@pytest.mark.parametrize("patterns,quotas", [({("a",): 2, ("a", "b"): 2, ("b",): 1}, {"a": 3, "b": 5}), ({("a", "b"): 3}, {"a": 2, "b": 9}), ({("a",): 1, ("b", "c"): 2}, {"a": 5, "b": 1, "c": 2})])
def test_flow_is_the_cheapest(patterns, quotas):
    given = mixing.least_cost_flow(patterns, quotas, 3)
    cost = sum(max(0, min(w, given[p] - r * w)) * r * (r + 1) // 2 for p, w in patterns.items() for r in range(3))
    assert (sum(given.values()), cost) == brute_cost(patterns, quotas, 3)


def test_sources_alone_need_no_flow():
    patterns = {("a",): 5, ("b",): 4, ("c",): 7, ("b", "d"): 6, (None,): 3, (): 2}
    quotas = {"a": 9, "b": 8, "c": 30, "d": 5, None: 2}
    assert mixing.given_words(patterns, quotas, 3) == mixing.least_cost_flow(patterns, quotas, 3)


def test_mix_of_many_sources(spark):
    frame = spark.range(10_050).selectExpr("id doc_id", "repeat('w ', 5) text", "concat('s', id) source")
    out, sizes, targets = mixing.mix(frame, F.array("source"))
    got = {r.sources[0]: r.size * r.times for r in out.collect()}
    assert len(got) == len(sizes) == 10_050
    assert all(abs(got[s] - target) <= 5 for s, target in targets.items())


def test_flow_over_many_patterns():
    rng = random.Random(8)
    names = [f"s{i}" for i in range(60)]
    patterns = {tuple(sorted(rng.sample(names, rng.choice([2, 3])))): rng.randrange(1, 50) for _ in range(20_000)}
    quotas = {s: rng.randrange(1, 30_000) for s in names}
    given = mixing.least_cost_flow(patterns, quotas, 3)
    assert all(0 <= given[p] <= 3 * n for p, n in patterns.items())
    assert sum(given.values()) == min(sum(quotas.values()), 3 * sum(patterns.values()))


def test_rows_without_ids_are_spread(spark):
    frame = spark.range(500).selectExpr("cast(null as long) doc_id", "concat('w ', id) text", "'s' source")
    assert mixing.sized(frame, F.array("source"), 1).select("place").distinct().count() == 500


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(40))), rng.choice(["a", "b", "c", None])) for i in range(800)] + [(None, None, "a"), (3, "dup dup", "a"), (3, "dup dup", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("times", F.lit("clash"))
    out, sizes, targets = mixing.mix(frame, F.array("source"))
    found = out.collect()
    assert len(found) == len(rows) and all(0 <= r.times <= 3 for r in found)
    taken = {}
    for r in found:
        taken[r.sources[0]] = taken.get(r.sources[0], 0) + r.size * r.times
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 20, (s, taken[s], target)
    again = mixing.mix(frame.repartition(3), F.array("source"))[0].collect()
    assert sorted((str(r.doc_id), r.size, r.times) for r in again) == sorted((str(r.doc_id), r.size, r.times) for r in found)
    kept, _, _ = mixing.mix(frame, F.array("source"), keep=True)
    assert kept.select("row.*").columns == frame.columns
    none, _, _ = mixing.mix(frame.limit(0), F.array("source"))
    assert none.count() == 0


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i % 3 else ["a", "b"]) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    out, sizes, targets = mixing.mix(frame, F.col("sources"), weights=lambda s: {"a": 1, "b": 3})
    assert sizes == {"a": 3000, "b": 1000} and sum(targets.values()) == pytest.approx(4000)
    got = {tuple(r.sources): r.n for r in out.groupBy("sources").agg(F.sum(F.col("size") * F.col("times")).alias("n")).collect()}
    assert abs(sum(got.values()) - 4000) <= 20 and got["a", "b"] >= 2980


# -- the registered queries over whole small tables ---------------------------


def test_registered_queries(spark):
    """op1, op5, op6, op7, op8 and op10 against the libraries and plain Python."""
    import sentencepiece
    from tokenizers import Tokenizer

    from lattica.llm import queries

    rows = [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows.sort()
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, expected = 0, {}
    for i, text, _ in rows:
        ids = [*bpe.encode(text, add_special_tokens=False).ids, 2]
        expected[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_token_binary(spark, SMALL).collect()} == expected
    bpe.encode_special_tokens = True
    assert {r.doc_id: r.n_tokens for r in queries.op10_token_counts(spark, SMALL).collect()} == {i: len(bpe.encode(t, add_special_tokens=False).ids) + 1 for i, t, _ in rows}
    pieces, got = sentencepiece.SentencePieceProcessor(model_file=PIECES), {r.doc_id: r for r in queries.op7_sentencepiece(spark, SMALL).collect()}
    for i, text, _ in rows:
        ids = pieces.encode(text, add_bos=True, add_eos=True)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(pieces.decode(ids).encode()))
    got = {r.doc_id: r for r in queries.op8_secrets(spark, SMALL).collect()}
    for i, text, _ in rows:
        spans = base(text)
        line = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == kind for _, _, k in spans) for kind in ("assign", "access", "hex"))
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest() and set(filter(None, line.split(","))) <= set(got[i].spans.split(","))
    got, sign = {r.doc_id: r for r in queries.op5_fingerprint(spark, SMALL).collect()}, order_minhash.fingerprint
    down = rows[::-1]
    for (i, text, _), (_, following, _) in list(zip(down, down[1:] + down[:1]))[::7]:
        other = order_minhash.edited(text, following)
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(other.encode()).hexdigest())
        assert got[i].near_edited == order_minhash.likeness(sign(text), sign(other)) and got[i].near_next == order_minhash.likeness(sign(text), sign(following))
    got = {r.doc_id: r for r in queries.op6_mixing(spark, SMALL).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    of = {s: sum(size[i] for i, _, x in rows if x == s) for s in {x for _, _, x in rows}}
    targets = mixing.shares(of, mixing.numbered_weights(of))
    for i, _, s in rows:
        assert (got[i].size, got[i].source_size, got[i].target) == (size[i], of[s], pytest.approx(targets[s])) and got[i].taken <= 3 * size[i] and (not size[i] or got[i].taken % size[i] == 0)
    for s, target in targets.items():
        assert abs(sum(got[i].taken for i, _, x in rows if x == s) - target) <= max(size.values())


def test_edit_likeness_of_odd_tables(spark):
    rows = [(1, "x " * 300_000, "c"), (None, None, "c"), (None, "a", "c"), (1, "y", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").withColumn("bucket", F.lit(1)).withColumn("halo", F.lit("h"))
    found = order_minhash.edit_likeness(frame).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in found) == [("1", 1), ("1", 600_000), ("None", 0), ("None", 1)]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)

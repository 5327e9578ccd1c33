from __future__ import annotations

import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest

from lattica.llm import bpe, rans, token_files
from lattica.storage import new_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Hello, world. It's fine.", None, "", " \n\t lead and trail \n", "a b  c", "日本語 text — ok", "<|endoftext|> inside", "word " * 3000, "same text", "same text"]


def docs(spark, texts=TEXTS):
    rows = [(i if i != 4 else None, t, "x", 1, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens int, ids_crc32 string")


def library(texts, plain=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = plain
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("plain", [False, True])
def test_chunks_encode_as_the_library(plain):
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \n\t\r.,'aAé1日! \x0b 's<|endoftext|>") for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += [t or "" for t in TEXTS]
    own = bpe.ChunkEncoder(BPE, plain, limit=500)  # a full table, too
    for at in range(0, len(texts), 700):
        part = texts[at : at + 700]
        ids, counts = own.encode(part)
        expected = library(part, plain)
        assert counts.tolist() == [len(x) for x in expected]
        assert ids.tolist() == sum(expected, [])


def test_known_chunks_make_no_objects():
    own, text, alive = bpe.ChunkEncoder(BPE), "some words of a text\n" * 10_000, []
    own.encode([text])
    gather = own.gather
    own.gather = lambda index: alive.append(sys.getallocatedblocks()) or gather(index)
    before = sys.getallocatedblocks()
    own.encode([text])
    assert alive[0] - before < 5000  # of 50,000 chunks


def test_chunks_of_every_length_encode_as_the_library():
    """Around the 16 bytes that the table holds itself, with zero bytes, and so many that it grows."""
    rng = random.Random(7)
    texts = ["", "\0", "a\0", "a", "a\0\0 a\0 a", " " * 40, "x" * 70, " " * 16 + "x", "x,", ".", "é,", "1,", "日."]
    texts += [" ".join(end * n + tail for n in range(20) for tail in ("", ",", "\0", "é.")) for end in ("a", "é", "日", "1")]
    texts += [" ".join("".join(rng.choices("abdeiorst", k=7)) for _ in range(4000)) for _ in range(12)]
    own = bpe.ChunkEncoder(BPE)
    for _ in range(2):
        for part in (texts[:20], texts[20:]):
            ids, counts = own.encode(part)
            expected = library(part)
            assert counts.tolist() == [len(x) for x in expected] and ids.tolist() == sum(expected, [])
    assert len(own.table.entry) > 1 << 16


@pytest.mark.parametrize("n", [1, 2, 255, 257, 5000, rans.BLOCK])
def test_coder_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_000).astype(np.uint32)
    table, symbols = rans.Table.of(ids)
    assert table.freq.sum() == 1 << table.bits
    states, words = table.encode(symbols)
    assert (table.decode(n, states, words) == ids).all()


def test_shards_round_trip(spark):
    manifest = token_files.write_shards(docs(spark), new_path(spark, "t"), BPE, 2)
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_shards(manifest).collect())
    order = sorted(range(len(TEXTS)), key=lambda i: -1 if i == 4 else i)  # a null id sorts first
    start, expected = 0, []
    for i, ids in zip(order, library([TEXTS[i] for i in order])):
        ids = [*ids, 2]
        expected.append((start, None if i == 4 else i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found == expected
    blocks = token_files.read_blocks(manifest).collect()
    assert sum(len(r.ids) for r in blocks) == start


def test_shards_are_cut_by_ids(spark):
    many = docs(spark, ["some words here"] * 40 + [None, ""]).coalesce(1)
    manifest = token_files.write_shards(many, new_path(spark, "c"), BPE, 2, shard_ids=1)
    assert manifest.count() > 1 and manifest.agg({"n_docs": "sum"}).first()[0] == 42
    found = sorted((r.start, r.n_tokens) for r in token_files.read_shards(manifest).collect())
    assert found[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:]))


def test_a_document_in_many_blocks_is_put_together(spark, tmp_path):
    ids = np.random.default_rng(3).integers(0, 300, 3 * rans.BLOCK + 17).astype(np.uint32)
    counts = np.array([10, len(ids) - 30, 20])
    file = tmp_path / "m.rans"
    file.write_bytes(b"".join(token_files.pack_shard(np.array([1, 2, 3]), np.array([1, 1, 0]), counts, ids)))
    manifest = spark.createDataFrame([(5, f"file://{file}", 3, len(ids), 4)], "shard long, file string, n_docs long, n_tokens long, n_blocks long")
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_shards(manifest).collect()}
    ends = np.cumsum(counts)
    assert found == {name: (e - n, n, zlib.crc32(ids[e - n : e].astype("<u4").tobytes())) for name, n, e in zip((1, 2, None), counts.tolist(), ends.tolist())}


def test_checksums_join():
    rng = random.Random(4)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(90)), rng.randbytes(rng.randrange(5000))
        assert token_files.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_a_changed_block_is_noticed(spark, tmp_path):
    ids = np.arange(5000, dtype=np.uint32) % 97
    parts = b"".join(token_files.pack_shard(np.array([1]), np.array([1]), np.array([5000]), ids))
    file = tmp_path / "a.rans"
    file.write_bytes(parts)
    assert (token_files.Shard(f"file://{file}").read_block(0) == ids).all()
    file.write_bytes(parts[:-3] + bytes([parts[-3] ^ 1]) + parts[-2:])
    with pytest.raises(ValueError):
        token_files.Shard(f"file://{file}").read_block(0)


def test_blocks_of_a_long_document_decode_apart(spark, tmp_path):
    ids = np.random.default_rng(1).integers(0, 300, 2 * rans.BLOCK + 17).astype(np.uint32)
    file = tmp_path / "b.rans"
    file.write_bytes(b"".join(token_files.pack_shard(np.array([1, 2]), np.array([1, 1]), np.array([len(ids) - 5, 5]), ids)))
    shard = token_files.Shard(f"file://{file}")
    assert (shard.read_block(2) == ids[2 * rans.BLOCK :]).all()
    a, b = shard.documents()
    assert (a == ids[:-5]).all() and (b == ids[-5:]).all()


def test_separator_scan(spark):
    order = token_files.write_flat(docs(spark), new_path(spark, "f"), BPE, 50256)
    counted = token_files.scan_flat(order.select("file"), 50256, block_bytes=64)  # documents lie over many blocks
    found = {(r.doc_id, r.n_tokens, r.closed) for r in order.join(counted, ["file", "seq"]).collect()}
    assert found == {(None if i == 4 else i, len(x) + 1, True) for i, x in enumerate(library(TEXTS, plain=True))}


def test_unclosed_last_document(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(np.array([5, 6, 9, 9, 7, 8, 8], "<u2").tobytes())
    files = spark.createDataFrame([(f"file://{tmp_path}/x.bin",)], "file string")
    for size in (2, 4, 6, 1024):
        found = sorted((r.seq, r.start, r.n_tokens, r.closed) for r in token_files.scan_flat(files, 9, block_bytes=size).collect())
        assert found == [(0, 0, 3, True), (1, 3, 1, True), (2, 4, 3, False)]


def test_no_documents(spark):
    none = docs(spark).limit(0)
    assert token_files.read_shards(token_files.write_shards(none, new_path(spark, "e"), BPE, 2)).count() == 0
    assert token_files.scan_flat(token_files.write_flat(none, new_path(spark, "e"), BPE, 50256).select("file"), 50256).count() == 0

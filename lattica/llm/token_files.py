"""Token ids in files: entropy-coded shards, and flat files that are scanned for separators.

Coded shard (``write_shards``, ``read_shards``): little-endian, files that follow
each other in ascending id order, cut by their number of ids::

    magic "LRNS0001" | u64 header length | header (JSON) | tables | blocks

The header gives counts, the lanes' checkpoint and the place, number of ids and
CRC-32 of each block; the tables hold the alphabet and its frequencies, shared
by the shard's blocks, and each document's id and number of ids. Any block is
decoded alone (``read_block``), and readers decode all blocks in parallel.

Flat file (``write_flat``, ``scan_flat``): only ids, each document closed by the
separator, no index.

Null texts count as empty; an empty text is just its end id. Rows that repeat
are documents of their own. A null doc_id sorts first. Empty input makes no
files and no rows. Columns besides the two named are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .bpe import encoder
from .common import column, file_system, new_path, sliced, stored

MAGIC = b"LRNS0001"
HEAD = len(MAGIC) + 8
#: Ids after which a shard is closed, and bytes of input that make a range of documents of their own.
SHARD_IDS, RANGE_BYTES = 1 << 24, 1 << 30
#: Shards of one range are numbered within this many.
SHARDS = 1 << 24
#: Blocks that a task decodes one after the other, with one reading of their shard's tables; partitions at most.
TASK_BLOCKS, MOST_TASKS = 4, 20_000


def _write(path: str, parts: list[bytes]) -> None:
    """Writes under another name and renames, so a lost task leaves no half file."""
    files, at = file_system(path)
    files.create_dir(at.rpartition("/")[0], recursive=True)
    with files.open_output_stream(at + ".part") as out:
        for part in parts:
            out.write(part)
    files.move(at + ".part", at)


def pack_shard(doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The parts of a coded shard. ``known``: 0 where the doc_id is null."""
    table, symbols = rans.Table.of(ids)
    tables = [table.alphabet.astype("<u4").tobytes(), table.freq.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(), known.astype("u1").tobytes(), counts.astype("<i8").tobytes()]
    blocks, payload, at = [], [], 0
    for first in range(0, len(ids), rans.BLOCK):
        part = symbols[first : first + rans.BLOCK]
        states, words = table.encode(part)
        data = states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
        blocks.append({"at": at, "lanes": len(states), "words": len(words), "first": first, "n": len(part), "crc32": zlib.crc32(data)})
        payload.append(data)
        at += len(data)
    header = json.dumps({"symbols": len(table.alphabet), "docs": len(doc_ids), "tokens": len(ids), "blocks": blocks}).encode()
    return [MAGIC, len(header).to_bytes(8, "little"), header, *tables, *payload]


class Shard:
    """A coded shard open for reading."""

    def __init__(self, path: str):
        files, at = file_system(path)
        self.file = files.open_input_file(at)
        head = self.file.read_at(HEAD, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is no coded shard")
        size = int.from_bytes(head[len(MAGIC) :], "little")
        self.header = json.loads(self.file.read_at(size, HEAD))
        symbols, docs = self.header["symbols"], self.header["docs"]
        raw = memoryview(self.file.read_at(8 * symbols + 17 * docs, HEAD + size))
        self.table = rans.Table(np.frombuffer(raw[: 4 * symbols], "<u4"), np.frombuffer(raw[4 * symbols : 8 * symbols], "<u4"))
        raw = raw[8 * symbols :]
        self.doc_ids, self.known, self.counts = np.frombuffer(raw[: 8 * docs], "<i8"), np.frombuffer(raw[8 * docs : 9 * docs], "u1"), np.frombuffer(raw[9 * docs :], "<i8")
        self.base = HEAD + size + 8 * symbols + 17 * docs

    def read_block(self, k: int) -> np.ndarray:
        """The ids of block ``k``, decoded from its own checkpoint; raises if its checksum differs."""
        block = self.header["blocks"][k]
        data = self.file.read_at(8 * block["lanes"] + 4 * block["words"], self.base + block["at"])
        if zlib.crc32(data) != block["crc32"]:
            raise ValueError(f"checksum of block {k} differs")
        states = np.frombuffer(data, "<u8", block["lanes"])
        return self.table.decode(block["n"], states, np.frombuffer(data, "<u4", offset=states.nbytes))

    def documents(self) -> Iterator[np.ndarray]:
        """Each document's ids; a document may lie in many blocks."""
        held, have, k = [], 0, 0
        for count in self.counts.tolist():
            while have < count:
                held.append(self.read_block(k))
                have, k = have + len(held[-1]), k + 1
            ids = held[0] if len(held) == 1 else np.concatenate(held) if held else np.zeros(0, np.uint32)
            yield ids[:count]
            held, have = [ids[count:]], have - count


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, plain: bool = False) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids, ids with an end id after each document, numbers of ids) of runs of rows."""
    bpe = encoder(vocabulary, plain)
    for batch in sliced(batches, 1, 1 << 18):
        ids, counts = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
        yield batch.column(0).to_pylist(), np.insert(ids, np.cumsum(counts), end_id), counts + 1


def ranges_of(docs: DataFrame) -> int:
    """Ranges that the documents are dealt to: as many as shuffle partitions, and more where the files are large."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # the planner's word for a size that it cannot tell is about 2**63
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES) if known else 1)


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes the texts and writes coded shards under ``path`` in ascending id order.

    Returns the manifest, one row per shard: shard, file, n_docs, n_tokens,
    n_blocks. A task walks a range of the documents and closes a shard after the
    document with which it holds ``shard_ids`` ids, so it never holds more than
    those (2 or 4 bytes each, 4 more as symbols, and their code) and a document.
    Rows of one id are ordered by text and never parted, so a range is as large as its largest id.
    """

    def write(batches):
        doc_ids, ids, counts, held, seq = [], [], [], 0, 0
        part = TaskContext.get().partitionId()

        def closed():
            file = f"{path}/shard-{part:06d}-{seq:06d}-{TaskContext.get().taskAttemptId()}.rans"
            known = np.array([x is not None for x in doc_ids], np.uint8)
            flat = np.concatenate(ids)
            _write(file, pack_shard(np.array([x or 0 for x in doc_ids], np.int64), known, np.concatenate(counts), flat))
            return pa.RecordBatch.from_pydict({"shard": [part * SHARDS + seq], "file": [file], "n_docs": [len(doc_ids)], "n_tokens": [len(flat)], "n_blocks": [-(-len(flat) // rans.BLOCK)]})

        for names, found, n in _encoded(batches, vocabulary, end_id):
            doc_ids += names
            ids.append(found.astype(np.uint16) if found.max(initial=0) < 1 << 16 else found)
            counts.append(n)
            held += len(found)
            if held >= shard_ids:
                yield closed()
                doc_ids, ids, counts, held, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield closed()

    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(ranges_of(rows), "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(rows.mapInArrow(write, "shard long, file string, n_docs long, n_tokens long, n_blocks long"), "manifest")


def crc_joined(first: int, then: int, size: int) -> int:
    """CRC-32 of two runs of bytes from those of each; the second has ``size`` bytes.

    The first is multiplied by x**(8 * size), modulo the polynomial of the checksum.
    """

    def times(a: int, b: int) -> int:
        out, bit = 0, 1 << 31
        while bit:
            if a & bit:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
            bit >>= 1
        return out

    power, square, n = 1 << 31, 1 << 30, 8 * size
    while n:
        if n & 1:
            power = times(power, square)
        square, n = times(square, square), n >> 1
    return times(power, first) ^ then


def read_shards(manifest: DataFrame) -> DataFrame:
    """Decodes the shards: doc_id, start (ids before it in all shards), n_tokens, ids_crc32.

    Every block is a row of work of its own, decoded from its checkpoint. A document
    in several blocks gives a piece in each, whose checksums are then joined. The
    manifest has one row per file; only that is summed in one place.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file", "shard", "n_blocks", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    blocks = placed.select("file", "shard", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    total = manifest.agg(F.sum("n_blocks")).first()[0] or 1

    def read(batches):
        opened, shard = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != opened:
                    opened, shard = row["file"], Shard(row["file"])
                low, ids = shard.header["blocks"][row["block"]]["first"], shard.read_block(row["block"]).astype("<u4")
                ends = np.cumsum(shard.counts)
                starts = ends - shard.counts
                own = np.arange(np.searchsorted(ends, low, "right"), np.searchsorted(starts, low + len(ids), "left"))
                first, last = np.maximum(starts[own], low), np.minimum(ends[own], low + len(ids))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((first - low).tolist(), (last - low).tolist())]
                yield pa.RecordBatch.from_pydict({"shard": np.full(len(own), row["shard"]), "doc": own, "doc_id": pa.array(shard.doc_ids[own], mask=shard.known[own] == 0), "start": row["base"] + starts[own], "n_tokens": shard.counts[own], "first": first, "n": last - first, "crc": np.array(crc, np.int64)})

    def joined(batches):
        now = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if now and (now["shard"], now["doc"]) == (row["shard"], row["doc"]):
                    now["crc"] = crc_joined(now["crc"], row["crc"], 4 * row["n"])
                    continue
                done += [now] if now else []
                now = row
            if done:
                yield finished(done)
        if now:
            yield finished([now])

    def finished(rows):
        return pa.RecordBatch.from_pydict({to: pa.array([r[c] for r in rows], pa.int64()) for c, to in (("doc_id", "doc_id"), ("start", "start"), ("n_tokens", "n_tokens"), ("crc", "ids_crc32"))})

    dealt = blocks.repartitionByRange(min(-(-total // TASK_BLOCKS), MOST_TASKS), "shard", "block").sortWithinPartitions("shard", "block")
    pieces = stored(dealt.mapInArrow(read, "shard long, doc long, doc_id long, start long, n_tokens long, first long, n long, crc long"), "pieces")
    whole = pieces.filter("n = n_tokens").select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))
    parts = pieces.filter("n < n_tokens").repartition("shard", "doc").sortWithinPartitions("shard", "doc", "first")
    return whole.unionByName(parts.mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def read_blocks(manifest: DataFrame) -> DataFrame:
    """Decodes every block on its own, from its checkpoint: shard, block, first, ids."""

    def places(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = len(Shard(row["file"]).header["blocks"])
                yield pa.RecordBatch.from_pydict({"shard": pa.array([row["shard"]] * n, pa.int64()), "file": pa.array([row["file"]] * n, pa.string()), "block": pa.array(range(n), pa.int64())})

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["file"])
                ids = shard.read_block(row["block"])
                yield pa.RecordBatch.from_pydict({"shard": pa.array([row["shard"]], pa.int64()), "block": pa.array([row["block"]], pa.int64()), "first": [shard.header["blocks"][row["block"]]["first"]], "ids": pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))})

    blocks = manifest.select("shard", "file").mapInArrow(places, "shard long, file string, block long")
    return blocks.repartition("shard", "block").mapInArrow(read, "shard long, block long, first long, ids array<long>")


def write_flat(docs: DataFrame, path: str, vocabulary: str, end_id: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes the texts as the rows lie and writes flat files of ``width``-byte ids, with no index.

    Special strings in a text are ordinary text here, so no text can hold the separator.
    Returns one row per document, stored: file, seq (its place in the file), doc_id.
    Each task streams to its own file, so none holds more than one batch.
    """

    def write(batches):
        out, seq = None, 0
        name = f"{path}/flat-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.bin"
        for doc_ids, ids, counts in _encoded(batches, vocabulary, end_id, plain=True):
            if np.count_nonzero(ids == end_id) != len(counts) or ids.max(initial=0) >> 8 * width:
                raise ValueError("a text holds the separator, or an id is too wide")
            if out is None:
                files, at = file_system(name)
                files.create_dir(at.rpartition("/")[0], recursive=True)
                out = files.open_output_stream(at)
            out.write(ids.astype(f"<u{width}").tobytes())
            yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(counts), pa.string()), "seq": np.arange(seq, seq + len(counts)), "doc_id": pa.array(doc_ids, pa.int64())})
            seq += len(counts)
        if out is not None:
            out.close()

    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(write, "file string, seq long, doc_id long"), "order")


def scan_flat(files: DataFrame, end_id: int, width: int = 2, block_bytes: int = 1 << 22) -> DataFrame:
    """Counts each document's ids, with its separator, in flat unindexed files.

    ``files`` has a column file. Every block is searched on its own; per block
    stay its number of separators and the ids after the last one, and a prefix
    sum of these along a file gives each block the sequence number of its first
    document and the ids that earlier blocks hold of it. Returns file, seq,
    start (ids before it in the file), n_tokens. Ids after a file's last
    separator are a last document that was not closed: n_tokens counts them,
    ``closed`` is false.
    """
    spark = files.sparkSession

    def places(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                where, at = file_system(name)
                size = where.get_file_info(at).size
                n = -(-size // block_bytes)
                yield pa.RecordBatch.from_pydict({"file": pa.array([name] * n, pa.string()), "block": np.arange(n), "last": np.arange(n) == n - 1})

    def found(name: str, block: int) -> tuple[np.ndarray, int]:
        where, at = file_system(name)
        with where.open_input_file(at) as source:
            ids = np.frombuffer(source.read_at(block_bytes, block * block_bytes), f"<u{width}")
        return np.flatnonzero(ids == end_id), len(ids)

    def summed(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at, n = found(row["file"], row["block"])
                yield pa.RecordBatch.from_pydict({"file": [row["file"]], "block": [row["block"]], "last": [row["last"]], "seps": [len(at)], "n": [n], "final": pa.array([block_bytes // width * row["block"] + int(at[-1]) if len(at) else None], pa.int64())})

    def counted(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at, n = found(row["file"], row["block"])
                ends = block_bytes // width * row["block"] + at
                if row["last"] and (ends[-1] if len(ends) else row["before"]) < block_bytes // width * row["block"] + n - 1:
                    ends = np.append(ends, block_bytes // width * row["block"] + n - 1)
                starts = np.concatenate([[row["before"] + 1], ends[:-1] + 1])[: len(ends)]
                yield pa.RecordBatch.from_pydict({"file": pa.array([row["file"]] * len(ends), pa.string()), "seq": row["first"] + np.arange(len(ends)), "start": starts.astype(np.int64), "n_tokens": (ends - starts + 1).astype(np.int64), "closed": np.arange(len(ends)) < len(at)})

    names = files.select("file").distinct()
    blocks = names.mapInArrow(places, "file string, block long, last boolean").repartition("file", "block")
    blocks = stored(blocks.mapInArrow(summed, "file string, block long, last boolean, seps long, n long, final long"), "blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select("file", "block", "last", F.coalesce(F.sum("seps").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("final").over(before), F.lit(-1)).alias("before"))
    return placed.repartition("file", "block").mapInArrow(counted, "file string, seq long, start long, n_tokens long, closed boolean")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for token files where all executors see it."""
    return new_path(spark, name)

"""Order min-hash fingerprints of documents.

A text is the set of its k-mers of code points, each numbered by occurrence. For
each of ``hashes`` orders the two least numbered k-mers are taken, put back in
text order and hashed as a tuple. The share of equal tuples tells texts with
many common k-mers in a common order, that is, of small edit distance, from
those that merely share k-mers.

A text shorter than ``k`` is one k-mer; an empty or null text is none, and its
tuples are all 0. A text of one k-mer makes tuples of that alone. Equal texts
have equal fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, sliced

K, HASHES, COLUMNS = 8, 96, 4096
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def kmers(points: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of each k-mer, built up by doubling spans."""
    if not len(points):
        return np.zeros(0, np.uint64)
    k = min(k, len(points))
    spans, done, span, total = mixed(points.astype(np.uint64) + MIX[0]), None, 1, 0
    while True:
        if k & span:
            done = spans if done is None else done[: len(spans) - total] * MIX[0] + spans[total:] if len(spans) - total > 0 else done
            total += span
        if total == k:
            return mixed(done[: len(points) - k + 1])
        spans = mixed(spans[:-span] * MIX[1] + spans[span:])
        span *= 2


def occurrences(found: np.ndarray) -> np.ndarray:
    """How often each k-mer has come before."""
    out = np.zeros(len(found), np.uint32)
    bits = np.uint64(max(20, len(found).bit_length()))
    place = np.uint64((1 << int(bits)) - 1)
    packed = np.sort((found & ~place) | np.arange(len(found), dtype=np.uint64))
    key = packed >> bits
    again = np.flatnonzero(key[1:] == key[:-1]) + 1
    if len(again):
        first = np.ones(len(again), bool)
        first[1:] = np.diff(again) > 1
        at = np.arange(len(again))
        out[packed[again] & place] = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
    return out


_rng = np.random.default_rng(20)
FACTOR, SHIFT = (_rng.integers(0, 1 << 32, HASHES, np.uint32)[:, None] for _ in range(2))
FACTOR = FACTOR | np.uint32(1)


def fingerprint(text: str) -> np.ndarray:
    """The tuples' hashes, 16 bits each."""
    found = kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    n = len(found)
    if not n:
        return np.zeros(HASHES, np.uint16)
    base = (mixed(found + occurrences(found) * MIX[0]) >> np.uint64(32)).astype(np.uint32)
    rows = np.arange(HASHES)
    least, at = np.full((HASHES, 0), 0, np.uint32), np.zeros((HASHES, 0), np.int64)
    for first in range(0, n, COLUMNS):  # keeps the table small for long texts
        table = (base[first : first + COLUMNS] ^ SHIFT) * FACTOR
        best, places = [least], [at]
        for _ in range(min(2, table.shape[1])):
            low = table.argmin(1)
            best.append(table[rows, low][:, None])
            places.append(low[:, None] + first)
            table[rows, low] = 0xFFFFFFFF
        best, places = np.hstack(best), np.hstack(places)
        keep = np.argsort(best, 1, kind="stable")[:, :2]
        least, at = np.take_along_axis(best, keep, 1), np.take_along_axis(places, keep, 1)
    at.sort(1)
    chosen = found[at]
    return (mixed(chosen[:, 0] * MIX[0] + (chosen[:, 1] if at.shape[1] > 1 else np.uint64(1))) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def hexed(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (4 hex digits a tuple) of each row; no shuffle."""

    def run(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hexed(fingerprint(t or "")) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following text's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint held against its edited text's and the next document's.

    Next is by descending id (null ids last, equal ids by descending text), after
    the last the first; a single document follows itself. The texts are shuffled
    once: ids are cut into ranges, and the range above also gets the greatest id
    of the one below, the lowest that of the highest. The driver sees one row a
    range; there are as many ranges as shuffle partitions. Rows that repeat are documents of their own.
    """
    least = -(2**63)
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(least))

    def ends(batches):
        found = [x for batch in batches for x in (batch.column(0)[0].as_py(), batch.column(0)[-1].as_py()) if batch.num_rows]
        if found:
            yield pa.RecordBatch.from_pydict({"low": [min(found)], "high": [max(found)]})

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = sorted(rows.select(key.alias("k")).repartitionByRange(parts, "k").sortWithinPartitions("k").mapInArrow(ends, "low long, high long").collect())
    n = max(1, len(ranges))
    lows, highs = [r.low for r in ranges], [r.high for r in ranges]

    def dealt(batches):
        start = np.array(lows, np.int64)
        after = {high: (i + 1) % n for i, high in enumerate(highs)}
        for batch in batches:
            keys = np.array([least if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            own = np.searchsorted(start, keys, "right") - 1
            halo = np.flatnonzero(np.isin(keys, list(after)))
            pick = np.concatenate([np.arange(len(keys)), halo])
            bucket = np.concatenate([own, [after[x] for x in keys[halo].tolist()]]).astype(np.int64)
            moved = batch.take(pa.array(pick))
            # a bucket's halo comes before its rows
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.arange(len(pick)) >= len(keys)), moved.column(0), moved.column(1)], ["bucket", "halo", "doc_id", "text"])

    def compared(batches):
        bucket, following, text_before = None, None, ""
        for batch in sliced(batches, 3):
            out = []
            for b, halo, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                signature = fingerprint(text)
                if b != bucket:
                    bucket, following = b, None
                if not halo:
                    if following is None:
                        raise ValueError("no row before the first of a range")
                    changed = edited(text, text_before)
                    other = fingerprint(changed)
                    out.append((doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), hexed(signature), hexed(other), likeness(signature, other), likeness(signature, following)))
                following, text_before = signature, text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    placed = rows.mapInArrow(dealt, "bucket long, halo boolean, doc_id long, text string").repartitionByRange(n, "bucket")
    ordered = placed.sortWithinPartitions("bucket", F.desc("halo"), F.asc_nulls_first("doc_id"), "text")
    return ordered.mapInArrow(compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

"""SentencePiece ids by a table of distinct chunks, and back.

If no piece of the vocabulary goes on from another character to the white-space
mark, segmentation never crosses from a word to the next mark. A text is then
cut before each run of marks, each distinct chunk of a worker's texts is
segmented once, and the ids are joined by position. A vocabulary with such a
piece, or that normalises text otherwise than by the mark, is refused by
``ChunkTable`` and texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, sliced

MARK = "▁"
CHUNK = re.compile(" *[^ ]+| +")


class ChunkTable:
    """Encodes texts by distinct chunks. ``limit``: chunks that the table keeps."""

    def __init__(self, path: str, limit: int = 200_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        model = pb.ModelProto.FromString(open(path, "rb").read())
        norm = model.normalizer_spec
        user_defined = any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces)
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not user_defined and not model.trainer_spec.treat_whitespace_as_suffix
        self.mark_id = self.library.piece_to_id(MARK)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.limit, self.known = limit, {}

    def _segment(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of chunks that each begin with a blank; the library puts a mark before what it is given."""
        found = self.library.encode([c[1:] for c in chunks], num_threads=1)
        return [np.array(ids if len(c) > 1 else [self.mark_id], np.uint32) for c, ids in zip(chunks, found)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with begin and end ids."""
        if not self.cuts:
            return [np.array([self.begin, *ids, self.end], np.uint32) for ids in self.library.encode(texts, num_threads=1)]
        chunks: list[str] = []
        bounds = [0]
        for text in texts:
            if text:
                text = text.replace(MARK, " ")
                chunks += CHUNK.findall(" " + text)
            bounds.append(len(chunks))
        ids = list(map(self.known.get, chunks))
        lacking = [i for i, x in enumerate(ids) if x is None]
        if lacking:
            missing = list(dict.fromkeys(chunks[i] for i in lacking))
            fresh = dict(zip(missing, self._segment(missing)))
            for i in lacking:
                ids[i] = fresh[chunks[i]]
            if len(self.known) > self.limit and len(lacking) > len(chunks) // 5:  # another kind of text has begun
                self.known = {}
            if len(self.known) <= self.limit:
                self.known |= fresh
        begin, end = np.array([self.begin], np.uint32), np.array([self.end], np.uint32)
        return [np.concatenate([begin, *ids[a:b], end]) for a, b in zip(bounds, bounds[1:])]


_TABLES: dict[str, ChunkTable] = {}


def table(path: str) -> ChunkTable:
    """This process's table of the model at ``path``."""
    if path not in _TABLES:
        _TABLES[path] = ChunkTable(path)
    return _TABLES[path]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True, digests: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encodes each text and decodes its ids again: no shuffle, one row out per row in.

    Columns: doc_id, those named in ``keep``, n_tokens, then ``ids`` (array of
    int) if ``ids``, ``decoded`` if ``decoded``, and ids_sha256, decoded_sha256 if
    ``digests``. A null text counts as empty: begin and end id alone, decoded "".
    Null doc_ids and repeated rows come out as they went in; other columns are
    left behind.
    """
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), *[column(docs, c) for c in keep], column(docs, text_col).cast("string").alias("__text"))
    more = [("n_tokens", T.LongType()), *[("ids", T.ArrayType(T.IntegerType()))] * ids, *[("decoded", T.StringType())] * decoded, *[("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] * digests]
    schema = T.StructType(rows.schema.fields[:-1] + [T.StructField(*x) for x in more])

    last = len(rows.columns) - 1

    def run(batches):
        chunks = table(model)
        decode = chunks.library.decode
        for batch in sliced(batches, last, 1 << 20):
            found = chunks.encode([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
            out = [*batch.columns[:-1], pa.array([len(x) for x in found], pa.int64())]
            back = [decode(x.tolist()) for x in found] if decoded or digests else []
            if ids:
                out.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
            if decoded:
                out.append(pa.array(back, pa.string()))
            if digests:
                out += [pa.array([hashlib.sha256(x.astype("<u4")).hexdigest() for x in found], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=schema.fieldNames())

    return rows.mapInArrow(run, schema)

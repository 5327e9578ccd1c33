"""Secret scans: keywords first, anchored patterns only where they hit, checksums last.

An Aho-Corasick automaton over the text in ASCII lower case finds all keywords;
the pattern of the keyword's kind is then tried at that place alone. Every match
of such a pattern begins with its keyword, so trying the hits in order, past the
end of the last match, finds what a search of the whole text would. Of patterns
that read over runs of any length, hits inside a run that has failed are not
tried again, so the time is linear in the text whatever it holds. Hexadecimal
runs have no keyword and are searched for directly. Kinds with a checksum or a
structure inside (``github``, ``npm``, ``jwt``) keep only spans that hold it.

Spans are in code points, end exclusive, leftmost and non-overlapping in their
kind. Null and empty texts have none. Columns besides the id and the text are
left behind by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, sliced

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
#: Patterns by kind; the first three are the base kinds.
PATTERNS = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{32,}"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]+"),
    # header lines, with the lines that carry them on, may stand before the body
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:\s*[A-Za-z][A-Za-z0-9-]*:[^\n]*\n(?:[ \t]+(?!-----|[A-Za-z][A-Za-z0-9-]*:)\S[^\n]*\n){0,8})*[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"),
}
#: What a match that failed has read over: a hit inside it reads on to the same end, and fails there too.
READ_OVER = {
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]++"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:\s*[A-Za-z][A-Za-z0-9-]*:[^\n]*\n(?:[ \t]+(?!-----|[A-Za-z][A-Za-z0-9-]*:)\S[^\n]*\n){0,8})*"),
}
#: Keywords, in lower case, that every match of a kind begins with.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}
#: Fixed value: digits of the checksum that ends these tokens, CRC-32 in base 62.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: str) -> str:
    """CRC-32 of the body in base 62, six digits."""
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits


def _json_object(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except ValueError:
        return False


def holds(kind: str, match: re.Match) -> bool:
    """Whether a match is long enough and what it carries inside agrees."""
    if kind == "assign":
        return len(match[1]) >= 8
    if kind == "access":
        return match.end() - match.start() >= 16
    if kind in ("github", "npm"):
        return checksum62(match[1]) == match[2]
    return kind != "jwt" or _json_object(match[1]) and _json_object(match[2])


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then by kind as listed in ``KINDS``."""
    if not text:
        return []
    spans = [(m.start(), m.end(), "hex") for m in PATTERNS["hex"].finditer(text)]
    lower = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    past = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in _automaton().iter(lower):
        start = last - size + 1
        if start < past[kind]:
            continue
        if m := PATTERNS[kind].match(text, start):
            past[kind] = m.end()
            if holds(kind, m):
                spans.append((start, m.end(), kind))
        elif kind in READ_OVER and (run := READ_OVER[kind].match(text, start)):
            past[kind] = run.end()
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id and ``found``, an array of (start, end, kind), for each row; no shuffle.

    ``digests``: instead of the array the counts of the base kinds, base_sha256
    of their joined spans, and all spans joined.
    """
    fields = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" if digests else "doc_id long, found array<struct<start:int,end:int,kind:string>>"
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches):
        for batch in sliced(batches):
            each = [find(t) for t in batch.column(1).to_pylist()]
            if not digests:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in spans] for spans in each], shape)], ["doc_id", "found"])
                continue
            base = [[s for s in spans if s[2] in KINDS[:3]] for spans in each]
            counts = [pa.array(np.array([sum(s[2] == kind for s in spans) for spans in base], np.int64)) for kind in KINDS[:3]]
            sha = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha, pa.string()), pa.array(map(joined, each), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, fields)


def cleaned(text: str | None) -> str | None:
    """The text with each secret replaced by ``[kind]``; spans that overlap become one, named by the first."""
    merged: list[list] = []
    for start, end, kind in find(text):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end, kind])
    if not merged:
        return text
    at, parts = 0, []
    for start, end, kind in merged:
        parts += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with secrets in the text column replaced; no shuffle."""

    at = docs.columns.index(text_col)

    def run(batches):
        for batch in sliced(batches, at):
            columns = batch.columns
            columns[at] = pa.array(map(cleaned, batch.column(at).to_pylist()), batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)

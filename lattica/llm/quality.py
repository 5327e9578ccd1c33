"""Quality by a regularised quadratic discriminant over document statistics.

Each class is a Gaussian over transformed statistics of the text. Its covariance
is shrunk towards the pooled one and that towards its diagonal, and kept as a
Cholesky factor. A score is the posterior of class 1 from the difference of the
two log densities.

Statistics come from whole texts; a null or empty text has all counts 0 and is
scored like any other. Labels other than 0 and 1 and label rows without a
document are not learned from; a document that is labelled twice counts twice.
With one class only, every score is 1 or 0 by that class; with none, 0.5.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass, field
from functools import cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, sliced

STATISTICS = ("length", "letters", "upper", "digits", "marks", "symbols", "lines", "word_length", "distinct", "repeats", "top_mark")
#: Characters that a short text is filled up with, so that its rates do not jump.
PRIOR = 40.0
#: The column that ``score_documents`` adds.
SCORE = "__quality_score"
LETTER, UPPER, DIGIT, SPACE, LINE, MARK, SYMBOL = 1, 2, 4, 8, 16, 32, 64

#: Which of the 128 sets of bits hold each kind: bins of characters times this are the kinds' counts.
_HAS = np.array([[float(bool(i & bit)) for bit in (LETTER, UPPER, DIGIT, MARK, SYMBOL, LINE)] for i in range(128)])


@cache
def _classes() -> np.ndarray:
    """A bit set for each code point of the two lowest planes."""
    kinds = np.zeros(1 << 17, np.uint8)
    for i in range(len(kinds)):
        c = unicodedata.category(chr(i))
        kinds[i] = {"L": LETTER, "N": DIGIT, "Z": SPACE, "P": MARK, "S": SYMBOL}.get(c[0], 0) | (UPPER if c in ("Lu", "Lt") else 0)
    for c in "\t\r ":
        kinds[ord(c)] = SPACE
    kinds[ord("\n")] = SPACE | LINE
    for c in "#$%&*+<=>@\\^_`|~":
        kinds[ord(c)] = SYMBOL
    return kinds


def statistics(text: str) -> list[float]:
    """The statistics of one text, each on a scale where a Gaussian is a fair picture."""
    n = len(text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(_classes()[np.minimum(points, (1 << 17) - 1)], minlength=128)
    letters, upper, digits, marks, symbols, lines = (counts @ _HAS).tolist()
    words = text.split()
    n_words, distinct = len(words), len(set(words))
    repeats = sum(map(eq, words, words[1:]))
    top = max((text.count(c) for c in "!?|$"), default=0)
    rate = lambda k, of_n, usual: np.log((k + PRIOR * usual) / (of_n + PRIOR))
    return [
        np.log1p(n),
        rate(letters, n, 0.8),
        rate(upper, letters, 0.02),
        rate(digits, n, 0.01),
        rate(marks, n, 0.03),
        rate(symbols, n, 0.01),
        rate(lines, n, 0.01),
        np.log((n + PRIOR) / (n_words + PRIOR / 6)),
        np.log((distinct + PRIOR / 6) / (n_words + PRIOR / 6)),
        rate(repeats, n_words, 0.01),
        rate(top, n, 0.01),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and an array of statistics for each row; no shuffle."""

    def run(batches):
        for batch in sliced(batches):
            found = np.array([statistics(t or "") for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(found), pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


@dataclass
class Discriminant:
    """Means, Cholesky factors and log determinants of the classes, by label; and the prior of class 1."""

    mean: dict[int, np.ndarray]
    chol: dict[int, np.ndarray]
    prior: float
    cached: dict[int, np.ndarray] = field(default_factory=dict, repr=False, compare=False)

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.mean) < 2:
            return np.full(len(x), self.prior)
        gap = np.full(len(x), np.log(self.prior) - np.log1p(-self.prior))
        for label, sign in ((1, 0.5), (0, -0.5)):
            z = self._inverse(label) @ (x - self.mean[label]).T
            gap -= sign * ((z * z).sum(0) + 2 * np.log(np.diag(self.chol[label])).sum())
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))

    def _inverse(self, label: int) -> np.ndarray:
        """The inverse of a class's factor, by forward substitution, once a process."""
        if label not in self.cached:
            low = self.chol[label]
            out = np.eye(len(low))
            for i in range(len(low)):
                out[i] = (out[i] - low[i, :i] @ out[:i]) / low[i, i]
            self.cached[label] = out
        return self.cached[label]

    def to_json(self) -> str:
        return json.dumps({"prior": self.prior, "mean": {k: v.tolist() for k, v in self.mean.items()}, "chol": {k: v.tolist() for k, v in self.chol.items()}})

    @classmethod
    def from_json(cls, text: str) -> Discriminant:
        d = json.loads(text)
        return cls(*({int(k): np.array(v) for k, v in d[x].items()} for x in ("mean", "chol")), d["prior"])


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", towards_pooled: float = 0.1, towards_diagonal: float = 0.1) -> Discriminant:
    """Fits from sums and products over all labelled rows, added up by Spark: the driver gets two rows.

    ``stats``: doc_id, x. ``labels``: doc_id and ``label_col``; only the rows to learn from.
    """
    d = len(STATISTICS)
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    marked = labels.select(column(labels, "doc_id").cast("long").alias("doc_id"), column(labels, label_col).cast("int").alias("y")).filter("y in (0, 1)")
    rows = stats.join(marked, "doc_id").groupBy("y").agg(F.count("*").alias("n"), *sums, *products).collect()
    n = {r.y: r.n for r in rows}
    mean = {r.y: np.array([r[f"s{i}"] for i in range(d)]) / r.n for r in rows}
    cov = {}
    for r in rows:
        second = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)]) / r.n
        cov[r.y] = second - np.outer(mean[r.y], mean[r.y])
    total = sum(n.values())
    if not total:
        return Discriminant({}, {}, 0.5)
    pooled = sum(n[y] * cov[y] for y in n) / total
    chol = {}
    for y in n:
        mixed = (1 - towards_pooled) * cov[y] + towards_pooled * pooled
        mixed = (1 - towards_diagonal) * mixed + towards_diagonal * np.diag(np.diag(mixed))
        chol[y] = np.linalg.cholesky(mixed + 1e-4 * np.eye(d))
    return Discriminant(mean, chol, n.get(1, 0) / total)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """Adds the column ``score`` to ``stats``; the factors go along with the function."""

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def score_documents(docs: DataFrame, model: Discriminant) -> DataFrame:
    """``docs``, all columns, with the score appended as ``SCORE``, in one pass over the texts."""
    out = T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType())])

    at = docs.columns.index("text")

    def run(batches):
        for batch in sliced(batches, at):
            texts = batch.column(at).to_pylist()
            x = np.array([statistics(t or "") for t in texts], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], names=[*batch.schema.names, SCORE])

    return docs.mapInArrow(run, out)

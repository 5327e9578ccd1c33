"""Language by compression: the dictionary that a text compresses best with names it.

Each language has a zstandard raw-content dictionary made of training texts. A
text is cut into pieces, all of them are compressed with every dictionary, and
the language with the fewest bytes wins. Where the two best are closer than
``margin`` (as a share of the bytes), the text is compressed again at a higher
level; if they are close then too, the result is not ``confident``, and callers
that reject such texts read that column.

A text that is null or has no letter is ``und`` with score 0. With no
dictionary at all (no labelled row), every text is ``und``. Ties go to the
language that comes first in the dictionaries, the one with most rows to learn from. Repeated rows get equal results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, sliced

LETTER = re.compile(r"[^\W\d_]")
#: Characters of a passage that a dictionary takes from a long text.
PASSAGE = 80
#: Bytes of a piece, and of piece excess that make a language e times less likely.
PIECE, TEMPERATURE = 4096, 16.0


def dictionaries(docs: DataFrame, dictionary_bytes: int = 48 << 10, sample_docs: int = 200, lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language from a bounded sample of ``docs``, the rows to learn from.

    The sample are the ``sample_docs`` different texts of a language whose seeded
    hash is least (all, where there are fewer); copies count once. Whole texts are
    sampled: of each one as many equally spaced passages as its share of
    ``dictionary_bytes`` holds, from its beginning to its end, and all of it where
    it fits. Of a language, ``sample_docs`` rows and about ``dictionary_bytes`` (as
    characters) reach the driver. Passages are lower-cased, as texts are.
    """
    rows = docs.select(column(docs, lang_col).cast("string").alias("lang"), column(docs, "text").cast("string").alias("text")).filter("lang is not null and length(text) > 0")
    hashed = rows.withColumn("h", F.xxhash64("text", F.lit(17)))
    counts = hashed.groupBy("lang", "h").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("different")).collect()
    if not counts:
        return {}
    # a hash falls among the least with this chance; four deviations more than are wanted, so that hardly ever one is lacking
    low = F.lit(None).cast("double")
    for r in counts:
        low = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, (sample_docs + 4 * sample_docs**0.5 + 8) / r["different"]))).otherwise(low)
    share = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    least = Window.partitionBy("lang").orderBy("h")
    sizes = hashed.filter(share <= low).groupBy("lang", "h").agg(F.min("text").alias("text")).withColumn("place", F.row_number().over(least)).filter(F.col("place") <= sample_docs)
    sizes = sizes.withColumn("of", F.count("*").over(Window.partitionBy("lang")))
    budget = F.greatest(F.lit(PASSAGE), F.floor(F.lit(dictionary_bytes) / F.col("of"))).cast("int")
    n = F.greatest(F.lit(1), F.floor(budget / PASSAGE)).cast("int")
    step = (F.length("text") - PASSAGE) / F.greatest(n - 1, F.lit(1))
    spaced = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", F.floor(i * step).cast("int") + 1, F.lit(PASSAGE)))
    kept = F.when(F.length("text") <= budget, F.col("text")).otherwise(F.array_join(spaced, " "))
    found = sizes.select("lang", "place", F.lower(kept).alias("text")).collect()
    out = {}
    for r in sorted(counts, key=lambda r: (-r["n"], r["lang"])):
        texts = [x["text"] for x in sorted((x for x in found if x["lang"] == r["lang"]), key=lambda x: x["place"])]
        out[r["lang"]] = " ".join(texts).encode()[:dictionary_bytes]
    return out


class Compressors:
    """The digested dictionaries of one process."""

    def __init__(self, contents: dict[str, bytes], levels: tuple[int, int] = (6, 12)):
        import zstandard as z

        self.langs = list(contents)
        self.each = [[], []]
        for level, made in zip(levels, self.each):
            for lang in self.langs:
                content = z.ZstdCompressionDict(contents[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
                content.precompute_compress(level=level)
                made.append(z.ZstdCompressor(level=level, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str, closer: bool = False) -> np.ndarray:
        """Bytes by language; ``closer``: at the higher level, which costs twice as much."""
        data = text.lower().encode("utf-8", "replace")
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self.each[closer]], np.float64)

    def classify(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """(language, score, whether the margin is wide enough)."""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, False
        sizes = self.sizes(text)
        if len(sizes) > 1 and np.partition(sizes, 1)[1] - sizes.min() < margin * sizes.min():
            sizes = self.sizes(text, closer=True)
        best = int(sizes.argmin())
        score = 1 / np.exp(-(sizes - sizes[best]) / TEMPERATURE).sum()
        next_best = np.partition(sizes, 1)[1] if len(sizes) > 1 else np.inf
        return self.langs[best], float(score), bool(next_best - sizes[best] >= margin * sizes[best])


def classify(docs: DataFrame, contents: dict[str, bytes], margin: float = 0.02, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, confident for each row; no shuffle. ``contents`` goes along with the function."""

    def run(batches):
        compressors = Compressors(contents)
        for batch in sliced(batches):
            found = [compressors.classify(t, margin) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], ["doc_id", "lang_pred", "score", "confident"])

    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, confident boolean")

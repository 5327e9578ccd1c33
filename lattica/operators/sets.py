"""Sets, bitmaps, slices and membership over DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .structure import running


def merged(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, repeats included."""
    return reduce(DataFrame.unionByName, frames)


def semi_filter(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` whose key is among the right keys: what a bitmap of the right keys would let pass, exactly."""
    keys = right.select(F.col(right_key).alias("__key")).distinct()
    return left.join(keys, left[left_key] == keys["__key"], "left_semi")


def connected(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst, connected (whether the edge is there) of each pair."""
    have = edges.select("src", "dst").distinct().withColumn("__there", F.lit(True))
    return pairs.join(have, ["src", "dst"], "left").select("src", "dst", F.coalesce("__there", F.lit(False)).alias("connected"))


def row_split(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """``df`` with ``slice`` 0 .. n-1: near-equal runs of the rows by ascending ``keys``, the first ones a row longer."""
    placed = running(df, keys, "__at")
    total = df.count()
    size, over = divmod(total, n)
    edge = over * (size + 1)
    late = F.lit(over) + F.floor((F.col("__at") - edge) / size) if size else F.lit(0)
    return placed.withColumn("slice", F.when(F.col("__at") < edge, F.floor(F.col("__at") / (size + 1))).otherwise(late).cast("long")).drop("__at")


def sorted_edges(edges: DataFrame) -> DataFrame:
    """pos, src, dst: the edges by source, then target, with their places."""
    return running(edges.select("src", "dst"), ["src", "dst"], "pos").select("pos", "src", "dst")


# -- bitmaps: rows (key, word, bits), 32 ids a word ----------------------------


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("key", "word", F.col("bits").alias("__a")), b.select("key", "word", F.col("bits").alias("__b"))
    return left.join(right, ["key", "word"], "full").na.fill(0, ["__a", "__b"])


def _kept(rows: DataFrame, bits) -> DataFrame:
    """Words without a bit are not kept, so an empty set has no rows."""
    return rows.select("key", "word", bits.alias("bits")).filter("bits <> 0")


def bitmap_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return _kept(_both(a, b), F.col("__a").bitwiseAND(F.col("__b")))


def bitmap_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return _kept(_both(a, b), F.col("__a").bitwiseOR(F.col("__b")))


def bitmap_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """The bits of ``a`` with those of ``b`` cleared."""
    return _kept(_both(a, b), F.col("__a").bitwiseAND(F.bitwise_not("__b")))


def bitmap_fill(keys: DataFrame, size: int) -> DataFrame:
    """For each key the set of all of 0 .. size-1."""
    words = F.sequence(F.lit(0).cast("long"), F.lit((size - 1) // 32).cast("long"))
    last = F.lit((1 << ((size - 1) % 32 + 1)) - 1)
    return keys.select("key", F.explode(words).alias("word")).withColumn("bits", F.when(F.col("word") == (size - 1) // 32, last).otherwise(F.lit(0xFFFFFFFF)).cast("long"))


def bitmap_has(a: DataFrame, places: DataFrame) -> DataFrame:
    """key, place, set (whether the bit is) for rows (key, place)."""
    asked = places.withColumn("word", F.shiftright("place", 5))
    return asked.join(a, ["key", "word"], "left").select("key", "place", (F.getbit(F.coalesce("bits", F.lit(0).cast("long")), F.pmod("place", F.lit(32)).cast("int")) == 1).alias("set"))


def bitmap_facts(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, n_a, n_b, n_and, equal, a_empty of the two sets of each key."""
    n = lambda c: F.sum(F.bit_count(c)).cast("long")
    found = _both(a, b).groupBy("key").agg(n(F.col("__a")).alias("n_a"), n(F.col("__b")).alias("n_b"), n(F.col("__a").bitwiseAND(F.col("__b"))).alias("n_and"), F.bool_and(F.col("__a") == F.col("__b")).alias("equal"))
    return found.withColumn("a_empty", F.col("n_a") == 0)

"""Joins whose hot keys are dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dealt

#: Left rows of one key that a task should take, at least; and hot keys at most, which bounds what is broadcast.
SHARE, HOT_KEYS = 1 << 17, 4096


def hot_keys(left: DataFrame, key: str, share: int = SHARE) -> dict[int, int]:
    """Keys with more rows than a task's share, and over how many tasks to deal them; at most ``HOT_KEYS``.

    A key is hot only beyond ``1 / HOT_KEYS`` of all rows too, so there cannot be more.
    """
    sizes = left.groupBy(key).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n"), F.max("n")).first()
    limit = max(share, (total[0] or 0) // HOT_KEYS)
    if (total[1] or 0) <= limit:
        return {}
    return {r[key]: -(-r.n // limit) for r in sizes.filter(F.col("n") > limit).collect()}


def spread_join(left: DataFrame, right: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """``left.join(right, key)``; the left rows of a hot key are dealt by their hash, and its right rows copied to each share."""
    hot = hot_keys(left, key, share)
    if not hot:
        return left.join(dealt(right, key), key)
    kind = left.schema[key].dataType.simpleString()
    shares = F.broadcast(left.sparkSession.createDataFrame(list(hot.items()), f"{key} {kind}, __shares int"))
    others = [c for c in left.columns if c != key]
    spread = left.join(shares, key, "left").withColumn("__share", F.pmod(F.xxhash64(*others), F.coalesce("__shares", F.lit(1))).cast("int")).drop("__shares")
    copied = right.join(shares, key, "left").withColumn("__share", F.explode(F.sequence(F.lit(0), F.coalesce("__shares", F.lit(1)) - 1))).drop("__shares")
    return spread.join(copied, [key, "__share"]).drop("__share")

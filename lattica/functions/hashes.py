"""Hashes that other systems can repeat, as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start and factor of FNV-1a with 32 bits.
FNV_START, FNV_FACTOR = 2166136261, 16777619
#: A permutation of 0 .. 15.
PERMUTATION = (12, 3, 11, 9, 15, 2, 8, 4, 13, 10, 5, 7, 14, 6, 1, 0)
U32 = 0xFFFFFFFF


def portable(*columns: Column | str) -> Column:
    """A number below 2**60: the first 15 hexadecimal digits of the MD5 of the values, joined by ``_``."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", *columns)), 1, 15), 16, 10).cast("long")


def portable_of(*values) -> int:
    """``portable`` of plain values, on the driver."""
    return int(hashlib.md5("_".join(map(str, values)).encode()).hexdigest()[:15], 16)


def fnv1a32(text: Column) -> Column:
    """FNV-1a with 32 bits over the bytes of the text in UTF-8."""
    data = F.hex(F.encode(text, "UTF-8"))
    places = F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data), F.lit(2))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(data, i, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(places, F.lit(FNV_START).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * FNV_FACTOR).bitwiseAND(U32))


def stable_id(text: Column) -> Column:
    """Digits as their number in 32 bits, any other text by ``fnv1a32``."""
    return F.when(text.rlike(r"^[0-9]{1,18}$"), text.try_cast("long").bitwiseAND(U32)).otherwise(fnv1a32(text))


def scattered(x: Column) -> Column:
    """32-bit numbers scattered by the finaliser of MurmurHash3."""
    half = lambda v, n: v.bitwiseXOR(F.shiftrightunsigned(v, n))
    # a product of two 32-bit numbers can leave 63 bits: the upper half of one goes in apart
    times = lambda v, by: ((v.bitwiseAND(0xFFFF) * by) + F.shiftleft((F.shiftrightunsigned(v, 16) * by).bitwiseAND(0xFFFF), 16)).bitwiseAND(U32)
    x = times(half(x.cast("long").bitwiseAND(U32), 16), 0x85EBCA6B)
    return half(times(half(x, 13), 0xC2B2AE35), 16)


def permuted(x: Column) -> Column:
    """The entry of ``PERMUTATION`` at x, 0 beyond it."""
    return F.coalesce(F.get(F.array(*map(F.lit, PERMUTATION)), x.cast("int")), F.lit(0))

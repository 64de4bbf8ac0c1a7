"""Filters of fixed size that tell most keys that don't matter from those that may, before anything is shuffled.

A filter is a table of words of 64 bits, put together by a grouped bitwise or: the upper bits of a key name the word, the lower ones
four bits in it. Every key that it was made of passes, few others do; with more keys than it can tell apart more rows
pass, and results stay the same, as a join always decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the largest filter, in words of 64 bits as a power of two: 16 MB.
POWER = 21
_BITS = 4


def _mask(key: str) -> Column:
    return F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned({key}, {6 * i}) & 63 AS int))" for i in range(_BITS)))


def filter_words(keys: DataFrame, power: int = POWER) -> tuple[DataFrame, int]:
    """The words (at, bits) of a filter of keys (one column of 64-bit hashes), at most 2 ** power of them, and the power used."""
    key = keys.columns[0]
    power = min(power, max(6, (2 * keys.count()).bit_length() - 1))
    return keys.groupBy(F.shiftrightunsigned(key, 64 - power).alias("at")).agg(F.bit_or(_mask(key)).alias("bits")), power


def filter_array(keys: DataFrame, power: int = POWER) -> np.ndarray:
    """The filter as an array, for use in tasks."""
    words, power = filter_words(keys, power)
    words = words.toArrow()
    out = np.zeros(1 << power, np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def passes(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys pass a filter_array."""
    u, one, low = keys.view(np.uint64), np.uint64(1), np.uint64(63)
    mask = np.zeros(len(u), np.uint64)
    for i in range(_BITS):
        mask |= one << ((u >> np.uint64(6 * i)) & low)
    return bits[u >> np.uint64(65 - len(bits).bit_length())] & mask == mask


def sifted(df: DataFrame, key: str, keys: DataFrame, power: int = POWER) -> DataFrame:
    """The rows of df whose key, a column of 64-bit hashes, may be among keys. The filter is broadcast; its size is bounded."""
    words, power = filter_words(keys, power)
    words = words.withColumnsRenamed({"at": "_at", "bits": "_bits"})
    rows = df.withColumn("_at", F.shiftrightunsigned(key, 64 - power)).join(F.broadcast(words), "_at")
    return rows.where(F.col("_bits").bitwiseAND(_mask(key)) == _mask(key)).select(*df.columns)

"""A Bloom filter over 64-bit keys, built by aggregation and read on executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the smallest and of the largest filter, as powers of two: 8 KB to 16 MB. Beyond some 8 million keys more and more pass, which costs time only.
LEAST_BITS, MOST_BITS = 16, 27


def key_filter(keys: DataFrame) -> np.ndarray:
    """Words of a filter over column `key`, of about 16 bits a key, put together by aggregation."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length()))
    mask = (1 << bits) - 1
    places = F.explode(F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 64 - bits).bitwiseAND(mask))).alias("p")
    words = keys.select(places).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    got = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def holds(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each of the keys."""
    bits, keys = 5 + len(words).bit_length(), keys.astype(np.int64).view(np.uint64)
    out = np.ones(len(keys), bool)
    for place in (keys & np.uint64((1 << bits) - 1), keys >> np.uint64(64 - bits)):
        out &= (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0
    return out

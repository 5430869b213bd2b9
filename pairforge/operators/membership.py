"""A Bloom filter over known ids, asked before rows are shuffled.

Whatever the filter denies is absent for certain, so it needs no join; only the
rest goes on to the exact join behind it.  The bits come from a hash aggregate
(a word of 64 bits per row), their number from a count of the ids, and a filter
that would outgrow ``MOST_BITS`` is not built at all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

# Bits for each id and hashes of it: about 1 of 120 absent ids passes.
BITS, HASHES = 10, 7
# 128 MB, for 10^8 ids.
MOST_BITS = 1 << 30


def _places(key: str, bits: int) -> list[Column]:
    """Places of the bits of a key, by double hashing; ``bits`` is a power of two."""
    first, second = F.xxhash64(key), F.xxhash64(F.lit("second"), F.col(key)).bitwiseOR(F.lit(1).cast("long"))
    # Masks before products keep them below 2^63.
    mask = F.lit(bits - 1).cast("long")
    first, second = first.bitwiseAND(mask), second.bitwiseAND(mask)
    return [(first + second * i).bitwiseAND(mask) for i in range(HASHES)]


@dataclass(frozen=True)
class Membership:
    """Ids that may be known; the filter is broadcast to the tasks."""

    words: Broadcast[np.ndarray]
    bits: int

    @classmethod
    def of(cls, ids: DataFrame, key: str = "text_id", bits_per_id: int = BITS, most_bits: int = MOST_BITS) -> "Membership | None":
        """The filter of the distinct ``key`` values of ``ids``; ``None`` where it would be too large to broadcast."""
        known = ids.select(key).filter(F.col(key).isNotNull())
        n = known.agg(F.approx_count_distinct(key)).first()[0]
        bits = 1 << max(math.ceil(math.log2(max(n, 1) * bits_per_id)), 6)
        if bits > most_bits:
            return None
        place = known.select(F.explode(F.array(*_places(key, bits))).alias("place"))
        bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
        # One row for each word that has a bit, at most MOST_BITS / 64.
        table = place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("set")).toArrow()
        words = np.zeros(bits // 64, np.int64)
        words[table["word"].to_numpy()] = table["set"].to_numpy()
        return cls(ids.sparkSession.sparkContext.broadcast(words), bits)

    def may_hold(self, key: str = "text_id") -> Column:
        """False where ``key`` is not among the ids for certain; null keys are not."""
        shared, hashes = self.words, HASHES

        def probe(*places: pa.Array) -> pa.Array:
            words, hit = shared.value, np.ones(len(places[0]), bool)
            for place in places[:hashes]:
                at = np.asarray(place)
                hit &= (words[at >> 6] >> (at & 63) & 1).astype(bool)
            return pa.array(hit)

        found = F.arrow_udf(probe, "boolean")(*_places(key, self.bits))
        return F.when(F.col(key).isNull(), F.lit(False)).otherwise(found)

"""Bloom filters in DataFrame functions: built by bitmap aggregation, probed as an expression over one binary literal."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap that bitmap_construct_agg makes.
BUCKET_BITS = 32768


class Bloom:
    """One filter; `number` seeds its hashes, so filters of different numbers err on different keys."""

    def __init__(self, number: int, buckets: int, hashes: int):
        self.number, self.buckets, self.hashes, self.bits = number, buckets, hashes, b""

    @classmethod
    def sized(cls, number: int, keys: int, rate: float) -> Bloom:
        """For so many keys at a rate of false positives; whole bitmaps."""
        bits = max(1.0, keys * math.log2(1 / rate) / math.log(2))
        return cls(number, math.ceil(bits / BUCKET_BITS), max(1, round(math.log2(1 / rate))))

    @property
    def size_bytes(self) -> int:
        return self.buckets * BUCKET_BITS // 8

    def places(self, key: Column) -> Column:
        return F.array(*[F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(j)), F.lit(self.buckets * BUCKET_BITS)) for j in range(self.hashes)])

    def build(self, keys: DataFrame) -> Bloom:
        """From the column `key`. Bitmaps are made by aggregation; only `buckets` of them come to the driver."""
        at = keys.select(F.explode(self.places(F.col("key"))).alias("at"))
        rows = at.groupBy(F.floor(F.col("at") / BUCKET_BITS).alias("b")).agg(F.bitmap_construct_agg(F.col("at") % BUCKET_BITS).alias("bits"))
        whole = bytearray(self.size_bytes)
        for b, bits in rows.collect():
            whole[b * (BUCKET_BITS // 8) : (b + 1) * (BUCKET_BITS // 8)] = bits
        self.bits = bytes(whole)
        return self

    def accepts(self, key: Column) -> Column:
        """Whether all bits of a key are set; the literal stands in the expression once."""
        whole = F.lit(self.bits)

        def is_set(at: Column) -> Column:
            byte = F.conv(F.hex(F.substring(whole, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1

        return F.forall(self.places(key), is_set)

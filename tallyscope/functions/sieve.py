"""Tell most rows that cannot match a table of keys from those that may, without moving them.

A join on the key would shuffle every row of the large side once the keys outgrow a broadcast. The
keys' hashes set bits instead; the bits are broadcast, and a row whose bit is not set has no match.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.staging import stage

#: Bits of one bitmap row, as ``bitmap_construct_agg`` makes it.
_WIDTH = 32_768
#: Most bits, 16 MB; beyond about four million keys more rows pass that have no match.
MOST_BITS = 1 << 27
_BITS_A_KEY = 32


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def mark_possible(rows: DataFrame, key: Column, members: DataFrame, member: str, name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: false only if ``key`` is null or not among ``members``' column ``member``.

    ``members`` is read twice and not again, so it should be a table that may go afterwards; ``key`` must have
    the type of ``member``.
    """
    count = members.count()
    bits = max(_WIDTH, min(MOST_BITS, 1 << (_BITS_A_KEY * count - 1).bit_length() if count else _WIDTH))
    bit = _bit(F.col(member), bits)
    width = F.lit(_WIDTH)
    maps = stage(members.select(F.floor(bit / width).alias("_bucket"), (bit % width).alias("_at")).groupBy("_bucket").agg(
        F.bitmap_construct_agg("_at").alias("_bits")), "possible-keys")
    marked = rows.withColumn("_bit", _bit(key, bits)).withColumn("_bucket", F.floor(F.col("_bit") / width))
    at = F.col("_bit") % width
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, (at % 8).cast("int")) == 1
    return marked.join(F.broadcast(maps), "_bucket", "left").withColumn(
        name, key.isNotNull() & F.coalesce(found, F.lit(False))).drop("_bucket", "_bit", "_bits")

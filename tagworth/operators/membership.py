"""Membership bitmaps: which rows certainly do not occur in a large set.

A key sets one bit in each of two bitmaps.  Bitmaps are tables ``(bucket, bits)`` of at most
``2 ** bits / 32768`` rows; those of several days are merged by or-ing equal buckets, so
a day's keys are read once.  A row with a bit missing is not in the set; only the others
have to be compared with it exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 25
_PER_BUCKET = 32_768


def _places(on: list[Column], bits: int) -> list[Column]:
    """The bit of a key in each of the two bitmaps, from 1; the second lies behind the first."""
    size = 1 << bits
    return [F.pmod(F.xxhash64(F.lit(salt), *on), F.lit(size)) + (1 + salt * size) for salt in (0, 1)]


def key_bitmaps(rows: DataFrame, on: list[str], bits: int = BITS) -> DataFrame:
    """Bitmaps of the keys of ``rows``: combined per task, so little is shuffled."""
    at = rows.select(F.explode(F.array(*_places([F.col(c) for c in on], bits))).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def merged_bitmaps(*bitmaps: DataFrame) -> DataFrame:
    """The union of sets, each given by its bitmaps (of the same number of bits)."""
    every = reduce(DataFrame.unionByName, bitmaps)
    return every.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def filled(bitmaps: DataFrame) -> DataFrame:
    """``set_bits`` of both bitmaps together: twice the number of keys, less what fell together."""
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("set_bits"))


def marked(df: DataFrame, on: list[str], bitmaps: DataFrame, name: str = "maybe_seen", bits: int = BITS) -> DataFrame:
    """``df`` with ``name``: false if the key is certainly not in the set of ``bitmaps``.

    The bitmaps are broadcast: ``2 ** bits / 4`` bytes at most, whatever the set.
    """
    out = df
    for k, place in enumerate(_places([F.col(c) for c in on], bits)):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"_bucket{k}"), F.col("bits").alias(f"_bits{k}")))
        out = out.withColumn(f"_at{k}", place)
        out = out.join(side, F.bitmap_bucket_number(F.col(f"_at{k}")) == F.col(f"_bucket{k}"), "left")
    bit = F.lit(True)
    for k in (0, 1):
        inside = F.bitmap_bit_position(F.col(f"_at{k}")).cast("int")
        byte = F.conv(F.hex(F.expr(f"substring(_bits{k}, CAST(bitmap_bit_position(_at{k}) AS int) DIV 8 + 1, 1)")), 16, 10).cast("int")
        bit = bit & F.coalesce(F.call_function("bit_get", byte, inside % 8) == 1, F.lit(False))
    return out.select(*df.columns, bit.alias(name))


def not_in_set(df: DataFrame, seen: DataFrame, on: list[str], bitmaps: DataFrame | None = None, bits: int = BITS) -> DataFrame:
    """Rows whose key does not occur in ``seen``; a key with a null never occurs.

    ``bitmaps`` of ``seen`` may be given, as kept from earlier days; else they are made here.
    Rows that they decide stay in place.  The rest is shuffled and compared exactly.
    """
    keys = seen.select(*on)
    name = "_maybe"
    while name in df.columns:
        name += "_"
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    told = marked(df, on, key_bitmaps(keys.where(whole), on, bits) if bitmaps is None else bitmaps, name, bits)
    sure = told.where(~F.col(name) | ~whole).drop(name)
    unsure = told.where(F.col(name) & whole).drop(name).join(keys.distinct(), on, "left_anti")
    return sure.unionByName(unsure.select(*df.columns))

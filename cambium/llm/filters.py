"""Bitmap filters of bounded size over 64-bit keys, in built-in functions and for Arrow tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the largest filter: 2^26 bits are 8 MB.
FILTER_BITS = 26
_PAGE = 32768  # bits in one page of Spark's bitmaps


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def _page(bit: Column) -> Column:
    return F.floor(bit / _PAGE)


def page_bitmap(keys: DataFrame, bit: Column) -> DataFrame:
    """Rows (page, bitmap) of the bits set by ``bit``, 4 KB each."""
    return keys.groupBy(_page(bit).alias("page")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(_PAGE))).alias("bitmap"))


def bitmap_of(keys: DataFrame, key: Column, n_keys: int, most: int = FILTER_BITS) -> tuple[DataFrame, int]:
    """A bitmap with a bit for each key as rows (page, bitmap), and the power of two of its bits.

    At most 2^(most - 15) rows of 4 KB, whatever the number of keys.
    """
    bits = min(most, max(15, (16 * n_keys).bit_length()))
    return page_bitmap(keys, _bit(key, bits)), bits


def flagged(rows: DataFrame, key: Column, bitmap: DataFrame, bits: int, name: str = "_maybe") -> DataFrame:
    """All rows with a column ``name``: whether their key may be in the filter. True for all that are, and for few others."""
    out = rows.withColumn("_bit", _bit(key, bits)).withColumn("_page", _page(F.col("_bit")))
    out = out.join(F.broadcast(bitmap.withColumnRenamed("page", "_page").withColumnRenamed("bitmap", "_bitmap")), "_page", "left")
    offset = F.pmod(F.col("_bit"), F.lit(_PAGE))
    byte = F.conv(F.hex(F.substring("_bitmap", (F.floor(offset / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return out.withColumn(name, F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), offset % 8).cast("int")) != 0, F.lit(False))).drop("_bit", "_page", "_bitmap")


def may_contain(rows: DataFrame, key: Column, bitmap: DataFrame, bits: int) -> DataFrame:
    """Rows whose key may be in the filter: all that are, and few others."""
    return flagged(rows, key, bitmap, bits).where("_maybe").drop("_maybe")


def bit_array(keys: DataFrame, key: Column, most: int = FILTER_BITS) -> np.ndarray:
    """The bitmap of 64-bit hashes for tasks in Python: 16 bits for each, ``2 ** most`` bits at most."""
    bits = min(most, max(15, (16 * keys.count()).bit_length()))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for page, mine in page_bitmap(keys, F.pmod(key, F.lit(1 << bits))).collect():  # 8 MB at most, unless asked for more
        out[page * len(mine) : (page + 1) * len(mine)] = np.frombuffer(mine, np.uint8)
    return out


def holds(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the bitmap."""
    bit = hashes & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0

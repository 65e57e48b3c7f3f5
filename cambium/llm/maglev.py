"""Shard placement through a permutation-filled lookup table.

Every shard prefers the table's slots in its own order, ``offset + j * skip``
modulo a prime size, which visits each slot once. Shards take turns: at its
turn a shard claims the first slot of its order that is still free, until the
table is full. Turns keep shards within one slot of each other, and when a
shard leaves, few slots of the others move. The table has a fixed prime number
of rows whatever the data size, so it is broadcast, and a row finds its shard
by one hash and one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.llm.columns import draw60

SHARDS, SLOTS, SEED = 32, 4093, 7


def _digest(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that owns it. ``slots`` is prime and at least the number of shards."""
    if not shards or slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("needs shards, and a prime number of slots, at least one for each")
    offset = [_digest(f"offset|{s}") % slots for s in shards]
    skip = [_digest(f"skip|{s}") % (slots - 1) + 1 for s in shards]
    step, owner = [0] * len(shards), [-1] * slots
    for turn in range(slots):
        s = turn % len(shards)
        while owner[slot := (offset[s] + step[s] * skip[s]) % slots] >= 0:
            step[s] += 1
        owner[slot] = s
    return owner


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i}" for i in range(n)]


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The filled table as rows (slot, shard), ``slots`` of them."""
    rows = [(slot, s) for slot, s in enumerate(fill_table(shards, slots))]
    return spark.createDataFrame(rows, "slot int, shard int")


def place(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """``df`` with its ``slot`` and ``shard``; columns of these names are replaced.

    Null keys hash as the word "null" and share a shard; equal keys always do.
    """
    spark = df.sparkSession
    shards = shards or shard_names()
    rest = df.drop("slot", "shard").withColumn("slot", F.pmod(draw60(F.lit(seed), F.col(key)), F.lit(slots)).cast("int"))
    return rest.join(F.broadcast(lookup_table(spark, shards, slots)), "slot")

"""Consistent sharding by a permutation-filled lookup table.

Every shard walks the slots of a prime-sized table in an order of its own, (offset + j * skip) mod
size, and the shards take turns claiming their next free slot until none is left.  Slots are shared
evenly, to within one, and when a shard leaves few keys of the others move.  The table has `size`
rows, a parameter, so it is broadcast, and a key finds its shard by one hash lookup in it.

The table depends on the shard names alone.  Placement is DataFrame expressions without a shuffle.
A null key is not placed: its row stays, with null slot and shard.  Repeated keys get one shard.

An empty table gives no rows.  Further columns, whatever their names, and very long texts change nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume.llm import shared

SHARDS = tuple(f"shard-{i:03d}" for i in range(128))
SIZE = 65_537
MAX_SIZE = 1 << 21


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def preferences(shards: list[str], size: int) -> list[tuple[int, int]]:
    """(offset, skip) of each shard."""
    return [
        (_number(f"offset/{name}") % size, _number(f"skip/{name}") % (size - 1) + 1)
        for name in shards
    ]


def fill(shards: list[str], size: int = SIZE) -> list[int]:
    """The owner of each slot, as an index into `shards`.  Repeated names are refused."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not _prime(size) or not len(shards) <= size <= MAX_SIZE:
        raise ValueError(f"size must be a prime from the number of shards to {MAX_SIZE}")
    owner = [-1] * size
    steps = preferences(shards, size)
    cursor = [offset for offset, _ in steps]
    turn = 0
    for _ in range(size):
        slot, skip = cursor[turn], steps[turn][1]
        while owner[slot] >= 0:
            slot = (slot + skip) % size
        owner[slot] = turn
        cursor[turn] = (slot + skip) % size
        turn = (turn + 1) % len(shards)
    return owner


def lookup_table(spark: SparkSession, shards: list[str], size: int = SIZE) -> DataFrame:
    """(slot, shard) as a DataFrame of `size` rows."""
    order = sorted(shards)
    rows = [(slot, order[i]) for slot, i in enumerate(fill(order, size))]
    return spark.createDataFrame(rows, "_slot BIGINT, _shard STRING")


def slot_of(key: str | Column, size: int = SIZE) -> Column:
    """The slot of a key: the first 60 bits of its MD5, modulo the size."""
    column = F.col(key) if isinstance(key, str) else key
    digits = F.substring(F.md5(column.cast("string")), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % F.lit(size)


def place(
    docs: DataFrame, key: str = "doc_id", shards: list[str] = SHARDS, size: int = SIZE
) -> DataFrame:
    """Every row with its slot and shard, which replace columns of these names."""
    table = lookup_table(docs.sparkSession, list(shards), size)
    rows = docs.drop("slot", "shard")
    at, owner = shared.fresh(rows, "table_slot"), shared.fresh(rows, "table_shard")
    rows = rows.withColumn("slot", slot_of(key, size))
    table = table.withColumnsRenamed({"_slot": at, "_shard": owner})
    joined = rows.join(F.broadcast(table), F.col("slot") == F.col(at), "left")
    return joined.withColumnRenamed(owner, "shard").drop(at)


def write_shards(placed: DataFrame, path: str, pieces: int = 8) -> None:
    """One folder per shard.  Each shard is dealt to `pieces` tasks, so that none writes a whole one."""
    piece = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in placed.columns[:1]]), F.lit(pieces))
    dealt = placed.withColumn("_piece", piece).repartition("shard", "_piece").drop("_piece")
    dealt.write.partitionBy("shard").parquet(path)

"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table whose size is prime; the shards take turns, each
claiming its first slot that is still free.  Each shard thus owns as many slots as any other, give or take one, and when
a shard joins or leaves most slots keep their owner.  A document's key is hashed to a slot; the table has a fixed number
of rows (``table_size``), is broadcast, and gives the shard in constant time.  No shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Slots per shard, at least: shares of the key space then differ by one per cent at most.
SLOTS_PER_SHARD = 100


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def table_size(shards: int) -> int:
    """The smallest prime that gives each shard ``SLOTS_PER_SHARD`` slots."""
    n = shards * SLOTS_PER_SHARD
    while not _is_prime(n):
        n += 1
    return n


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], size: int) -> list[int]:
    """Owner (position in ``names``) of every slot.  ``size`` is prime and not below the number of shards."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be given and differ")
    if not _is_prime(size) or size < len(names):
        raise ValueError("the table size must be a prime not below the number of shards")
    offsets = [_number(f"{n}:offset") % size for n in names]
    skips = [_number(f"{n}:skip") % (size - 1) + 1 if size > 2 else 1 for n in names]
    nexts, table, filled = [0] * len(names), [-1] * size, 0
    while True:
        for shard, (offset, skip) in enumerate(zip(offsets, skips, strict=True)):
            slot = (offset + nexts[shard] * skip) % size
            while table[slot] >= 0:
                nexts[shard] += 1
                slot = (offset + nexts[shard] * skip) % size
            table[slot] = shard
            nexts[shard] += 1
            filled += 1
            if filled == size:
                return table


def table_rows(spark: SparkSession, names: list[str], size: int) -> DataFrame:
    """The lookup table as rows ``(slot, shard)``; ``size`` rows whatever the input."""
    return spark.createDataFrame(list(enumerate(lookup_table(names, size))), "slot long, shard long")


def place(docs: DataFrame, names: list[str], key: str = "doc_id", size: int | None = None) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (position in ``names``); input columns of those names are replaced.

    A null key is placed like the empty text, rows with equal keys share a shard, the text is not read, an empty table
    stays empty.
    """
    size = size or table_size(len(names))
    digest = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    slot = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(size)
    its, at = fresh(docs, "_its_slot", "_slot")
    keyed = docs.withColumn(its, slot).drop("slot", "shard")
    table = F.broadcast(table_rows(docs.sparkSession, names, size).withColumnRenamed("slot", at))
    others = [f"`{c}`" for c in keyed.columns if c != its]
    return keyed.join(table, F.col(its) == F.col(at)).select(*others, F.col(its).alias("slot"), "shard")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Write one folder per shard.  A shard's rows are dealt over ``files_per_shard`` tasks, so none holds a whole shard."""
    n = placed.select("shard").distinct().count() * files_per_shard
    salt = F.pmod(F.xxhash64("slot"), F.lit(files_per_shard))
    placed.repartition(max(1, n), "shard", salt).write.partitionBy("shard").parquet(path)


def manifest(placed: DataFrame) -> DataFrame:
    """Rows and slots in use of each shard."""
    return placed.groupBy("shard").agg(F.count("*").alias("n_docs"), F.countDistinct("slot").alias("n_slots"))

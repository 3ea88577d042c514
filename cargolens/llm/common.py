"""What the operators share on the Spark side."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_M_MMAP_THRESHOLD = -3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back_memory() -> None:
    """Let this Python worker return large arrays to the system as soon as they are freed.

    Else the allocator keeps the most that any step before has used, for as long as the worker is reused.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # another C library: only more memory is kept
        ctypes.CDLL(None).mallopt(_M_MMAP_THRESHOLD, 1 << 20)


def in_slots(df: DataFrame, key: Column, ids: DataFrame, max_slots: int = 1 << 27) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in ``ids`` (one column), without a shuffle of ``df``.

    Ids set bits in a bitmap of 32 bits per id, at most ``max_slots`` bits (16 MB): that bounds what
    is broadcast at any size. No row with an id in ``ids`` is lost; some others may stay, so a join
    has to follow. Null keys go.
    """
    name = ids.columns[0]
    bits = min(max_slots, max(1 << 15, 1 << (32 * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(bits)) + 1
    maps = (
        ids.filter(F.col(name).isNotNull())
        .select(slot.alias("_slot"))
        .groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    )
    mine = F.pmod(F.xxhash64(key.cast("long")), F.lit(bits)) + 1
    marked = df.withColumn("_bucket", F.bitmap_bucket_number(mine)).withColumn(
        "_at", F.bitmap_bit_position(mine)
    )
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10)
    bit = F.expr("shiftleft(1, cast(_at % 8 AS int))")
    return (
        marked.join(F.broadcast(maps), "_bucket")
        .filter(byte.cast("int").bitwiseAND(bit) != 0)
        .drop("_bucket", "_at", "_bits")
    )

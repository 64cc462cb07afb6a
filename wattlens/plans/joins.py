"""Joins that hold when one key carries a large share of the rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattlens.plans.staging import stage

SALTS = 16
BROADCAST_BYTES = 32_000_000  # of the stored files


def stored_bytes(table: DataFrame) -> int:
    """The optimizer's size of a stored table: the bytes of its files."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_join(left: DataFrame, table: DataFrame, on: list[str], spread: list[str], how: str = "left",
                null_safe: bool = False, broadcast_bytes: int = BROADCAST_BYTES, stored: bool = False) -> DataFrame:
    """Join a large table to a lookup table. The lookup table must have one row per key; others would multiply rows.

    The lookup side is computed once into a stored table, unless it is `stored` already. If its files have up to `broadcast_bytes` it
    is broadcast. Beyond that both sides shuffle, and a salt (a hash of the `spread` columns) splits every key
    of the large side into parts; the lookup rows are repeated once per salt, so the result is the same.
    """
    table = table if stored else stage(table, "lookup")
    keys = [f"_key_{i}" for i in range(len(on))]
    small = table.withColumnsRenamed(dict(zip(on, keys)))
    if stored_bytes(table) <= broadcast_bytes:
        big, small, condition = left, F.broadcast(small), F.lit(True)
    else:
        big = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
        small = small.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        condition = F.col("_salt") == F.col("_salt_r")
    for name, key in zip(on, keys):
        condition = condition & (F.col(name).eqNullSafe(F.col(key)) if null_safe else F.col(name) == F.col(key))
    return big.join(small, condition, how).drop("_salt", "_salt_r", *keys)

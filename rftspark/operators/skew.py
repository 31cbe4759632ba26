"""Joins whose big side may hold a large part of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
SALTS = 64


def join_back(
    big: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    count_column: str,
    spread_by: list[str],
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Attach one row per key to every row of ``big``; hot keys are spread over ``salts`` tasks.

    ``per_key`` holds in ``count_column`` how many rows of ``big`` share the key. Keys with
    ``hot_rows`` or more are at most ``rows / hot_rows`` many; only 8 bytes of each, a hash,
    are broadcast, 8 MB for 10**12 rows. Both sides look a key up by its hash, so a key
    that shares the hash of a hot one is salted on both and joins all the same. Rows under
    hot keys get a salt from ``spread_by``; their single row of ``per_key`` is repeated once
    per salt. All other keys join unsalted. NULL keys match each other.
    """
    keyed = [f"_k_{k}" for k in keys]
    hashed = F.xxhash64(*keys)
    hot = per_key.filter(F.col(count_column) >= hot_rows).select(hashed.alias("_hash")).distinct()
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))

    def marked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_hash", hashed).join(hot, "_hash", "left").drop("_hash")

    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(salts))).otherwise(0)
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = marked(big).withColumn("_salt", salt.cast("int")).drop("_hot")
    copies = marked(per_key).withColumn("_copy", F.explode(every)).drop("_hot")
    copies = copies.withColumnsRenamed(dict(zip(keys, keyed)))
    condition = left["_salt"] == copies["_copy"]
    for k, n in zip(keys, keyed):
        condition = condition & left[k].eqNullSafe(copies[n])
    return left.join(copies, condition, "left").drop("_salt", "_copy", count_column, *keyed)

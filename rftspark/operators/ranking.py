"""Ranks, prefixes and samples that stay distributed when one group is huge.

``first_k`` relies on Spark's window group limit: every task keeps its own first k rows of
a group before the shuffle. ``split_rank`` is the way without a bound on k: rows are range
partitioned by (group, order), so a large group covers many partitions, and the partition
totals, at most groups + partitions many, turn local ranks into global ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import GROUP_LIMIT_CONF, pinned


def order_hash(key: Column, seed: int = 42) -> Column:
    """A seeded order that depends neither on partitioning nor on the engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def first_k(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of every group."""
    if k > int(df.sparkSession.conf.get(GROUP_LIMIT_CONF, "1000")):
        # Too large for the group limit: one group could then fill one task.
        ranked = split_rank(df, by, order, "_rank")
    else:
        ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def split_rank(
    df: DataFrame,
    by: list[str],
    order: list[str],
    target: str,
    totals: dict[str, Column] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add the 1-based rank ``target`` within ``by``, and running sums, for groups of any size.

    ``totals`` maps a name to the expression whose inclusive running sum it will hold. The
    order must be total. With ``by`` empty the rank numbers the whole table.

    The partition numbers are written with the rows, so that later stages, also repeated
    ones, see the same cut.
    """
    totals = totals or {}
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not by and not totals:
        return _numbered(df, order, target, parts)
    values = {f"_v_{name}": expr for name, expr in totals.items()}
    cut = (
        df.withColumns(values or {})
        .repartitionByRange(parts, *by, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    cut = pinned(cut)
    group = ["_part", *by]
    sums = [F.count(F.lit(1)).alias("_n")] + [F.sum(v).alias(f"_s{v}") for v in values]
    per_part = cut.groupBy(*group).agg(*sums)
    # Partition totals only: at most one row per group and partition.
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *group,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_s{v}").over(before), F.lit(0)).alias(f"_b{v}") for v in values],
    )
    local = Window.partitionBy(*group).orderBy(*order)
    ranked = cut.withColumn(target, F.row_number().over(local))
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumns({f"_r{v}": F.sum(v).over(running) for v in values})
    keyed = offsets.withColumnsRenamed({g: f"_o{g}" for g in group})
    same = F.lit(True)
    for g in group:
        same = same & ranked[g].eqNullSafe(keyed[f"_o{g}"])
    joined = ranked.join(keyed, same)
    return joined.select(
        *df.columns,
        (F.col(target) + F.col("_before")).alias(target),
        *[(F.col(f"_r_v_{n}") + F.col(f"_b_v_{n}")).alias(n) for n in totals],
    )


def _numbered(df: DataFrame, order: list[str], target: str, parts: int) -> DataFrame:
    """The rank in the whole table with one exchange of the rows.

    Every range is sorted before it is written, so a row's position there is known without
    another shuffle; the rows of the ranges before it are one number per range.
    """
    at = F.monotonically_increasing_id()
    ranges = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    cut = pinned(ranges.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so at most ``parts``.
    sizes = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    position = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = cut.join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, (position + F.col("_before") + 1).alias(target))


def dense_index(df: DataFrame, order: list[str], target: str) -> DataFrame:
    """0-based position of every row in the given total order, without a single-task sort."""
    return split_rank(df, [], order, target).withColumn(target, F.col(target) - 1)


def sample_rows(df: DataFrame, key: str, amount: float, seed: int = 42) -> DataFrame:
    """Exactly ``amount`` rows, or that share below 1, in the seeded order of a unique key.

    Counts per leading hash digits (65,536 buckets) show which buckets are in as a whole;
    only the one the limit cuts is ranked.
    """
    marked = df.withColumn("_hash", order_hash(F.col(key), seed)).withColumn(
        "_bucket", F.substring("_hash", 1, 4)
    )
    sizes = marked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(F.lit(0))
    limit = F.floor(F.lit(amount) * F.sum("_size").over(everything)) if amount < 1 else F.lit(int(amount))
    # 65,536 rows at most.
    edges = sizes.select(
        "_bucket", (F.sum("_size").over(upto)).alias("_end"), F.col("_size"), limit.alias("_limit")
    ).filter(F.col("_end") - F.col("_size") < F.col("_limit"))
    near = marked.join(F.broadcast(edges), "_bucket")
    whole = near.filter(F.col("_end") <= F.col("_limit")).select(*df.columns)
    # Copies of one key share a bucket, so it may be large; the row hash tells them apart.
    plain = [n for n, kind in df.dtypes if not kind.startswith("map")]
    cut = near.filter(F.col("_end") > F.col("_limit")).withColumn("_tie", F.xxhash64(*plain))
    cut = split_rank(cut, ["_bucket"], ["_hash", key, "_tie"], "_rank").filter(
        F.col("_rank") <= F.col("_limit") - (F.col("_end") - F.col("_size"))
    )
    return whole.unionByName(cut.select(*df.columns))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in a seeded order that does not change with the partitioning."""
    return df.orderBy(order_hash(F.col(key), seed), key)


def keep_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in the given order.

    A rank, not an aggregate of whole rows, so that columns nobody reads later stay out of the shuffle.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1).drop("_rank")

"""Stop rules and quotas of difficulty-aware rejection sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import GROUP_LIMIT_CONF
from .ranking import first_k, split_rank

StopRule = Callable[[Column, Column, Column, Column], Column]


def _col(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def stop_reason(
    n_trials: Column,
    n_corrects: Column,
    max_n_trials: Column | int,
    min_n_corrects: Column | int,
    strict: bool = True,
) -> Column:
    """Why a query needs no more samples; NULL while it does.

    A limit that is zero, negative or NULL does not apply. ``strict`` stops a query only
    when it has *more* corrects than asked for.
    """
    most, enough = _col(max_n_trials), _col(min_n_corrects)
    reached = n_corrects > enough if strict else n_corrects >= enough
    return F.when((most > 0) & (n_trials >= most), F.lit("max_n_trials")).when(
        (enough > 0) & reached, F.lit("max_n_corrects")
    )


def replay(
    pool: DataFrame,
    by: list[str],
    order: list[str],
    max_n_trials: int = 0,
    min_n_corrects: int = 0,
    rounds_per_batch: int = 1,
    n_trials: str | None = None,
    n_corrects: str | None = None,
    rule: StopRule = stop_reason,
    partitions: int | None = None,
) -> DataFrame:
    """The responses of a pool that stop-controlled sampling would have requested.

    Trials count when they are scheduled, corrects only once their batch is graded, so all
    rounds of a batch see the corrects before it. Adds ``trial`` and ``corrects_before``.
    ``n_trials`` and ``n_corrects`` name columns with the counters a query starts from.

    With ``max_n_trials`` every task keeps that many rows per query before the shuffle. Without
    it a query has no bound, so ranks and running sums are built per range partition.
    """
    t0 = F.col(n_trials) if n_trials else F.lit(0)
    c0 = F.col(n_corrects) if n_corrects else F.lit(0)
    hit = F.coalesce(F.col("correct"), F.lit(False)).cast("long")
    limit = int(pool.sparkSession.conf.get(GROUP_LIMIT_CONF, "1000"))
    if 0 < max_n_trials <= limit and rule is stop_reason and partitions is None:
        arrival = Window.partitionBy(*by).orderBy(*order)
        ranked = pool.withColumn("trial", F.row_number().over(arrival)).filter(
            F.col("trial") <= max_n_trials
        )
        ranked = ranked.withColumn("_batch", F.floor((F.col("trial") - 1) / rounds_per_batch))
        earlier = Window.partitionBy(*by).orderBy("_batch").rangeBetween(Window.unboundedPreceding, -1)
        ranked = ranked.withColumn("corrects_before", F.coalesce(F.sum(hit).over(earlier), F.lit(0)))
    else:
        ranked = split_rank(pool, by, order, "trial", {"_seen": hit}, partitions)
        ranked = ranked.withColumn("_batch", F.floor((F.col("trial") - 1) / rounds_per_batch))
        # The running sum up to a batch is the one behind its first row, less that row's own hit.
        first = (F.col("trial") - 1) % rounds_per_batch == 0
        # A batch holds rounds_per_batch rows, whatever the size of its query.
        same_batch = Window.partitionBy(*by, "_batch")
        ranked = ranked.withColumn(
            "corrects_before", F.max(F.when(first, F.col("_seen") - hit)).over(same_batch)
        ).drop("_seen")
    going = rule(
        F.col("trial") - 1 + t0, F.col("corrects_before") + c0, F.lit(max_n_trials), F.lit(min_n_corrects)
    ).isNull()
    if rule is not stop_reason:
        # A rule of one's own may hold again later; a query that stopped stays stopped.
        names = [f"_by{i}" for i in range(len(by))]
        stops = ranked.filter(~going).groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)]).agg(
            F.min("trial").alias("_stop")
        )
        same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)]
        ranked = ranked.join(stops, same, "left").filter(F.col("_stop").isNull() | (F.col("trial") < F.col("_stop")))
        return ranked.drop("_batch", "_stop", *names)
    return ranked.filter(going).drop("_batch")


def counters(pool: DataFrame, by: list[str]) -> DataFrame:
    """``n_trials`` and ``n_corrects`` per query."""
    return pool.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.sum(F.coalesce(F.col("correct"), F.lit(False)).cast("long")).alias("n_corrects"),
    )


def progress(status: DataFrame, max_n_trials: int, min_n_corrects: int, rule: StopRule = stop_reason) -> DataFrame:
    """How many queries met their quota or ran out of trials."""
    reason = rule(F.col("n_trials"), F.col("n_corrects"), F.lit(max_n_trials), F.lit(min_n_corrects))
    marked = status.withColumn("_reason", reason)
    return marked.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.sum(F.coalesce(F.col("_reason") == "max_n_corrects", F.lit(False)).cast("long")).alias("n_achieved"),
        F.sum(F.coalesce(F.col("_reason") == "max_n_trials", F.lit(False)).cast("long")).alias("n_quit"),
    ).withColumns(
        {
            "achieve_rate": F.col("n_achieved") / F.col("n_queries"),
            "quit_rate": F.col("n_quit") / F.col("n_queries"),
        }
    )


def difficulty(pool: DataFrame, by: list[str]) -> DataFrame:
    """Trials, corrects, ``pass_rate`` and ``fail_rate`` per query; ungraded rows do not count."""
    return (
        pool.groupBy(*by)
        .agg(
            F.count("correct").alias("n_trials"),
            F.sum(F.col("correct").cast("long")).alias("n_corrects"),
            F.avg(F.col("correct").cast("double")).alias("pass_rate"),
        )
        .withColumn("fail_rate", 1 - F.col("pass_rate"))
    )


def uniform_quota(pool: DataFrame, by: list[str], order: list[str], k_u: int) -> DataFrame:
    """``k_u`` correct responses for every query."""
    return first_k(pool.filter("correct"), by, order, k_u)


def shortfall(pool: DataFrame, by: list[str], k_u: int) -> DataFrame:
    """Corrects that queries still miss, queries without any correct response included."""
    return difficulty(pool, by).select(
        *by, F.coalesce(F.col("n_corrects"), F.lit(0)).alias("n_corrects"),
        F.greatest(F.lit(0), F.lit(k_u) - F.coalesce(F.col("n_corrects"), F.lit(0))).alias("shortfall"),
    )


def proportional_targets(rates: DataFrame, k_p: int) -> DataFrame:
    """Add ``target``: proportional to ``fail_rate``, ``k_p`` for the hardest, at least 1.

    The largest rate is a scalar subquery, not a window over all queries.
    """
    top = rates.agg(F.max("fail_rate")).scalar()
    share = F.col("fail_rate") / F.nullif(top, F.lit(0.0))
    target = F.greatest(F.lit(1), F.ceil(F.round(F.lit(k_p) * share, 9)).cast("int"))
    return rates.withColumn("target", target)


def proportional_quota(pool: DataFrame, by: list[str], order: list[str], k_p: int) -> DataFrame:
    """Correct responses per query in proportion to its difficulty. A null key is a query of its own."""
    targets = proportional_targets(difficulty(pool, by), k_p)
    targets = targets.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col("target").alias("_target"))
    # Cut to k_p rows per query first: what then meets the targets is bounded and even.
    candidates = first_k_ranked(pool.filter("correct"), by, order, k_p)
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)]
    return candidates.join(targets, same).filter(F.col("_rank") <= F.col("_target")).select(*pool.columns)


def first_k_ranked(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """``first_k`` that keeps the rank in ``_rank``."""
    if k > int(df.sparkSession.conf.get(GROUP_LIMIT_CONF, "1000")):
        ranked = split_rank(df, by, order, "_rank")
    else:
        ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= k)


def vanilla(pool: DataFrame, by: list[str], order: list[str], trials: int = 52) -> DataFrame:
    """Baseline: the same number of trials for every query, corrects kept."""
    return first_k(pool, by, order, trials).filter("correct")


def retry_budget(pool: DataFrame, by: list[str], order: list[str], first: int = 64) -> DataFrame:
    """The next rows of a query, one for each failure among its ``first`` ones.

    A query has at most ``first`` retries, so ``2 * first`` rows of it are enough.
    """
    window = first_k_ranked(pool, by, order, 2 * first)
    failed = F.sum(
        F.when((F.col("_rank") <= first) & ~F.coalesce(F.col("correct"), F.lit(False)), 1).otherwise(0)
    ).over(Window.partitionBy(*by))
    return (
        window.withColumn("_failed", failed)
        .filter((F.col("_rank") > first) & (F.col("_rank") <= first + F.col("_failed")))
        .drop("_rank", "_failed")
    )


def remaining_work(
    queries: DataFrame,
    status: DataFrame,
    by: list[str],
    max_n_trials: int,
    min_n_corrects: int,
    rule: StopRule = stop_reason,
) -> DataFrame:
    """Queries that need more samples, with their counters."""
    counted = queries.join(status.select(*by, "n_trials", "n_corrects"), by, "left").fillna(
        0, subset=["n_trials", "n_corrects"]
    )
    reason = rule(F.col("n_trials"), F.col("n_corrects"), F.lit(max_n_trials), F.lit(min_n_corrects))
    return counted.filter(reason.isNull())

"""The sampling loop as streams: grade what arrives, stop queries, hand out what is left."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators.grading import grade
from ..operators.quotas import StopRule, remaining_work, stop_reason
from ..runtime import pinned


def read_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json", **options: object) -> DataFrame:
    """New files of a directory; ``maxFilesPerTrigger`` sets the batch size."""
    return spark.readStream.schema(schema).options(**options).format(kind).load(path)


def grade_stream(responses: DataFrame, **options: object) -> DataFrame:
    """Stateless grading of arriving responses."""
    return grade(responses, dedup=False, **options)


def append_sink(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Process what is there, append it once, and end; a restart continues behind it."""
    return (
        df.writeStream.format(kind)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stop_stream(
    graded: DataFrame,
    by: list[str],
    order: list[str],
    max_n_trials: int,
    min_n_corrects: int,
    status: DataFrame | None = None,
    rule: Callable[[int, int], object] | None = None,
) -> DataFrame:
    """Per query and micro-batch: what was kept, and the counters behind it.

    State is one pair of counters per query. As in the batch replay, all responses of a
    micro-batch see the corrects before it. ``status`` (``by``, ``n_trials``, ``n_corrects``)
    gives counters to start from, one row per query at most; other queries start at 0.
    ``rule(trials, corrects)`` in place of the limit of corrects stops a query when it returns
    something true; a stopped query stays stopped. Only keys, order and grade of a row go through Python.

    With a trial limit a task holds no more rows of a query than it may still take. Without
    one it holds one Arrow batch, and rows of a micro-batch are numbered as they arrive.
    """
    fields = [graded.schema[c] for c in by]
    order_fields = [graded.schema[c] for c in order]
    out = T.StructType(
        fields
        + order_fields
        + [
            T.StructField("correct", T.BooleanType()),
            T.StructField("trial", T.LongType()),
            T.StructField("corrects_before", T.LongType()),
        ]
    )
    names = out.fieldNames()
    state = T.StructType(
        [T.StructField("n_trials", T.LongType()), T.StructField("n_corrects", T.LongType()), T.StructField("stopped", T.BooleanType())]
    )

    def stops(trials: int, corrects: int) -> bool:
        enough = rule(trials, corrects) if rule is not None else 0 < min_n_corrects < corrects
        return bool(enough) or 0 < max_n_trials <= trials

    def advance(key: tuple, batches: Iterator[pd.DataFrame], counters: GroupState) -> Iterator[pd.DataFrame]:
        trials = seen = gained = 0
        stopped, started = False, False
        best: pd.DataFrame | None = None

        def take(rows: pd.DataFrame) -> pd.DataFrame:
            """The rows before the query stops, numbered; moves the counters."""
            nonlocal trials, gained, stopped
            n = len(rows)
            if rule is not None or max_n_trials > 0:
                n = next((i for i in range(n) if stops(trials + i, seen)), n)
                stopped = stopped or n < len(rows)
            kept = {c: rows[c].array[:n] for c in names[:-2]}
            kept["trial"] = np.arange(trials + 1, trials + 1 + n)
            kept["corrects_before"] = np.full(n, seen)
            trials, gained = trials + n, gained + int(rows["correct"].iloc[:n].eq(True).sum())
            return pd.DataFrame(kept, copy=False)

        for pdf in batches:
            if not started:
                old = counters.get if counters.exists else (int(pdf["_trials"].iat[0]), int(pdf["_corrects"].iat[0]), False)
                (trials, seen), started = old[:2], True
                stopped = bool(old[2]) or stops(trials, seen)
            if stopped:
                continue
            pdf = pdf.sort_values(order, kind="stable")
            if max_n_trials <= 0:
                yield take(pdf)
            else:
                best = pdf if best is None else pd.concat([best, pdf]).sort_values(order, kind="stable")
                best = best.head(max_n_trials - trials)
        if best is not None:
            yield take(best)
        if started:
            counters.update((trials, seen + gained, stopped))

    narrow = graded.select(*by, *order, "correct")
    start = [F.lit(0).cast("long").alias("_trials"), F.lit(0).cast("long").alias("_corrects")]
    if status is not None:
        known = status.select(*by, F.col("n_trials").alias("_t"), F.col("n_corrects").alias("_c"))
        narrow = narrow.join(known, by, "left")
        start = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(n) for c, n in (("_t", "_trials"), ("_c", "_corrects"))]
    return narrow.select(*by, *order, "correct", *start).groupBy(*by).applyInPandasWithState(
        advance, out, state, "append", GroupStateTimeout.NoTimeout
    )


def replay_batches(
    batch: DataFrame, status: DataFrame, by: list[str], order: list[str], max_n_trials: int, min_n_corrects: int,
    rule: StopRule = stop_reason,
) -> DataFrame:
    """One micro-batch against a status table, all native: the rows to keep.

    ``status`` holds ``n_trials`` and ``n_corrects`` per query; queries without a row start at 0.
    """
    known = batch.join(status.select(*by, "n_trials", "n_corrects"), by, "left").fillna(
        0, subset=["n_trials", "n_corrects"]
    )
    ranked = known.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    if max_n_trials > 0:
        ranked = ranked.filter(F.col("_rank") <= max_n_trials)
    going = rule(
        F.col("n_trials") + F.col("_rank") - 1, F.col("n_corrects"), F.lit(max_n_trials), F.lit(min_n_corrects)
    ).isNull()
    return ranked.filter(going).select(
        *batch.columns, (F.col("n_trials") + F.col("_rank")).alias("trial"), F.col("n_corrects").alias("corrects_before")
    )


def progress_stream(kept: DataFrame, by: list[str]) -> DataFrame:
    """Live counters per query; run it in update or complete mode."""
    return kept.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.sum(F.col("correct").cast("long")).alias("n_corrects"),
    )


def work_batches(
    queries: DataFrame, status: DataFrame, by: list[str], max_n_trials: int, min_n_corrects: int,
    paths_per_batch: int = 2**14, partitions: int | None = None,
) -> DataFrame:
    """Unfinished queries, fewest trials first, cut into batches of ``paths_per_batch``."""
    from ..operators.ranking import split_rank

    left = remaining_work(queries, status, by, max_n_trials, min_n_corrects)
    numbered = split_rank(left, [], ["n_trials", *by], "_no", partitions=partitions)
    return numbered.withColumn("batch_no", F.floor((F.col("_no") - 1) / paths_per_batch)).drop("_no")


def hand_out(
    kept: DataFrame, queries: DataFrame, by: list[str], max_n_trials: int, min_n_corrects: int,
    target: str, checkpoint: str, render: Callable[[DataFrame], DataFrame] = lambda df: df, paths_per_batch: int = 2**14,
) -> StreamingQuery:
    """After every micro-batch write the work that is left, one directory per batch number."""

    def publish(status: DataFrame, batch_id: int) -> None:
        # Written first: numbering reads it twice, and each time the stream's state would be worked out anew.
        work = work_batches(queries, pinned(status), by, max_n_trials, min_n_corrects, paths_per_batch)
        render(work).write.mode("overwrite").parquet(f"{target}/round={batch_id}")

    return (
        progress_stream(kept, by)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
    )

"""Tool transcripts: code cells and their outputs inside a response text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext
from ..functions.extract import explicit_answer
from ..functions.text import middle_cut


@dataclass(frozen=True)
class CellMarks:
    """Fences around code cells and outputs, and the limits of a transcript."""

    input_begin: str = "```python"
    input_end: str = "```"
    output_begin: str = "```output"
    output_end: str = "```"
    max_n_calls: int = 0
    trunc_len: tuple[int, int] = (0, 0)
    ellipsis: str = "..."


PYTHON = CellMarks()


def _times(text: Column, mark: str) -> Column:
    """Occurrences of a literal that cannot overlap itself."""
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)


def state(df: DataFrame, text: str = "text", marks: CellMarks = PYTHON) -> DataFrame:
    """Add counts of cells and outputs and ``state``: 1 nothing to run, 2 too many outputs, 0 pending."""
    inputs = _times(F.col(text), marks.input_begin).cast("int")
    outputs = _times(F.col(text), marks.output_begin).cast("int")
    return df.withColumns({"n_inputs": inputs, "n_outputs": outputs}).withColumn(
        "state",
        F.when(F.col("n_inputs") == F.col("n_outputs"), 1)
        .when(F.col("n_outputs") > F.col("n_inputs"), 2)
        .otherwise(0),
    )


def stop_reason(
    df: DataFrame, text: str = "text", n_tokens: str = "n_tokens", max_len: int = 4096, marks: CellMarks = PYTHON
) -> DataFrame:
    """Add ``stop_reason`` of a transcript; NULL while it goes on."""
    explicit = explicit_answer(sqltext.col(text)).column().isNotNull()
    calls = F.lit(marks.max_n_calls > 0) & (F.col("n_outputs") >= marks.max_n_calls)
    return state(df, text, marks).withColumn(
        "stop_reason",
        F.when((F.col("state") == 1) | explicit, "finished")
        .when(F.col("state") == 2, "over-output")
        .when(calls, "call")
        .when(F.col(n_tokens) >= 0.8 * max_len, "total-length"),
    )


def cells(df: DataFrame, text: str = "text", marks: CellMarks = PYTHON) -> DataFrame:
    """One row per code cell: adds ``cell_no`` (from 0) and ``cell``; empty cells go.

    A piece counts when it holds a closing fence, also the one before the first opening.
    """
    pieces = F.split(F.col(text), r"\Q" + marks.input_begin + r"\E", -1)
    closed = F.filter(pieces, lambda p: p.contains(marks.input_end))
    bodies = F.transform(closed, lambda p: F.substring_index(p, marks.input_end, 1))
    trimmed = F.transform(bodies, lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return df.select(
        *df.columns, F.posexplode(F.filter(trimmed, lambda p: p != "")).alias("cell_no", "cell")
    )


def tool_output(stdout: Column, stderr: Column) -> Column:
    return F.when(F.coalesce(stderr, F.lit("")) == "", stdout).otherwise(F.concat(stdout, F.lit("\n"), stderr))


def wrapped(output: Column, marks: CellMarks = PYTHON) -> Column:
    return F.concat(F.lit(marks.output_begin + "\n"), output, F.lit("\n" + marks.output_end))


def truncated(df: DataFrame, column: str, marks: CellMarks = PYTHON) -> DataFrame:
    """Long outputs keep their head and tail."""
    head, tail = marks.trunc_len
    return df.withColumn(column, middle_cut(sqltext.col(column), head, tail, marks.ellipsis).column())


def assemble(calls: DataFrame, by: list[str], marks: CellMarks = PYTHON) -> DataFrame:
    """Join model texts and wrapped outputs of a response in call order.

    Needs ``call_no``, ``text`` and ``output`` (NULL behind the last text). A response has
    few calls, so its texts fit one row.
    """
    turn = F.concat(
        F.col("text"),
        F.coalesce(F.concat(F.lit("\n"), wrapped(F.col("output"), marks), F.lit("\n")), F.lit("")),
    )
    ordered = F.array_sort(F.collect_list(F.struct("call_no", turn.alias("turn"))))
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.array_join(F.transform(ordered, lambda t: t["turn"]), "").alias("transcript"),
    )

"""Extract, normalise and grade answers of a response table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sqltext
from ..functions.equality import DEFAULT, Tolerance, add_verdict
from ..functions.extract import raw_answer
from ..functions.normalize import normalize
from ..functions.olympiad import add_olympiad_verdict
from .skew import join_back

TRUNCATED = ("length", "abort")


def with_column(df: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    """``df`` with an optional column present."""
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(kind))


def extract_answers(df: DataFrame, strict: bool = False, keep: bool = False) -> DataFrame:
    """Add ``ans``: the normalised final answer of ``resp``.

    ``strict`` takes announced answers only; ``keep`` leaves answers that are already there.
    """
    df = df.withColumn("_raw", raw_answer(sqltext.col("resp"), strict).column())
    df = normalize(df, {"_raw": "_found"})
    found = F.coalesce(F.col("ans"), F.col("_found")) if keep and "ans" in df.columns else F.col("_found")
    return df.withColumn("ans", found).drop("_raw", "_found")


def normalize_answers(df: DataFrame, column: str = "ans", target: str = "ans_norm") -> DataFrame:
    return normalize(df, {column: target})


def wants_set(query: Column) -> Column:
    """The question asks for a set of values."""
    return query.contains("ind the") | (query.contains("all") & query.contains("separate"))


def grade_pairs(pairs: DataFrame, tol: Tolerance = DEFAULT, strict: bool = False, use_olympiad: bool = True) -> DataFrame:
    """Grade rows of (``_raw``, ``ref_ans``, ``ref_num``, ``_set``, ``_olympiad``, ``_tols``).

    Adds ``ans``, ``ans_norm``, ``ref_norm``, ``correct`` and ``match_tier``.
    """
    df = normalize(pairs, {"_raw": "ans"})
    df = normalize(df, {"ans": "ans_norm", "ref_ans": "ref_norm"})
    df = add_verdict(df, "ref_ans", "ref_norm", "ref_num", "ans", "ans_norm", sqltext.col("_set"), tol)
    if not use_olympiad:
        return df
    df = add_olympiad_verdict(df, "ref_ans", "ans", "_tols", "_olympiad_correct")
    return df.withColumns(
        {
            "correct": F.when(F.col("_olympiad"), F.col("_olympiad_correct")).otherwise(F.col("correct")),
            "match_tier": F.when(F.col("_olympiad"), F.lit("olympiad")).otherwise(F.col("match_tier")),
        }
    ).drop("_olympiad_correct")


def grade(
    responses: DataFrame,
    mode: str = "auto",
    tol: Tolerance = DEFAULT,
    strict: bool = False,
    dedup: bool = False,
    evaluator: Callable[[DataFrame], DataFrame] | None = None,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Grade a response table: adds ``ans``, ``ans_norm``, ``ref_norm``, ``correct``, ``match_tier``.

    Needs ``query``, ``ref_ans`` and ``resp``; uses ``ref_num``, ``abs_tol``, ``dataset`` and
    ``finish_reason`` where present. ``mode`` is ``math``, ``olympiad`` or ``auto`` (by
    dataset name).

    ``dedup`` grades each distinct (reference, answer) pair once and joins the verdict
    back: pools repeat few answers, so this saves most of the work, at the price of one
    more scan and one shuffle of the rows. ``dedup=False`` is one scan without shuffle, the better
    plan for very wide rows; streams need it. ``evaluator`` replaces the built-in tiers and
    sees the pair table.
    """
    new = ["ans", "ans_norm", "ref_norm", "correct", "match_tier"]
    df = with_column(responses.drop(*new), "ref_num", "double")
    df = with_column(df, "finish_reason", "string")
    df = with_column(df, "abs_tol", "double")
    df = with_column(df, "dataset", "string")
    olympiad = {"math": F.lit(False), "olympiad": F.lit(True)}.get(
        mode, F.coalesce(F.col("dataset").contains("olympiad"), F.lit(False))
    )
    tols = F.col("abs_tol") if dict(df.dtypes)["abs_tol"].startswith("array") else F.array("abs_tol")
    work = df.withColumns(
        {
            "_raw": raw_answer(sqltext.col("resp"), strict).column(),
            "_set": F.coalesce(wants_set(F.col("query")), F.lit(False)),
            "_olympiad": olympiad,
            "_tols": F.when(olympiad, tols),
        }
    )
    if evaluator is None:
        def evaluator(pairs: DataFrame) -> DataFrame:
            return grade_pairs(pairs, tol, strict, use_olympiad=mode != "math")

    keys = ["_raw", "ref_ans", "ref_num", "_set", "_olympiad", "_tols"]
    if dedup:
        pairs = work.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        # Few bytes but much work per pair: a fixed number of tasks, not one sized by bytes.
        tasks = int(responses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = pairs.repartition(tasks, *keys)
        spread = [n for n, kind in df.dtypes if not kind.startswith("map")]
        graded = join_back(work, evaluator(pairs), keys, "_rows", spread, hot_rows)
    else:
        graded = evaluator(work)
    cut = F.col("finish_reason").isin(*TRUNCATED)
    graded = graded.withColumns(
        {
            "correct": F.when(cut, F.lit(False)).otherwise(F.col("correct")),
            "match_tier": F.when(cut, F.lit("truncated")).otherwise(F.col("match_tier")),
        }
    )
    return graded.select(*[c for c in responses.columns if c not in new], *new)


def undecided_rate(graded: DataFrame) -> DataFrame:
    """Share of responses that no tier could decide: what a symbolic check might change."""
    return graded.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("match_tier") == "none").cast("long")).alias("n_undecided"),
        F.avg((F.col("match_tier") == "none").cast("double")).alias("undecided_rate"),
    )


def python_evaluator(equal: Callable[[str, str], bool]) -> Callable[[DataFrame], DataFrame]:
    """Evaluator hook for a Python ``equal(ref, ans)``, run on distinct pairs only.

    An exception counts as a wrong answer, as does a falsy result.
    """

    def one(ref: str, ans: str) -> bool | None:
        if ref is None:
            return None
        try:
            return bool(equal(ref, ans))
        except Exception:
            return False

    def verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(correct=[one(r, a) for r, a in zip(pdf["ref_ans"], pdf["ans"])])

    def evaluate(pairs: DataFrame) -> DataFrame:
        df = normalize(pairs, {"_raw": "ans"}).withColumns(
            {"ans_norm": F.col("ans"), "ref_norm": F.col("ref_ans"), "match_tier": F.lit("custom")}
        )
        fields = [*df.schema.fields, T.StructField("correct", T.BooleanType())]
        return df.mapInPandas(verdicts, T.StructType(fields))

    return evaluate

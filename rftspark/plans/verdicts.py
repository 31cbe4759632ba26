"""Verdicts kept across runs: a pair of reference and answer is graded once, whatever pool it comes from."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.equality import DEFAULT, Tolerance
from ..operators.grading import grade, grade_pairs
from ..runtime import pinned
from ..sources.files import append_once, read_batches

PAIR = ("_raw", "ref_ans", "ref_num", "_set", "_olympiad", "_tols")
_TEXTS = [T.StructField(n, T.StringType()) for n in ("_pair", "ans", "ans_norm", "ref_norm", "match_tier")]
VERDICT = T.StructType([*_TEXTS, T.StructField("correct", T.BooleanType())])


def store_path(home: str, tol: Tolerance, use_olympiad: bool, rules: str) -> str:
    """Verdicts under other settings are other verdicts, so each setting has a folder of its own."""
    return f"{home.rstrip('/')}/verdicts-{hashlib.sha256(repr((tol, use_olympiad, rules)).encode()).hexdigest()[:16]}"


def stored(
    home: str, tol: Tolerance = DEFAULT, use_olympiad: bool = True, rules: str = "1"
) -> Callable[[DataFrame], DataFrame]:
    """Evaluator for ``grade`` that grades the pairs its store does not hold and appends them to it.

    A pair goes by the SHA-256 of all that its verdict depends on. ``rules`` names the grammar: give it another
    value when its rules change. Runs while the plan is built: the distinct pairs are written once, then the new
    ones among them. Two runs at a time may grade one pair twice; either verdict is the same, and one is read.
    """

    def evaluate(pairs: DataFrame) -> DataFrame:
        spark = pairs.sparkSession
        path = store_path(home, tol, use_olympiad, rules)
        named = pinned(pairs.withColumn("_pair", F.sha2(F.to_json(F.struct(*PAIR)), 256)))
        known = read_batches(spark, path, VERDICT)
        fresh = named.join(known, "_pair", "left_anti")
        if not fresh.isEmpty():
            # Few bytes but much work per pair, so tasks are not sized by bytes.
            fresh = fresh.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_pair")
            verdicts = grade_pairs(fresh, tol, use_olympiad=use_olympiad)
            append_once(verdicts.select(*VERDICT.names), path, uuid.uuid4().hex)
            known = read_batches(spark, path, VERDICT)
        return named.join(known.dropDuplicates(["_pair"]), "_pair").drop("_pair")

    return evaluate


def grade_stored(
    responses: DataFrame, home: str, mode: str = "auto", tol: Tolerance = DEFAULT, strict: bool = False, rules: str = "1"
) -> DataFrame:
    """``grade`` with verdicts kept under ``home``: what an earlier run has graded is read, not graded again."""
    evaluator = stored(home, tol, mode != "math", rules)
    return grade(responses, mode, tol, strict, dedup=True, evaluator=evaluator)

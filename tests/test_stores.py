"""Append ledger and verdict store: repeated, killed and changed runs."""

from __future__ import annotations

import pytest

from rftspark.functions.equality import Tolerance
from rftspark.operators.grading import grade
from rftspark.plans import verdicts
from rftspark.sources import files

ROWS = "query string, ref_ans string, resp string, dataset string"


def _pool(spark, answers):
    rows = [(f"q{i}", ref, None if a is None else f"The answer is {a}.", "math") for i, (ref, a) in enumerate(answers)]
    return spark.createDataFrame(rows, ROWS)


def _values(df):
    return sorted(map(str, df.collect()))


def test_repeated_append_adds_nothing(spark, tmp_path):
    path, one = str(tmp_path), spark.range(3)
    assert files.read_batches(spark, path, one.schema).count() == 0
    assert files.append_once(one, path, "a/1") and not files.append_once(one, path, "a/1")
    assert files.append_once(spark.range(3, 5), path, "a/2") and files.append_once(spark.range(0), path, "none")
    assert sorted(r.id for r in files.read_batches(spark, path, one.schema).collect()) == [0, 1, 2, 3, 4]


def test_killed_append_is_not_read_and_can_be_repeated(spark, tmp_path):
    path, rows = str(tmp_path), spark.range(4)
    rows.write.parquet(files._batch_home(path, "b"))  # killed before its line in the ledger
    assert files.read_batches(spark, path, rows.schema).count() == 0
    broken = spark.range(4).selectExpr("if(id = 3, raise_error('lost'), id) as id")
    with pytest.raises(Exception, match="lost"):
        files.append_once(broken, path, "b")
    assert files.append_once(rows, path, "b")
    assert sorted(r.id for r in files.read_batches(spark, path, rows.schema).collect()) == [0, 1, 2, 3]


def test_second_run_grades_no_pair(spark, tmp_path, monkeypatch):
    home, graded = str(tmp_path), []
    plain = verdicts.grade_pairs

    def counted(pairs, *args, **options):
        graded.append(pairs.count())
        return plain(pairs, *args, **options)

    monkeypatch.setattr(verdicts, "grade_pairs", counted)
    pool = _pool(spark, [("1/2", "0.5"), ("1/2", "0.5"), ("3", "4"), (None, "4"), ("7", None), ("2", "2")])
    assert _values(verdicts.grade_stored(pool, home)) == _values(grade(pool)) and graded == [5]
    assert _values(verdicts.grade_stored(pool, home)) == _values(grade(pool)) and graded == [5]
    more = pool.union(_pool(spark, [("9", "9"), ("3", "4")]))
    assert _values(verdicts.grade_stored(more, home)) == _values(grade(more)) and graded == [5, 1]
    loose = Tolerance(rel=0.5, abs=2.0)
    assert _values(verdicts.grade_stored(pool, home, tol=loose)) == _values(grade(pool, tol=loose)) and graded == [5, 1, 5]
    assert verdicts.grade_stored(pool.limit(0), home).count() == 0

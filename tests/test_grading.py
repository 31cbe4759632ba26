"""Equality, normalisation and extraction cases, worked out by hand."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from rftspark.functions import extract, fixed, sqltext, values
from rftspark.functions import normalize as forms
from rftspark.functions.equality import add_verdict
from rftspark.functions.extract import boxed_lenient, boxed_strict, raw_answer
from rftspark.functions.normalize import normal_math, normalize, unwrap_all
from rftspark.operators import grading

# reference, number given with it, answer, set question, expected
CASES = [
    (r"251,7\\ \noindent", None, "0", False, False),
    (r"3.54*10^{-7}", None, "3.54e-07", False, True),
    (r"\frac{1}{2}", None, "0.5", False, True),
    ("1", None, "100", False, False),
    ("100", None, "1", False, False),
    ("3.04", None, "0.0304", False, True),
    ("0.0304", 0.0304, "3.04", False, True),
    ("x<-1", None, "x>3", False, False),
    (r"(-\infty,0)\cup(0,\infty)", None, r"(-\infty,0)\cup(0,\infty)", False, True),
    ("1+2,2+1", None, "2+1,1+2", False, True),
    ("5", None, "5", False, True),
    ("0.30000000000000004", None, "0.3", False, True),
    ("C", None, "C", False, True),
    ("1,234", None, "1234", False, True),
    ("12,34", None, "(12,34)", False, True),
    (r"\$ 5", None, "5", False, True),
    (r"3 * \sqrt{13}", None, r"3\sqrt{13}", False, True),
    (r"\pi/2", None, r"\frac{\pi}{2}", False, True),
    (r"(3,\pi/2)", None, r"(3,\frac{\pi}{2})", False, True),
    ("23000", None, r"\$23{,}000", False, True),
    (r"\left(1,2\right)", None, r"\left(2,1\right)", True, True),
    ("White", None, "white", False, True),
    ("[0,3)", None, "[0,1]", False, False),
    ("[0,1]", None, "[0,3)", False, False),
    ("1001.5", None, "1001", False, False),
    (r"\frac{2003}{2}", None, "1001", False, False),
    (r"\begin{array}1\\2\end{array}", None, "1,2", False, True),
    ("{1,2}", None, "{2,1}", True, True),
    ("no", None, "false", False, True),
    (r"\begin{pmatrix}\frac{1}{2}&0\\0&1\end{pmatrix}", None, r"\begin{bmatrix}0.5&0\\0&1\end{bmatrix}", False, True),
    ("2024-1-5", None, "05/01/2024", False, True),
    ("3:30 PM", None, "15:30", False, True),
    (r"\frac{1+\sqrt{5}}{2}", None, "1.618033988749895", False, True),
    ("2^{10}", None, "1024", False, True),
    (r"-\frac{3\pi}{4}", None, "-2.356194490192345", False, True),
    (r"(3/4)\sqrt{3}", None, r"\frac{3\sqrt{3}}{4}", False, True),
    (r"(-\infty,1/2]", None, r"(-\infty,0.5]", False, True),
    (r"\sqrt[3]{27}", None, "3", False, False),  # the root mark is read as the radicand
    ("1-2*3", None, "-5", False, True),
    ("5", None, "五", False, False),
    ("Tuesday", None, "tues", False, True),
    # Equal at every point, so equal.
    ("x + y", None, "y + x", False, True),
]


def test_equality_cases(spark):
    rows = spark.createDataFrame(CASES, "ref string, num double, pred string, sets boolean, expected boolean")
    df = normalize(rows.repartition(4), {"ref": "ref_norm", "pred": "pred_norm"})
    df = add_verdict(df, "ref", "ref_norm", "num", "pred", "pred_norm", sqltext.col("sets"))
    found = df.select("ref", "pred", "expected", "correct", "match_tier").collect()
    assert len(found) == len(CASES)
    assert [r for r in found if r.correct != r.expected] == []
    assert {r.match_tier for r in found if r.ref == "x + y"} == {"expression"}


NORMAL = [
    (r"251,7\\ \noindent", "251,7"),
    ("1/2", r"\frac{1}{2}"),
    ("(3/4)\\sqrt{3}", "(\\frac{3}{4})\\sqrt{3}"),
    ("sinx", r"\sin^{1}x"),
    (r"\sin^2x", r"\sin^{2}x"),
    (r"x\pmy", "x-y,x+y"),
    (r"a\mpb", "a-b,a+b"),
    (r"1\pm\sqrt{19}", r"1-\sqrt{19},1+\sqrt{19}"),
    ("5 km", "5"),
    ("10 hours", "10"),
    ("x=5", "5"),
    (r"\frac12", r"\frac{1}{2}"),
    (r"\frac1{72}", r"\frac{1}{72}"),
    ("12.000", "12"),
    ("seven", "7"),
    ("zero", "zero"),
    ("007", "7"),
    (r"20^\circ", "20"),
    ("{2,1}", "1,2"),
    ("1<2<3", "1,2,3"),
    (r"\textbf{ab}c", "abc"),
    ("((3))", "3"),
    ("(1)(2)", "(1)(2)"),
    ("3:2", r"\frac{3}{2}"),
    (r"5\text{ cm}", "5"),
    ("2j", "2i"),
    ("a=b=c", "c"),
    ("", ""),
]


def test_normal_forms(spark):
    rows = spark.createDataFrame(NORMAL, "text string, expected string").repartition(2)
    found = rows.withColumn("norm", normal_math(sqltext.col("text")).column()).collect()
    assert [(r.text, r.norm, r.expected) for r in found if r.norm != r.expected] == []


def test_parentheses(spark):
    rows = [(r"\{1,2\}", "1,2"), ("((a)(b))", "(a)(b)"), ("(a)(b)", "(a)(b)"), ("[({x})]", "x"), ("(", "(")]
    df = spark.createDataFrame(rows, "text string, expected string")
    found = df.withColumn("out", unwrap_all(sqltext.col("text")).column()).collect()
    assert [(r.text, r.out) for r in found if r.out != r.expected] == []


RESPONSES = [
    (r"Therefore, $1+1=\boxed{2}$.", "2"),
    ("The answer is 1/2", "1/2"),
    ("Both divide 11.\n\nTherefore, $6$ is our answer. Please note that.", "6"),
    ("We add.\n#### 7", "7"),
    ("Adding 1,000 and more we get 55", "55"),
    ("foo $x+1$ bar 3", "x+1"),
    ("the statement is true", "True"),
    ("# Answer\n\n 42", "42"),
    ("6! = 720. Therefore, 720 / 2 = 360.", "360"),
    (r"a \boxed{x\}y} b", r"x\}y"),
    ("no number here", ""),
    ("", ""),
]


def test_extraction(spark):
    df = spark.createDataFrame(RESPONSES, "resp string, expected string")
    found = df.withColumn("raw", raw_answer(sqltext.col("resp")).column()).collect()
    assert [(r.resp, r.raw) for r in found if r.raw != r.expected] == []


def test_boxes(spark):
    texts = [r"\boxed{1} and \boxed{a{b}c} d", r"\fbox{3}", r"\boxed{open", r"\boxed 5$ x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select(
        boxed_strict(sqltext.col("t")).column().alias("s"), boxed_lenient(sqltext.col("t")).column().alias("l")
    ).collect()
    assert [(r.s, r.l) for r in found] == [("a{b}c", "a{b}c"), (None, r"\fbox{3}"), (None, "open"), (None, "5")]


OLYMPIAD = [
    (r"$\frac{1}{2}$", r"So \boxed{0.5}", None, True),
    (r"\boxed{3},\boxed{4}", r"\boxed{4,3}", None, True),
    (r"$1 \pm \sqrt{2}$", r"\boxed{1+\sqrt{2},1-\sqrt{2}}", None, True),
    (r"$[0, 1)\cup(2,3]$", r"\boxed{[0,1)\cup(2,3]}", None, True),
    ("3.14", r"\boxed{3.15}", 0.01, True),
    ("3.14", r"\boxed{3.16}", 0.01, False),
    ("50", r"\boxed{0.5}", None, True),
    (r"\boxed{1},\boxed{1}", r"\boxed{1,2}", None, False),
]


@pytest.mark.parametrize("dedup", [True, False])
def test_olympiad_and_truncation(spark, dedup):
    rows = [("olympiadbench/x", "q", r, a, t, "stop", e) for r, a, t, e in OLYMPIAD]
    rows += [
        ("math", "q", None, r"\boxed{1}", None, "stop", None),
        ("math", "q", "2", "The answer is 2", None, "stop", True),
        ("math", "q", "2", "The answer is 2", None, "length", False),
    ]
    df = spark.createDataFrame(
        rows, "dataset string, query string, ref_ans string, resp string, abs_tol double, finish_reason string, expected boolean"
    )
    graded = grading.grade(df, dedup=dedup)
    assert [r for r in graded.collect() if r.correct != r.expected] == []


def test_hot_pairs_and_partitions_do_not_matter(spark):
    rows = [("q", "5" if i < 290 else None, f"The answer is {5 if i % 3 else i}.", i) for i in range(300)]
    df = spark.createDataFrame(rows, "query string, ref_ans string, resp string, i int")
    plain = {r.i: r.correct for r in grading.grade(df, mode="math").collect()}
    hot = {r.i: r.correct for r in grading.grade(df.repartition(7), mode="math", dedup=True, hot_rows=5).collect()}
    assert plain == hot and len(hot) == 300
    assert sum(plain[i] for i in range(290)) == sum(1 for i in range(290) if i % 3 or i == 5)


def test_python_evaluator_errors_are_wrong(spark):
    df = spark.createDataFrame([("q", "1", "The answer is 1"), ("q", "a", "The answer is 2")], "query string, ref_ans string, resp string")
    graded = grading.grade(df, evaluator=grading.python_evaluator(lambda r, a: int(r) == int(a)))
    assert sorted(r.correct for r in graded.select("correct").collect()) == [False, True]
    assert graded.filter(F.col("match_tier") != "custom").count() == 0


def test_guards_let_through_all_that_their_stages_change():
    found = lambda pattern, text: re.search(pattern, text) is not None
    assert all(found(forms.REPLACEABLE, old) for old in (*fixed.REMOVED, *(old for old, _ in fixed.REPLACED)))
    assert all(found(forms.STYLED, c + " x") for c in fixed.STYLE_COMMANDS)
    assert all(found(forms.STYLED, f"\\{edge}{{{env}}}") for env in fixed.ENVIRONMENTS for edge in ("begin", "end"))
    assert all(found(forms.UNIT_END, unit[-1]) for unit in (*fixed.UNITS, "a.m.", "km\r", "km\n", "km\u2028"))
    for pattern, none in ((extract.LETTER, "([{}])0+-\\ \n."), (forms.LETTER_OR_POINT, "([{}])0+-\\ \n"), (forms.REPLACEABLE, "([{}])0+- ")):
        assert not found(pattern, none) and all(found(pattern, ch) for ch in "azμİ\x85")


def test_closed_forms_cast_only_numbers(spark):
    """Each failed cast is an exception in the JVM; a strict cast shows one."""
    text = values.closed_form_value(sqltext.col("t")).text.replace("TRY_CAST", "CAST")
    rows = spark.createDataFrame([(r"\sqrt{4}+\sqrt[3]{8}*2^{2}",), (r"2\pi+\pi^2",), (r"\frac{\sqrt{9}}{3}",)], "t string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    try:
        got = [r[0] for r in rows.select(F.expr(text)).collect()]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert got[0] == pytest.approx(10) and got[1] == pytest.approx(2 * math.pi + math.pi**2) and got[2] == 1


def test_words_and_units_behind_their_guards(spark):
    rows = [("5 km\u2028", "5"), ("12 hours", "12"), ("7 am", "7"), ("ciradrc", "circ"), ("x3ciradrc", r"x{3*\frac{\pi}{180}}"), (r"\binom{3}{2} no", "False"), ("İyes", "True")]
    df = spark.createDataFrame(rows[:3] + rows[5:], "t string, want string")
    done = grading.normalize_answers(df, "t", "norm").collect()
    assert [r["norm"] for r in done] == [r["want"] for r in done]
    raw = spark.createDataFrame(rows[3:5], "t string, want string").select(forms.degrees(sqltext.col("t")).column().alias("n"), "want")
    assert all(r["n"] == r["want"] for r in raw.collect())

"""Written expressions, identities, unions of intervals and layers of parentheses, against plain code."""

from __future__ import annotations

import math
import random
import time

import pytest

from rftspark.functions import sqltext
from rftspark.functions.equality import close, interval_equal, intervals_of
from rftspark.functions.expressions import expression, same_expression
from rftspark.functions.normalize import unwrap_all

VALUES = [
    (r"\frac{\frac{1}{2}}{3}", 1 / 6), ("2(3+4)", 14), ("3!", 6), (r"\log^{1}_28", 3), (r"\log^{1}_{2}8", 3), (r"\log^{1}{8}", math.log(8)),
    (r"\sin^{1}{\frac{\pi}{6}}", 0.5), (r"\sin^{1}\frac{\pi}{6}", 0.5), (r"\sin^{2}(\frac{\pi}{4})", 0.5), (r"\sin^{-1}{1}", math.pi / 2),
    (r"\cos^{1}2\pi", 1), (r"\arc\tan^{1}{1}", math.pi / 4), ("e^2", math.e**2), (r"\ln^{1}e", 1), (r"\exp^{1}(2)", math.exp(2)),
    (r"1\frac{1}{2}", 1.5), (r"-1\frac{1}{2}", -1.5), (r"2^3\frac{1}{2}", 4), (r"\binom{5}{2}", 10), (r"\binom{5}{0}", 1), ("0!", 1),
    (r"\sqrt[3]{27}", 3), (r"\sqrt{2+\sqrt{4}}", 2), (r"3\sqrt{2}", 3 * 2**0.5), ("2^{3^{2}}", 512), ("-2^2", -4), ("2^10", 1024),
    (r"2^\frac{1}{2}", 2**0.5), ("(1+2)(3-1)", 6), ("2*-3", -6), ("+-3", -3), ("5!/(3!2!)", 10), (r"1/2\pi", 1 / (2 * math.pi)),
    (r"\lfloor-2.5\rfloor", -3), (r"\lceil2.1\rceil", 3), ("8/2/2", 2), ("1-2-3", -4), ("1/0", math.nan), (r"\sqrt{-1}", math.nan),
    ("(0.5)!", math.nan), ("2+", None), ("(2", None), ("2)", None), ("()", None), (r"\frac{1}", None), ("", None), ("2**3", None),
    ("[1)", None), ("^2", None), ("3+2i", None), ("blue", None), (r"\unknown{2}", None), ("1.2.3", None), (r"\sin", None),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(VALUES)], "i int, c string")
    rows = df.select("i", expression(sqltext.col("c")).column().alias("e")).collect()
    return {r["i"]: r["e"] for r in rows}


@pytest.mark.parametrize("i", range(len(VALUES)), ids=[c or "empty" for c, _ in VALUES])
def test_value(found, i):
    want, got = VALUES[i][1], found[i]
    if want is None:
        assert got is None
    else:
        assert len(got["at"]) == 1 and (math.isnan(want) and math.isnan(got["at"][0]) or math.isclose(got["at"][0], want, rel_tol=1e-12))


def test_random_expressions_equal_python(spark):
    rnd = random.Random(8)

    def made(depth: int) -> tuple[str, str]:
        if depth == 0 or rnd.random() < 0.2:
            n = str(rnd.randint(1, 9))
            return n, n
        (a, x), (b, y) = made(depth - 1), made(depth - 1)
        return rnd.choice([
            (f"({a}+{b})", f"({x}+{y})"), (f"({a}-{b})", f"({x}-{y})"), (f"{{{a}}}*{{{b}}}", f"({x})*({y})"), (f"({a})({b})", f"(({x})*({y}))"),
            (f"\\frac{{{a}}}{{{b}}}", f"(({x})/({y}))"), (f"-{a}", f"-{x}"), (f"\\sqrt{{({a})^2}}", f"abs({x})"),
        ])

    rows = []
    while len(rows) < 200:
        text, code = made(rnd.randint(1, 6))
        if text.startswith("--") or "+-" in text:
            continue
        try:
            rows.append((text, float(eval(code))))  # noqa: S307
        except ZeroDivisionError:
            rows.append((text, None))
    df = spark.createDataFrame(rows, "c string, want double").select("*", expression(sqltext.col("c")).column().alias("e"))
    for r in df.collect():
        v = r["e"]["at"][0]
        assert math.isnan(v) if r["want"] is None else math.isnan(v) or math.isclose(v, r["want"], rel_tol=1e-9, abs_tol=1e-9), r


IDENTITIES = [
    ("x+y", "y+x", True), ("(x+1)^2", "x^2+2x+1", True), ("(x+1)^2", "x^2+x+1", False), ("x<3", "3>x", True), ("x<3", "x>3", False),
    ("x<3", r"x\leq3", False), (r"x\geq3", r"3\leqx", True), ("x^2-1", "(x-1)(x+1)", True), ("2x=y", "y=2x", True), ("x=2", "x", None),
    (r"\sin^{2}x+\cos^{2}x", "1", True), (r"\sqrt{x^2}", "x", False), (r"\pix", r"x\pi", True), ("x", "100x", False), ("ab", "ba", True),
    ("listen", "silent", None), (r"\frac{x^2-4}{x-2}", "x+2", True), (r"\alpha+1", r"1+\alpha", True), ("x<-1", "x>3", False),
]


def test_identities(spark):
    def near(x, y):
        return close(x, y, 1e-9, 1e-8)

    a, b = (expression(sqltext.col(c)) for c in "ab")
    df = spark.createDataFrame(IDENTITIES, "a string, b string, want boolean")
    rows = df.select("*", same_expression(a, b, near, near).column().alias("same")).collect()
    assert [r for r in rows if bool(r["same"]) != bool(r["want"])] == []


def test_long_sum_is_linear(spark):
    df = spark.createDataFrame([("+".join(["(1+2)"] * n) + "!",) for n in (10, 20_000)], "c string")
    start = time.time()
    values = [r["e"]["at"][0] for r in df.select(expression(sqltext.col("c")).column().alias("e")).collect()]
    assert values == [3 * 9 + 6, 3 * 19_999 + 6] and time.time() - start < 60


UNIONS = [
    (r"[0,1]\cup[1,2]", "[0,2]", True), (r"[0,1)\cup(1,2]", "[0,2]", False), (r"[0,1)\cup[1,2]", "[0,2]", True),
    (r"(0,9)\cup(1,2)", "(0,9)", True), (r"(0,3)\cup(2,5]", "(0,5]", True), (r"(0,3)\cup(2,5]", "(0,5)", False),
    (r"(0,1)\cup\{1\}\cup(1,2)", "(0,2)", True), (r"(0,2)\cup\{2\}", "(0,2]", True), (r"[0,5]\cap[3,9]", "[3,5]", True),
    (r"[0,5)\cap(3,9]", "(3,5)", True), (r"[0,2]\cap[2,4]", r"\{2\}", True), (r"[0,1]\cap[2,3]\cup[5,6]", "[5,6]", True),
    (r"(-\infty,3]\cup[2,\infty)", r"(-\infty,\infty)", True), (r"(-\infty,1)\cup(2,\infty)", r"(2,\infty)\cup(-\infty,1)", True),
    (r"[0,\frac{1}{2}]\cup[0.5,2]", "[0,2]", True), ("[a,b]", "[a,b]", True), (r"[a,b]\cup[c,d]", r"[c,d]\cup[a,b]", True), ("[a,b]", "[a,c]", False),
]


def test_unions(spark):
    df = spark.createDataFrame(UNIONS, "a string, b string, want boolean")
    parts = df.select("*", *[intervals_of(sqltext.col(c)).column().alias(f"parts_{c}") for c in "ab"])
    same = interval_equal(sqltext.col("parts_a"), sqltext.col("parts_b"))
    rows = parts.select("a", "b", "want", same.column().alias("same")).collect()
    assert [r for r in rows if bool(r["same"]) != r["want"]] == []


PAIRS = {r"\(": r"\)", r"\[": r"\]", r"\{": r"\}", "(": ")", "[": "]", "{": "}"}


def plain_unwrap(s: str) -> str:
    """Layer by layer: the partner of the first parenthesis, counted by its kind alone."""
    again = True
    while again:
        again = False
        for left, right in PAIRS.items():
            depth = 0
            for i in range(len(s)) if s.startswith(left) else ():
                depth += s.startswith(left, i) - s.startswith(right, i)
                if depth == 0:
                    if i and i == len(s) - len(left):
                        s, again = s[len(left) : -len(left)], True
                    break
    return s


def test_unwrap(spark):
    rnd, rows = random.Random(3), []
    for k in range(4000):
        outer = [rnd.choice([p for p in PAIRS if k % 3 == 0 or len(p) == 1]) for _ in range(rnd.randint(0, 4))]
        pool = ["(", ")", "[", "]", "{", "}"] if k % 3 else ["\\(", "\\)", "\\[", "\\]", "(", ")"]
        inner = "".join(rnd.choice([*pool, "1", "x", ","]) for _ in range(rnd.randint(0, 6)))
        rows.append(("".join(outer) + inner + "".join(PAIRS[p] for p in reversed(outer)),))
    done = spark.createDataFrame(rows, "c string").select("c", unwrap_all(sqltext.col("c")).column().alias("u")).collect()
    assert [r for r in done if plain_unwrap(r["c"]) != r["u"]] == []


def test_alternating_layers_are_linear(spark):
    n = 20_000
    df = spark.createDataFrame([("([" * n + "1" + "])" * n,), ("([" * n + "1" + ")]" * n,)], "c string")
    call = df.select(unwrap_all(sqltext.col("c")).column().alias("u"))
    call.collect()
    start = time.time()
    assert [len(r["u"]) for r in call.collect()] == [1, 4 * n + 1] and time.time() - start < 10

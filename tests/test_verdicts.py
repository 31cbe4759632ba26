"""Cases that the registered queries do not see."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from rftspark.functions import sqltext
from rftspark.functions.equality import set_equal
from rftspark.functions.normalize import unwrap_all
from rftspark.operators.grading import grade
from rftspark.operators.packing import assign_packs
from rftspark.operators.prompts import choose_template
from rftspark.operators.quotas import replay
from rftspark.operators.reports import with_level
from rftspark.plans.training import Source, examples_of
from rftspark.sources import files
from rftspark.sources.requests import read_tasks


def test_a_stopped_query_stays_stopped(spark):
    hits = [True, True] + [False] * 4 + [True] * 6
    pool = spark.createDataFrame([("q", i, h) for i, h in enumerate(hits)], "query string, seq int, correct boolean")

    def rule(trials, corrects, most, enough):
        return F.when((trials >= 2) & (corrects / trials >= 0.5), "done")

    assert sorted(r["trial"] for r in replay(pool, ["query"], ["seq"], rule=rule).collect()) == [1, 2]


def test_level_lookup_never_repeats_rows(spark):
    df = spark.createDataFrame([("a ",), ("b",)], "query string")
    levels = spark.createDataFrame([(" a", 1, 2), ("a", 3, 1)], "query string, level int, seq int")
    assert sorted(tuple(r) for r in with_level(df, levels, order="seq").collect()) == [("a", 1), ("b", 0)]


def test_sets_match_both_ways(spark):
    rows = [("{0.5,9}", "The answer is $\\boxed{50,0.005}$"), ("{0.5,9}", "The answer is $\\boxed{9,0.5}$")]
    df = spark.createDataFrame([("Find the values of x.", r, t) for r, t in rows], "query string, ref_ans string, resp string")
    got = {r["resp"]: r["correct"] for r in grade(df, mode="math").collect()}
    assert [got[t] for _, t in rows] == [False, True]


def test_sets_match_one_to_one(spark):
    element = "array<struct<norm:string,value:double>>"
    ref, pred = [("1", 1.0), ("50", 50.0), ("0.5", 0.5)], [("0.5", 0.5), ("50.0", 50.0), ("x", None)]
    df = spark.createDataFrame([(ref, pred), (ref, ref[::-1])], f"a {element}, b {element}")
    got = df.select(set_equal(sqltext.col("a"), sqltext.col("b")).column().alias("same")).collect()
    assert [r["same"] for r in got] == [False, True]


def _unwrapped(text):
    """One pair at a time, followed from its opening to its end."""
    while text:
        left = text[:2] if text[0] == "\\" else text[:1]
        if left.lstrip("\\") not in ("(", "[", "{"):
            return text
        right = left.translate(str.maketrans("([{", ")]}"))
        if not text.endswith(right) or len(text) < 2 * len(left):
            return text
        inner, depth, at = text[len(left) : -len(left)], 1, 0
        while at < len(inner) and depth:
            mark = inner[at : at + len(left)]
            depth += (mark == left) - (mark == right)
            at += len(left) if mark in (left, right) else 1
        if depth != 1:
            return text
        text = inner
    return text


def test_enclosing_parentheses_like_a_plain_loop(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["(", ")", "(", ")", "[", "]", "\\(", "\\)", "a"]) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    texts += ["(" * k + m + ")" * n for k in range(4) for n in range(4) for m in ("", "x", ")(", "a)(b", "))((", "(x")]
    texts += [f"\\({t}\\)" for t in texts[:500]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(2)
    for r in df.select("t", unwrap_all(sqltext.col("t")).column().alias("u")).collect():
        assert r["u"] == _unwrapped(r["t"]), r["t"]


def test_long_answers_leave_the_job_alive(spark):
    n = 20_000
    rows = [
        ("7", "(" * n + "7" + ")" * n), (str(n), "\\frac{" + "2+" * (n - 1) + "2}{2}"), ("2", "\\frac{" + "{1}" * n + "}{3}"),
        ("3", "\\sqrt{" + "{1}" * n + "}"), ("5", "x" + "'" * n + "=5"), ("8", "([" * 50 + "8" + "])" * 50), ("1", "1" * n),
    ]
    df = spark.createDataFrame([("What is x?", r, f"The answer is $\\boxed{{{t}}}$") for r, t in rows], "query string, ref_ans string, resp string")
    got = {r["ref_ans"]: r["correct"] for r in grade(df, mode="math").collect()}
    assert got == {"7": True, str(n): True, "2": False, "3": False, "5": True, "8": True, "1": False}


def test_cache_tells_end_marks_and_encoders_apart(spark, tmp_path):
    rows = spark.createDataFrame([("1", "What?", "So it is.")], "id string, query string, response string")
    home, source = str(tmp_path), Source("mix", rows)
    one = examples_of(source, cache_home=home).collect()
    other = examples_of(source, cache_home=home, eos=" <end> <end>").collect()
    assert one != other and examples_of(source, cache_home=home).collect() == one
    with pytest.raises(ValueError, match="tokenizer_name"):
        examples_of(source, cache_home=home, make_encoder=lambda: lambda text: [1, 2])


def test_sharded_packing_needs_its_stretches(spark):
    with pytest.raises(ValueError, match="stretches"):
        assign_packs(spark.createDataFrame([("a", 1)], "id string, len int"), 10, mode="sharded")


def test_tool_prompt_of_an_unknown_model_is_an_error(spark):
    df = spark.createDataFrame([("some/model",)], "agent string")
    assert choose_template(df).first()["prompt_template"] == "alpaca"
    with pytest.raises(Exception, match="no tool template"):
        choose_template(df, "tool").collect()


def test_requests_and_responses_meet_by_the_stem_of_their_files(spark, tmp_path):
    for name in ("req_math.jsonl", "req_gsm.jsonl", "resp_math.jsonl"):
        (tmp_path / name).write_text('{"custom_id": "0"}\n')
    sides = [read_tasks(spark, f"{tmp_path}/{kind}_*", "custom_id string") for kind in ("req", "resp")]
    assert [r["task"] for r in sides[0].join(sides[1], ["task", "custom_id"]).collect()] == ["math"]


def test_run_layout_and_recursive_scan(spark, tmp_path):
    rows = [("m/a", "d", "0.5", 1, "x"), ("m/b", "d", "0.5", 2, "y")]
    df = spark.createDataFrame(rows, "model string, dataset string, temperature string, seed int, resp string")
    files.write_runs(df, f"{tmp_path}/runs")
    back = spark.read.parquet(f"{tmp_path}/runs")
    assert [r["resp"] for r in back.filter("run_model = 'm--b'").collect()] == ["y"]
    for i, folder in enumerate(("a/deep", "b")):
        files.write_jsonl(df.limit(1 + i), f"{tmp_path}/json/{folder}")
    scan = files.scan_runs(spark, [f"{tmp_path}/json"], df.schema, r"part-.*\.json", recursive=True)
    assert scan.count() == 3
    assert files.scan_runs(spark, [f"{tmp_path}/json/*"], df.schema, "part").count() == 2

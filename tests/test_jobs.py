"""Files, transcripts, adapters, plans and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rftspark import schemas
from rftspark.operators import prompts, quotas, transcripts
from rftspark.plans import curation, training
from rftspark.runtime import scratch_path
from rftspark.sources import adapters, files
from rftspark.streaming import incremental

CONTEXT = """
```python
print('Hey, Jude')
```

```output
Hey, Jude
```

Don't make it bad

```python
print('Take a sad song and make it better')
```

"""


def test_transcripts(spark):
    df = spark.createDataFrame([(CONTEXT,), (CONTEXT + "```output\nx```",), (CONTEXT + "```output\n```output\n",)], "text string")
    assert [r.state for r in transcripts.state(df).collect()] == [0, 1, 2]
    cells = transcripts.cells(df.limit(1)).select("cell").collect()
    assert [r.cell for r in cells] == ["print('Hey, Jude')", "print('Take a sad song and make it better')"]
    out = df.limit(1).select(transcripts.wrapped(F.lit("a b")).alias("w")).first().w
    assert out == "```output\na b\n```"


def test_prompt_keeps_line_ends(spark):
    df = spark.createDataFrame([("1+1?", "alpaca"), ("1+1?", "wizardmath-cot"), ("1+1?", "deepseekmath"), ("1+1?", "nope")], "query string, prompt_template string")
    rows = {r.prompt_template: r for r in prompts.render(df, prompts.template_table(spark)).collect()}
    assert rows["alpaca"].prompt.endswith("### Instruction:\n1+1?\n\n### Response:\n")
    assert rows["wizardmath-cot"].prompt.endswith("### Response: Let's think step by step.")
    assert rows["deepseekmath"].prompt.endswith("\\boxed{}.\n\nAssistant:")
    assert rows["nope"].defaulted and rows["nope"].prompt == rows["alpaca"].prompt


def test_unknown_answer_type_gives_no_text(spark):
    df = spark.createDataFrame([("q", "Numerical", False, None), ("q", "Poem", False, None)], "question string, answer_type string, is_multiple_answer boolean, unit string")
    rows = prompts.olympiad_query(df, "OE_TO_maths_en_COMP").collect()
    assert rows[0].query.endswith("\nq") and rows[1].query is None


def test_specs():
    assert adapters.parse_spec("math/train;level=[1,2];sample=0.5") == ("math/train", {"level": [1, 2]}, 0.5)
    assert adapters.parse_spec("a;ref_ans=int") == ("a", {"ref_ans": ["int"]}, None)
    with pytest.raises(NotImplementedError):
        adapters.parse_spec("a;color=1")
    with pytest.raises(ValueError):
        adapters._per_dataset([1, 2], 3, "max_n_trials")


def test_extras_survive(spark):
    path = scratch_path(spark, "x")
    spark.createDataFrame([('{"query": "q", "n_step": 3, "odd": {"a": 1}}',)], "v string").write.text(path)
    row = files.read_jsonl(spark, path, schemas.QUERY).first()
    assert (row.query, row.n_step, row.extras) == ("q", 3, {"odd": '{"a":1}'})


def test_curate_reads_only_matching_files(spark):
    root = scratch_path(spark, "runs")
    rows = [("d", f"q{i % 3}", "r", i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "dataset string, query string, resp string, correct boolean")
    files.write_jsonl(df.coalesce(1), f"{root}/a")
    files.write_jsonl(df.coalesce(1), f"{root}/b")
    done = curation.curate(spark, [f"{root}/a", f"{root}/b"], "part", 4)
    assert {r[0]: r[1] for r in done.chosen.groupBy("query").count().collect()} == {"q0": 4, "q1": 4, "q2": 4}
    assert done.per_dataset.first().n == 60 and done.per_file.count() == 2
    assert curation.curate(spark, [f"{root}/a"], "nothing", 4).chosen.count() == 0


def test_grading_never_overwrites(spark):
    with pytest.raises(ValueError):
        curation.grade_path(spark, "/x/y", "/x/y/")


def test_training_cache_depends_on_template_and_length(spark):
    home = scratch_path(spark, "cache")
    rows = spark.createDataFrame([("1", "a b", "c")], "id string, query string, response string")
    source = training.Source("s", rows)
    sizes = [
        training.examples_of(source, prompt_template=t, max_len=n, cache_home=home).select(F.size("input_ids")).first()[0]
        for t, n in (("alpaca", None), ("qa", None), ("alpaca", 5), ("alpaca", None))
    ]
    assert sizes[0] == sizes[3] and len({sizes[0], sizes[1], sizes[2]}) == 3


def test_packing_several_sources_keeps_all(spark):
    rows = spark.createDataFrame([(str(i), f"q {i}", "a " * i) for i in range(20)], "id string, query string, response string")
    packed = training.build([training.Source("x", rows), training.Source("y", rows)], pack_len=200)
    segments = packed.agg(F.sum(F.array_max("attention_mask"))).first()[0]
    assert segments == 40
    assert packed.filter(F.size("input_ids") != 200).count() == 0


def _arrivals(spark, path, rows):
    spark.createDataFrame(rows, "q int, seq int, correct boolean").coalesce(1).write.mode("append").json(path)


def test_stream_stops_and_restarts(spark):
    path, out, mark = (scratch_path(spark, n) for n in ("in", "out", "mark"))
    schema = schemas.T.StructType.fromDDL("q int, seq int, correct boolean")

    def run():
        arriving = incremental.read_stream(spark, path, schema, maxFilesPerTrigger=1)
        kept = incremental.stop_stream(arriving, ["q"], ["seq"], 12, 2)
        incremental.append_sink(kept, out, mark).awaitTermination()
        return spark.read.parquet(out)

    batch = [(q, s, q == 1) for q in (1, 2) for s in range(5)]
    _arrivals(spark, path, batch)
    assert run().count() == 10
    # A restart reads only what is new: query 1 has its corrects, query 2 goes on.
    _arrivals(spark, path, [(q, s + 5, q == 1) for q, s, _ in batch])
    assert {r.q: r.n for r in run().groupBy("q").agg(F.count("*").alias("n")).collect()} == {1: 5, 2: 10}
    _arrivals(spark, path, [(q, s + 10, False) for q, s, _ in batch])
    assert {r.q: r.n for r in run().groupBy("q").agg(F.count("*").alias("n")).collect()} == {1: 5, 2: 12}


def test_stream_equals_batch_replay(spark):
    rows = [(q, s, (q * s) % 3 == 0) for q in range(1, 6) for s in range(40)]
    path, out, mark = (scratch_path(spark, n) for n in ("in", "out", "mark"))
    for i in range(4):
        _arrivals(spark, path, [r for r in rows if r[1] // 10 == i])
    schema = schemas.T.StructType.fromDDL("q int, seq int, correct boolean")
    arriving = incremental.read_stream(spark, path, schema, maxFilesPerTrigger=1)
    incremental.append_sink(incremental.stop_stream(arriving, ["q"], ["seq"], 35, 6), out, mark).awaitTermination()
    got = {(r.q, r.seq) for r in spark.read.parquet(out).collect()}
    batch = quotas.replay(spark.createDataFrame(rows, "q int, seq int, correct boolean"), ["q"], ["seq"], 35, 6, 10)
    assert got == {(r.q, r.seq) for r in batch.collect()}


def test_folders_arrive_in_the_order_given(spark):
    root = scratch_path(spark, "order")
    for name in "ab":
        rows = [("d", "q", f"{name}{i}", True) for i in range(3)]
        files.write_jsonl(spark.createDataFrame(rows, "dataset string, query string, resp string, correct boolean").coalesce(1), f"{root}/{name}")
    for dirs, want in ((["a", "b"], ["a0", "a1", "a2", "b0"]), (["b", "a"], ["a0", "b0", "b1", "b2"])):
        done = curation.curate(spark, [f"{root}/{d}" for d in dirs], "part", 4)
        assert sorted(r.resp for r in done.chosen.collect()) == want

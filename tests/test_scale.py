"""Work per task, micro-batches and moved columns stay bounded as tables grow."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from rftspark import schemas
from rftspark.operators.ranking import keep_latest
from rftspark.plans.curation import grade_path
from rftspark.runtime import scratch_path, spread
from rftspark.sources import files
from workload import grading, prompting, training


@pytest.fixture()
def tables(spark, tmp_path):
    line = spark.range(400, numPartitions=4).selectExpr(
        "id as l_orderkey", "cast(id % 7 as int) as l_linenumber", "id % 9 as l_suppkey", "id % 20 as l_partkey",
        "cast(id % 50 + 1 as double) as l_quantity", "'N' as l_returnflag", "date'2020-01-01' as l_shipdate",
    )
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(20).selectExpr("id as p_partkey", "cast(id + 1 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    events = spark.range(3000).selectExpr("id as event_id", "id % 40 as user_id", "'view' as event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_spread_adds_tasks_with_rows(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    cores = spark.sparkContext.defaultParallelism
    few, many = (spread(spark.read.parquet(f"{tmp_path}/t"), rows=n) for n in (1000, 10))
    assert (few.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (cores, 100)
    assert many.distinct().count() == 1000


def test_run_directories_have_a_file_per_task(spark, tables):
    dirs = prompting._run_files(spark, tables)
    assert all(len(glob.glob(f"{d}/part-*")) > 1 for d in dirs)
    assert sorted(r["n"] for r in prompting.rows_per_file(spark, tables).collect()) == [133, 133, 134]


def test_latest_row_moves_only_columns_in_use(spark, capsys):
    rows = spark.range(10).selectExpr("id % 3 as k", "id as at", "repeat('x', 1000) as wide")
    last = keep_latest(rows, ["k"], ["at"])
    assert sorted(map(tuple, last.select("k", "at", F.length("wide")).collect())) == [(0, 9, 1000), (1, 7, 1000), (2, 8, 1000)]
    last.select("k", "at").explain()
    assert "wide" not in capsys.readouterr().out


def test_latest_row_of_null_keys_and_orders(spark):
    rows = spark.createDataFrame([(None, 1, "a"), (None, None, "b"), (1, None, "c")], "k int, at int, v string")
    assert sorted(r["v"] for r in keep_latest(rows, ["k"], ["at"]).collect()) == ["a", "c"]


def test_micro_batches_do_not_grow_with_partitions(spark, tables, monkeypatch):
    made = {}
    monkeypatch.setattr(training, "scratch_path", lambda s, n: made.setdefault(n, scratch_path(s, n)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        out, schema = training._arriving(spark, tables, training._stopped)
        assert len(glob.glob(f"{made['stream']}/_spark_metadata/[0-9]*")) == 4
        made.pop("offsets")
        monkeypatch.setattr(training, "_arriving", lambda *_: (out, schema))
        training.stream_progress(spark, tables)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 1 <= len(glob.glob(f"{made['progress']}/round=*")) <= 4


def test_compressed_copy_is_read_in_pieces(spark, tmp_path):
    rows = spark.range(50).selectExpr(
        "cast(id as string) as id", "'math/train' as dataset", "'q' as query", "'7' as ref_ans",
        "concat('The answer is ', 7 + id % 2, '.') as resp", "'stop' as finish_reason",
    )
    raw, out = f"{tmp_path}/raw", f"{tmp_path}/out"
    files.write_jsonl(rows.coalesce(1), raw, compression="lz4", max_rows=20)
    assert len(glob.glob(f"{raw}/part-*.json.lz4")) == 3
    assert files.read_jsonl(spark, raw, schemas.RESPONSE).count() == 50
    grade_path(spark, raw, out, compression="lz4", mode="math")
    assert glob.glob(f"{out}/*.lz4")
    graded = spark.read.schema("id string, correct boolean").json(out)
    assert {r["id"] for r in graded.filter("correct").collect()} == {str(i) for i in range(0, 50, 2)}


def test_arriving_responses_are_compressed(spark, tables, monkeypatch):
    made = {}
    monkeypatch.setattr(training, "scratch_path", lambda s, n: made.setdefault(n, scratch_path(s, n)))
    graded = training.stream_grade(spark, tables).collect()
    parts = glob.glob(f"{made['responses']}/part-*")
    assert parts and all(p.endswith(".json.gz") for p in parts)
    pool = training.view(spark, tables, "resp")
    assert sorted(spark.read.schema(pool.schema).json(made["responses"]).collect()) == sorted(pool.collect())
    assert {r["resp_id"]: (r["ans"], r["correct"]) for r in graded} == {r["resp_id"]: (r["given"], r["hit"]) for r in pool.collect()}


@pytest.mark.parametrize("name", ["correct_by_form", "undecided_share", "grade_olympiad"])
def test_forms_are_graded_once_per_pair(spark, tables, monkeypatch, name):
    seen, grade = [], grading.grading.grade
    monkeypatch.setattr(grading.grading, "grade", lambda *a, **k: seen.append(k.get("dedup")) or grade(*a, **k))
    getattr(grading, name)(spark, tables)
    assert seen == [True]

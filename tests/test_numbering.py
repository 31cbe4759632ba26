"""Numbers of a whole table, splits, packing states over several levels, and a cache that follows its rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from rftspark.operators import packing, ranking
from rftspark.plans import training
from rftspark.runtime import scratch_path
from rftspark.sources import files


def test_numbering_of_a_table_needs_one_exchange_of_rows(spark):
    rows = [(random.Random(i).randrange(50), i, f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, c string").repartition(5)
    numbered = ranking.split_rank(df, [], ["a", "b"], "rk", partitions=7)
    got = [(r["a"], r["b"], r["c"]) for r in sorted(numbered.collect(), key=lambda r: r["rk"])]
    assert got == sorted(rows)
    assert sorted(r["rk"] for r in numbered.collect()) == list(range(1, 3001))
    # What is read back meets the offsets without a shuffle of its own.
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_numbering_of_empty_null_and_one_row_tables(spark):
    assert ranking.dense_index(spark.createDataFrame([], "a int"), ["a"], "i").count() == 0
    df = spark.createDataFrame([(None,), (3,), (1,)], "a int")
    assert {(r["a"], r["i"]) for r in ranking.dense_index(df, ["a"], "i").collect()} == {(None, 0), (1, 1), (3, 2)}


def test_every_split_is_one_file(spark):
    path = scratch_path(spark, "splits")
    files.write_splits(spark.range(1050).repartition(6), path, ["id"], 100)
    back = spark.read.json(path).withColumn("f", F.input_file_name())
    per = back.groupBy("split_start", "split_end").agg(F.countDistinct("f").alias("f"), F.count("*").alias("n"), F.min("id").alias("lo"))
    got = sorted((r["split_start"], r["split_end"], r["f"], r["n"], r["lo"]) for r in per.collect())
    assert got == [(s, min(s + 100, 1050), 1, min(100, 1050 - s), s) for s in range(0, 1050, 100)]


def test_tasks_that_write_splits_follow_their_number(spark, monkeypatch):
    monkeypatch.setattr(files, "SPLITS_PER_TASK", 10, raising=False)
    path = scratch_path(spark, "splits")
    files.write_splits(spark.range(1050).repartition(6), path, ["id"], 5)
    task = F.regexp_extract(F.input_file_name(), r"/part-(\d+)-", 1)
    back = spark.read.json(path).withColumn("task", task)
    per = back.groupBy("task").agg(F.countDistinct("split_start").alias("n")).collect()
    # 210 splits of a few rows each: by their bytes they would all be one task's.
    assert sum(r["n"] for r in per) == 210 and len(per) > 16


def test_splits_are_counted_where_they_are_numbered(spark):
    cut = files.split_ranges(spark.range(1050).repartition(6), ["id"], 100)
    assert "Range" not in cut._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["split_start"], r["split_end"]) for r in cut.collect()} == {(s, min(s + 100, 1050)) for s in range(0, 1050, 100)}
    assert files.split_ranges(spark.range(0), ["id"], 100).count() == 0


def test_states_composed_over_several_levels_equal_one_pass(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCHES_PER_BLOCK", 2)
    random.seed(5)
    lens = [random.randint(1, 60) for _ in range(700)]
    df = spark.createDataFrame([(f"{i:04d}", n) for i, n in enumerate(lens)], "id string, len int")
    want, pack, load = {}, -1, 64
    for i, n in enumerate(lens):
        if load + n > 64:
            pack, load = pack + 1, 0
        want[f"{i:04d}"] = (pack, load)
        load += n
    for stretches in (1, 2, 7, 9):
        got = packing.assign_packs(df, 64, seed=None, stretches=stretches)
        assert {r["id"]: (r["pack_id"], r["offset"]) for r in got.collect()} == want


def _source(spark, rows):
    return training.Source("s", spark.createDataFrame(rows, "id string, query string, response string"))


def _values(df):
    return sorted((r["id"], tuple(r["input_ids"] or ()), tuple(r["labels"] or ())) for r in df.collect())


def test_cache_follows_changed_added_removed_and_repeated_rows(spark):
    home = scratch_path(spark, "cache")
    rows = [(str(i), f"q {i}", "a b") for i in range(40)]
    tables = [
        rows, rows, [("0", "q 0", "changed"), *rows[1:]], [*rows, ("new", "q", "x")], rows[5:], [*rows, rows[3], rows[3]],
        [("0", None, "a b"), *rows[1:]], rows[:1], [],
    ]
    for now in tables:
        assert _values(training.examples_of(_source(spark, now), cache_home=home)) == _values(training.examples_of(_source(spark, now)))


def test_only_changed_pieces_are_built(spark):
    home = scratch_path(spark, "pieces")
    built = []

    def build(some):
        built.append(sorted(r["k"] for r in some.collect()))
        return some.withColumn("v", F.upper("t"))

    def kept(rows):
        built.clear()
        df = files.kept_pieces(spark.createDataFrame(rows, "k string, t string"), build, home, "k", "name", pieces=16)
        return sorted(map(tuple, df.collect())), list(built)

    rows = [(f"k{i}", "a") for i in range(64)]
    got, done = kept(rows)
    assert got == sorted((k, t, "A") for k, t in rows) and done == [sorted(k for k, _ in rows)]
    changed = [("k0", "b"), *rows[1:]]
    got, done = kept(changed)
    assert got == sorted((k, t, t.upper()) for k, t in changed) and "k0" in done[0] and len(done[0]) < 64
    # Rows as they were before: what was kept then is read again.
    assert kept(rows)[0] == sorted((k, t, "A") for k, t in rows)


def test_a_batch_that_was_cut_short_is_built_again(spark):
    home = scratch_path(spark, "torn")
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, t string")

    def fails(some):
        return some.withColumn("v", F.raise_error(F.lit("lost")).cast("string"))

    try:
        files.kept_pieces(rows, fails, home, "k", "name")
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    good = files.kept_pieces(rows, lambda some: some.withColumn("v", F.upper("t")), home, "k", "name")
    assert sorted(r["v"] for r in good.collect()) == ["X", "Y"]

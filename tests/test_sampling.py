"""Quotas, ranks, samples and packing against plain Python."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rftspark.operators import packing, quotas, ranking


def pool(spark, n=2000, hot=0.4):
    """Trials with one query that holds a large part of them."""
    rows = []
    for i in range(n):
        q = 0 if i % 10 < hot * 10 else i % 7 + 1
        rows.append((q, (i * 7919) % n, (i * 31) % 5 == 0))
    return spark.createDataFrame(rows, "query_id long, event_id long, correct boolean")


def replayed(rows, most, enough, rounds):
    """The sampling loop itself: batches of rounds, corrects counted after each batch."""
    kept = set()
    groups = {}
    for q, e, c in rows:
        groups.setdefault(q, []).append((e, c))
    for q, trials in groups.items():
        trials.sort()
        done = corrects = pending = 0
        for i, (e, c) in enumerate(trials):
            if i % rounds == 0:
                corrects += pending
                pending = 0
            if (0 < most <= done) or (0 < enough < corrects):
                break
            kept.add((q, e))
            done += 1
            pending += c
    return kept


@pytest.mark.parametrize("most,enough,rounds", [(40, 3, 1), (40, 3, 4), (0, 5, 3), (25, 0, 2), (0, 0, 1)])
def test_replay_equals_the_loop(spark, most, enough, rounds):
    df = pool(spark)
    want = replayed([tuple(r) for r in df.collect()], most, enough, rounds)
    for parts in (None, 5):
        kept = quotas.replay(df, ["query_id"], ["event_id"], most, enough, rounds, partitions=parts)
        got = kept.select("query_id", "event_id").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_replay_continues_from_counters(spark):
    df = pool(spark).withColumns({"t0": F.lit(10), "c0": F.lit(2)})
    kept = quotas.replay(df, ["query_id"], ["event_id"], 30, 3, n_trials="t0", n_corrects="c0")
    assert kept.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 20


def test_limits_that_do_not_apply(spark):
    rows = [(5, 2, 5, 0, "max_n_trials"), (4, 2, 5, 2, None), (4, 3, 5, 2, "max_n_corrects"), (99, 99, 0, 0, None), (99, 99, -1, None, None)]
    df = spark.createDataFrame(rows, "t int, c int, most int, enough int, want string")
    got = df.select("want", quotas.stop_reason(F.col("t"), F.col("c"), F.col("most"), F.col("enough")).alias("got"))
    assert [r for r in got.collect() if r.got != r.want] == []


def test_split_rank_spreads_a_hot_group(spark):
    df = pool(spark)
    ranked = ranking.split_rank(df, ["query_id"], ["event_id"], "rk", {"hits": F.col("correct").cast("int")}, partitions=6)
    rows = ranked.orderBy("query_id", "event_id").collect()
    last, rank, hits = None, 0, 0
    for r in rows:
        rank, hits = (1, int(r.correct)) if r.query_id != last else (rank + 1, hits + int(r.correct))
        last = r.query_id
        assert (r.rk, r.hits) == (rank, hits)
    assert len(rows) == df.count()


def test_quota_above_the_group_limit(spark):
    df = pool(spark, 3000, 0.6)
    got = ranking.first_k(df, ["query_id"], ["event_id"], 1500)
    counts = {r[0]: r[1] for r in df.groupBy("query_id").count().collect()}
    want = {q: min(n, 1500) for q, n in counts.items()}
    assert {r[0]: r[1] for r in got.groupBy("query_id").count().collect()} == want


def test_targets_grow_with_difficulty(spark):
    rates = quotas.difficulty(pool(spark), ["query_id"])
    rows = quotas.proportional_targets(rates, 12).orderBy("fail_rate").collect()
    targets = [r.target for r in rows]
    assert targets == sorted(targets) and targets[-1] == 12 and min(targets) >= 1
    solved = spark.createDataFrame([(1, True), (2, True)], "query_id int, correct boolean")
    assert {r.target for r in quotas.proportional_targets(quotas.difficulty(solved, ["query_id"]), 12).collect()} == {1}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    one = {r.k for r in ranking.sample_rows(df, "k", 777).collect()}
    two = {r.k for r in ranking.sample_rows(df.repartition(13), "k", 777).collect()}
    want = sorted(range(5000), key=lambda k: hashlib.md5(f"{k}|42".encode()).hexdigest())[:777]
    assert one == two == set(want)
    assert ranking.sample_rows(df, "k", 0.25).count() == 1250
    assert ranking.sample_rows(df, "k", 9999).count() == 5000


def next_fit(lens, cap):
    packs, load = [], 0
    pack = -1
    for n in lens:
        if pack < 0 or load + n > cap:
            pack, load = pack + 1, 0
        packs.append(pack)
        load += n
    return packs


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60), st.integers(20, 40), st.integers(0, 40))
def test_load_table_is_next_fit(lens, cap, start):
    start = min(start, cap)
    end, opened = packing.load_table(np.array(lens), cap)
    load, count = start, 0
    for n in lens:
        if load + n > cap:
            load, count = 0, count + 1
        load += n
    assert (end[start], opened[start]) == (load, count)


@pytest.mark.parametrize(("stretches", "block"), [(1, 64), (3, 64), (8, 2), (8, 3)])
def test_packing_equals_one_pass(spark, monkeypatch, stretches, block):
    monkeypatch.setattr(packing, "STRETCHES_PER_BLOCK", block)
    rows = [(f"s{i}", (i * 37) % 90 + 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, len int")
    got = packing.assign_packs(df, 100, stretches=stretches).collect()
    order = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}|42".encode()).hexdigest(), r[0]))
    want = dict(zip([r[0] for r in order], next_fit([r[1] for r in order], 100)))
    assert {r.id: r.pack_id for r in got} == want and len(got) == 400


def test_sharded_packing_keeps_every_sequence(spark):
    rows = [(f"s{i}", (i * 37) % 90 + 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, len int")
    exact = packing.assign_packs(df, 100, stretches=1).select("pack_id").distinct().count()
    placed = packing.assign_packs(df, 100, mode="sharded", stretches=5)
    packs = placed.groupBy("pack_id").agg(F.sum("len").alias("l"), F.collect_list("id").alias("ids"))
    rows = packs.collect()
    assert max(r.l for r in rows) <= 100
    assert sorted(i for r in rows for i in r.ids) == sorted(f"s{i}" for i in range(400))
    assert len(rows) <= exact + 5


def test_too_long_a_sequence_is_an_error(spark):
    df = spark.createDataFrame([("a", 101)], "id string, len int")
    with pytest.raises(Exception, match="no pack can hold"):
        packing.assign_packs(df, 100, stretches=1).collect()


def test_a_null_key_has_its_quota(spark):
    rows = [(q, i, i % 2 == 0) for q in ("a", None) for i in range(6)]
    pool = spark.createDataFrame(rows, "query string, seq int, correct boolean")
    kept = quotas.proportional_quota(pool, ["query"], ["seq"], 3)
    assert kept.columns == pool.columns
    assert {r[0]: r[1] for r in kept.groupBy("query").count().collect()} == {"a": 3, None: 3}

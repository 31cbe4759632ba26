"""Neighbours where one id has many rows."""

from __future__ import annotations

import numpy as np

from rftspark.llm import neighbours


def test_neighbours_of_one_id_with_many_rows(spark):
    x = np.random.default_rng(1).normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1001, (2 * x[0]).tolist())] * 60
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    s = x @ x[0]
    want = {1001, *[j for j in np.lexsort((np.arange(300), -s)).tolist() if j != 0][:19]}
    assert len(got[0]) == len(set(got[0])) == 20
    assert len(want & set(got[0])) >= 18

"""The whole way from raw responses to a curated set, in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rftspark.operators.grading import grade
from rftspark.operators.quotas import difficulty, first_k_ranked, proportional_targets
from rftspark.runtime import pinned

from .base import query, view

KEY = ["dataset", "query"]
ARRIVAL = ["run_id", "seq", "l_suppkey"]


@query("""
with rate as (select dataset, query, 1 - avg(case when hit then 1.0 else 0.0 end) as fail_rate from {resp} r group by 1, 2),
target as (select *, cast(greatest(1, ceil(round(8 * fail_rate / nullif(max(fail_rate) over (), 0), 9))) as int) as target from rate),
ranked as (select *, row_number() over (partition by dataset, query order by run_id, seq, l_suppkey) as k from {resp} r where hit)
select r.dataset, r.query, r.resp_id, t.fail_rate, t.target, cast(r.k as int) as pick
from ranked r join target t on r.dataset = t.dataset and r.query = t.query where r.k <= t.target
""")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Extract, grade, difficulty, proportional quota, pick."""
    # Written once and read twice, for difficulty and for the pick; the text stays behind.
    graded = grade(view(spark, sf, "resp", wide="lineitem"), mode="math").select(*KEY, *ARRIVAL, "resp_id", "correct")
    graded = pinned(graded)
    targets = proportional_targets(difficulty(graded, KEY), 8).select(*KEY, "fail_rate", "target")
    picked = first_k_ranked(graded.filter("correct"), KEY, ARRIVAL, 8)
    return picked.join(targets, KEY).filter(F.col("_rank") <= F.col("target")).select(
        *KEY, "resp_id", "fail_rate", "target", F.col("_rank").cast("int").alias("pick")
    )

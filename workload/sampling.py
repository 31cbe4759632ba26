"""Registered queries: quotas, stop rules, samples, strategies and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rftspark.operators import quotas, ranking, reports
from rftspark.plans import curation
from rftspark.streaming.incremental import replay_batches, work_batches

from .base import query, table, view

BY, ORDER = ["query_id"], ["event_id"]
RANKED = "select *, row_number() over (partition by query_id order by event_id) as rk from {trials} t"
CORRECTS = "select *, row_number() over (partition by query_id order by event_id) as rk from {trials} t where correct"


def _trials(spark, sf):
    return view(spark, sf, "trials")


@query(f"select query_id, event_id from ({CORRECTS}) x where rk <= 4")
def uniform_quota(spark, sf):
    """I1, I10, C3."""
    return quotas.uniform_quota(_trials(spark, sf), BY, ORDER, 4).select("query_id", "event_id")


@query("""
select query_id, n_corrects, greatest(0, 20 - n_corrects) as shortfall
from (select query_id, cast(sum(case when correct then 1 else 0 end) as bigint) as n_corrects from {trials} t group by 1) x
""")
def quota_shortfall(spark, sf):
    """Corrects a query still misses."""
    return quotas.shortfall(_trials(spark, sf), BY, 20)


TARGETS = """
select query_id, cast(greatest(1, ceil(round(8 * fail / nullif(max(fail) over (), 0), 9))) as int) as target
from (select query_id, 1 - avg(case when correct then 1.0 else 0.0 end) as fail from {trials} t group by 1) x
"""


@query(TARGETS)
def proportional_targets(spark, sf):
    """Target numbers."""
    rates = quotas.difficulty(_trials(spark, sf), BY)
    return quotas.proportional_targets(rates, 8).select("query_id", "target")


@query(f"select c.query_id, event_id from ({CORRECTS}) c join ({TARGETS}) q on c.query_id = q.query_id and rk <= target")
def proportional_quota(spark, sf):
    """I11, D7."""
    return quotas.proportional_quota(_trials(spark, sf), BY, ORDER, 8).select("query_id", "event_id")


@query(f"select query_id, event_id from ({RANKED}) x where rk <= 52 and correct")
def vanilla_trials(spark, sf):
    """I12."""
    return quotas.vanilla(_trials(spark, sf), BY, ORDER, 52).select("query_id", "event_id")


@query(f"select query_id, event_id, rk - 1 as idx from ({RANKED}) x")
def running_index(spark, sf):
    """Built from range partitions, so no query has to fit one task."""
    ranked = ranking.split_rank(_trials(spark, sf), BY, ORDER, "rk")
    return ranked.select("query_id", "event_id", (F.col("rk") - 1).alias("idx"))


def _replay_sql(most, enough, rounds):
    return f"""
with r as ({RANKED}), b as (select *, floor((rk - 1) / {rounds}) as batch from r),
c as (select *, coalesce(sum(case when correct then 1 else 0 end) over (partition by query_id order by batch
  range between unbounded preceding and 1 preceding), 0) as seen from b)
select query_id, event_id, rk as trial, cast(seen as bigint) as corrects_before from c
where ({most} <= 0 or rk <= {most}) and ({enough} <= 0 or seen <= {enough})
"""


@query(_replay_sql(40, 3, 4))
def stop_replay(spark, sf):
    """Both limits, four rounds per batch."""
    kept = quotas.replay(_trials(spark, sf), BY, ORDER, 40, 3, rounds_per_batch=4)
    return kept.select("query_id", "event_id", "trial", "corrects_before")


@query(_replay_sql(0, 5, 8))
def stop_replay_unlimited(spark, sf):
    """I7 without a trial limit: ranks from range partitions."""
    kept = quotas.replay(_trials(spark, sf), BY, ORDER, 0, 5, rounds_per_batch=8)
    return kept.select("query_id", "event_id", "trial", "corrects_before")


@query(f"""
with r as ({RANKED}), c as (select *, coalesce(sum(case when correct then 1 else 0 end) over (partition by query_id order by rk
  rows between unbounded preceding and 1 preceding), 0) as seen from r)
select query_id, event_id from c where seen < 2 and rk <= 30
""")
def custom_stop_rule(spark, sf):
    """L1: a rule of one's own."""
    rule = lambda trials, corrects, most, enough: F.when(
        (corrects >= enough) | (trials >= most), "done"
    )
    return quotas.replay(_trials(spark, sf), BY, ORDER, 30, 2, rule=rule).select("query_id", "event_id")


STATUS = "select query_id, count(*) as n_trials, cast(sum(case when correct then 1 else 0 end) as bigint) as n_corrects from {trials} t group by 1"
REASON = "case when n_trials >= 70 then 'max_n_trials' when n_corrects > 30 then 'max_n_corrects' end"


@query(f"select query_id, {REASON} as stop_reason from ({STATUS}) s")
def stop_reasons(spark, sf):
    """I6 per query."""
    status = quotas.counters(_trials(spark, sf), BY)
    reason = quotas.stop_reason(F.col("n_trials"), F.col("n_corrects"), 70, 30)
    return status.select("query_id", reason.alias("stop_reason"))


@query(f"""
select count(*) as n_queries, count(*) filter (reason = 'max_n_corrects') as n_achieved,
  count(*) filter (reason = 'max_n_trials') as n_quit,
  count(*) filter (reason = 'max_n_corrects') / count(*) as achieve_rate,
  count(*) filter (reason = 'max_n_trials') / count(*) as quit_rate
from (select {REASON} as reason from ({STATUS}) s) x
""")
def run_progress(spark, sf):
    """H10."""
    return quotas.progress(quotas.counters(_trials(spark, sf), BY), 70, 30)


@query(f"""
select query_id, cast(floor((row_number() over (order by n_trials, query_id) - 1) / 16) as bigint) as batch_no
from ({STATUS}) s where {REASON} is null
""")
def remaining_batches(spark, sf):
    """K4: unfinished queries, fewest trials first."""
    trials = _trials(spark, sf)
    work = work_batches(trials.select("query_id").distinct(), quotas.counters(trials, BY), BY, 70, 30, 16)
    return work.select("query_id", "batch_no")


@query(f"""
with r as ({RANKED}), done as (select query_id, sum(case when correct then 1 else 0 end) as c from r where rk <= 10 group by 1)
select r.query_id, event_id, rk as trial from r join done d on r.query_id = d.query_id
where rk > 10 and rk <= 40 and c <= 2
""")
def micro_batch_replay(spark, sf):
    """K2 for one micro-batch against a status table."""
    ranked = ranking.split_rank(_trials(spark, sf), BY, ORDER, "rk")
    status = quotas.counters(ranked.filter("rk <= 10"), BY)
    return replay_batches(ranked.filter("rk > 10"), status, BY, ORDER, 40, 2).select("query_id", "event_id", "trial")


@query(f"""
with r as ({RANKED}), f as (select query_id, count(*) filter (not correct and rk <= 16) as failed from r group by 1)
select r.query_id, event_id from r join f on r.query_id = f.query_id where rk > 16 and rk <= 16 + failed
""")
def retry_budget(spark, sf):
    """I3, D6."""
    return quotas.retry_budget(_trials(spark, sf), BY, ORDER, 16).select("query_id", "event_id")


RETRY = f"""
with g as (select *, 0 as src from {{trials}} t where agent = 'view' and correct),
s as (select *, 1 as src from {{trials}} t where agent = 'click' and correct),
two as (select *, row_number() over (partition by query_id order by src, event_id) as k from (select * from g union all select * from s)),
r as ({RANKED}), f as (select query_id, count(*) filter (not correct and rk <= 16) as failed from r group by 1),
tries as (select r.*, case when rk <= 16 then 0 else 1 end as src from r join f on r.query_id = f.query_id where rk <= 16 + failed),
three as (select *, row_number() over (partition by query_id order by src, event_id) as k from tries where correct)
"""


@query(RETRY + """
select 'greedy' as step, query_id, event_id from g
union all select 'sampled', query_id, event_id from two where k <= 4
union all select 'final', query_id, event_id from two where k <= 4
union all select 'final', query_id, event_id from three where k <= 4
""")
def strategy_retry(spark, sf):
    """I4, I8."""
    t = _trials(spark, sf)
    steps = curation.greedy_sample_retry(t.filter("agent = 'view'"), t.filter("agent = 'click'"), t, BY, ORDER, first=16)
    return _steps(steps)


COVER = """
with one as (select * from {trials} t where agent = 'view' and correct and level < 4),
p as (select *, case agent when 'click' then 0 else 1 end as src from {trials} t where agent in ('click', 'error') and correct),
two as (select * from (select *, row_number() over (partition by query_id order by src, event_id) as k from p
  where query_id not in (select query_id from one)) x where k <= 2),
pool as (select * from {trials} t where query_id not in (select query_id from one union select query_id from two)),
raw as (select *, row_number() over (partition by query_id order by event_id) as rk from pool),
three as (select * from (select *, row_number() over (partition by query_id order by event_id) as k from raw where rk <= 100 and correct) x where k <= 4)
"""


@query(COVER + """
select 'first' as step, query_id, event_id from one
union all select 'patched', query_id, event_id from one union all select 'patched', query_id, event_id from two
union all select 'final', query_id, event_id from one union all select 'final', query_id, event_id from two
union all select 'final', query_id, event_id from three
""")
def strategy_cover(spark, sf):
    """I5, D5."""
    return _steps(_cover(spark, sf))


def _cover(spark, sf):
    t = _trials(spark, sf)
    patches = [t.filter("agent = 'click'"), t.filter("agent = 'error'")]
    return curation.cover_then_fill(t.filter("agent = 'view' and level < 4"), patches, t, BY, ORDER)


def _steps(steps):
    union = None
    for name, df in steps.items():
        part = df.select(F.lit(name).alias("step"), "query_id", "event_id")
        union = part if union is None else union.unionByName(part)
    return union


@query(COVER + """,
s as (select 'first' as strategy, level from one union all select 'patched', level from one union all select 'patched', level from two),
q as (select level, count(*) as nq from (select distinct query_id, level from {trials} t) x group by 1),
r as (select strategy, s.level, round(count(*) / max(nq), 2) as rate from s join q on s.level = q.level group by 1, 2)
select strategy, max(rate) filter (level = 0) as level_0, max(rate) filter (level = 1) as level_1, max(rate) filter (level = 2) as level_2,
  max(rate) filter (level = 3) as level_3, max(rate) filter (level = 4) as level_4, max(rate) filter (level = 5) as level_5
from r group by strategy
""")
def strategy_matrix(spark, sf):
    """H7."""
    steps = _cover(spark, sf)
    queries = _trials(spark, sf).select("query_id", "level").distinct()
    return reports.strategy_matrix({k: steps[k] for k in ("first", "patched")}, queries, [0, 1, 2, 3, 4, 5])


@query("select dataset, count(*) as n from {resp} r group by dataset")
def responses_per_dataset(spark, sf):
    """H1."""
    return reports.count_by(view(spark, sf, "resp"), "dataset")


COUNTS = "select query_id, count(*) as n from {trials} t where correct group by 1"


@query(f"""
select count(n) as n_queries, avg(n) as mean, stddev_samp(n) as std, min(n) as min, max(n) as max,
  quantile_cont(n, 0.01) as p1, quantile_cont(n, 0.05) as p5, quantile_cont(n, 0.1) as p10, quantile_cont(n, 0.2) as p20,
  quantile_cont(n, 0.3) as p30, quantile_cont(n, 0.4) as p40, quantile_cont(n, 0.5) as p50
from ({COUNTS}) x
""")
def describe_corrects(spark, sf):
    """H2."""
    return reports.describe_counts(reports.corrects_per_query(_trials(spark, sf), BY))


@query(f"""
with c as ({COUNTS}), e as (select min(n) as lo, max(n) as hi from c)
select cast(least(floor((n - lo) / ((hi - lo) / 100.0)), 99) as int) as bin, count(*) as n from c, e group by 1
""")
def corrects_histogram(spark, sf):
    """H3."""
    return reports.histogram(reports.corrects_per_query(_trials(spark, sf), BY), "n", 100)


@query("""
select level, count(*) / max(nq) as avg_responses from {trials} t
join (select level as l, count(*) as nq from (select distinct query_id, level from {trials} u) y group by 1) q on q.l = t.level
where correct group by level
""")
def level_average(spark, sf):
    """H4."""
    t = _trials(spark, sf)
    return reports.level_average(t.filter("correct"), t.select("query_id", "level").distinct())


@query("""
select resp_id, r.query, case when l_partkey % 3 = 0 then r.level else 0 end as level from {resp} r
""")
def level_lookup(spark, sf):
    """Left lookup on trimmed text, default 0."""
    df = view(spark, sf, "resp")
    levels = df.filter("l_partkey % 3 = 0").select("query", "level").distinct()
    padded = df.withColumn("query", F.concat(F.lit(" \t"), "query", F.lit("\n ")))
    return reports.with_level(padded, levels).select("resp_id", "query", "level")


@query("""
select count(*) as n_queries, count(*) filter (ok) as n_covered, count(*) filter (ok) / count(*) as coverage
from (select query_id, bool_or(correct and agent = 'view') as ok from {trials} t group by 1) x
""")
def coverage(spark, sf):
    """H6, I9."""
    t = _trials(spark, sf)
    return reports.coverage(t.filter("correct and agent = 'view'"), t, "query_id")


@query("select agent, count(*) as n_datasets, avg(a) as macro_accuracy from (select agent, dataset, avg(case when hit then 1.0 else 0.0 end) as a from {resp} r group by 1, 2) x group by agent")
def macro_accuracy(spark, sf):
    """H12."""
    return reports.macro_average(view(spark, sf, "resp").withColumnRenamed("hit", "correct"))


@query("""
select agent, avg(case when hit then 1.0 else 0.0 end) filter (dataset = 'math/train') as "math/train",
  avg(case when hit then 1.0 else 0.0 end) filter (dataset = 'gsm8k-fix/train') as "gsm8k-fix/train" from {resp} r group by agent
""")
def accuracy_matrix(spark, sf):
    """H12 as a table of agents by datasets."""
    graded = view(spark, sf, "resp").withColumnRenamed("hit", "correct")
    return reports.accuracy_matrix(graded, ["math/train", "gsm8k-fix/train"])


@query("""
with a as (select agent, dataset, (seq % 4) * 0.5 as t, avg(case when hit then 1.0 else 0.0 end) as acc from {resp} r group by 1, 2, 3),
k as (select *, row_number() over (partition by agent, dataset order by acc desc, t) as k from a)
select agent, dataset, cast(t as double) as best_temperature, acc as accuracy from k where k = 1
""")
def best_temperature(spark, sf):
    """H13."""
    graded = view(spark, sf, "resp").withColumnRenamed("hit", "correct").withColumn("temperature", F.expr("(seq % 4) * 0.5D"))
    return reports.best_temperature(graded)


@query("select distinct query from {resp} r where hit")
def covered_queries(spark, sf):
    """H15."""
    return reports.covered_queries(view(spark, sf, "resp").withColumnRenamed("hit", "correct"))


@query("select distinct query from {resp} r where not hit and agent = 'agent1' and query not in (select query from {resp} s where hit and agent = 'agent0')")
def uncovered_queries(spark, sf):
    """C7, D5, H15."""
    df = view(spark, sf, "resp").withColumnRenamed("hit", "correct")
    covered = reports.covered_queries(df.filter("agent = 'agent0'"))
    return reports.uncovered_queries(df.filter("agent = 'agent1'"), covered)


@query("""
select doc_id from (select doc_id, row_number() over (order by md5(concat(cast(doc_id as varchar), '|42')), doc_id) as k from documents) x where k <= 123
""")
def sample_exact(spark, sf):
    """Exactly n rows."""
    return ranking.sample_rows(table(spark, sf, "documents"), "doc_id", 123).select("doc_id")


@query("""
select event_id from (select event_id, row_number() over (order by md5(concat(cast(event_id as varchar), '|7')), event_id) as k, count(*) over () as n from events) x where k <= floor(0.3 * n)
""")
def sample_share(spark, sf):
    """A share of the rows."""
    return ranking.sample_rows(table(spark, sf, "events"), "event_id", 0.3, 7).select("event_id")


@query("select event_id, row_number() over (order by md5(concat(cast(event_id as varchar), '|42')), event_id) - 1 as position from events")
def seeded_shuffle(spark, sf):
    """Seeded order, numbered without a single-task sort."""
    df = table(spark, sf, "events").select("event_id", ranking.order_hash(F.col("event_id")).alias("h"))
    return ranking.dense_index(df, ["h", "event_id"], "position").select("event_id", "position")


@query("""
select l_partkey, max(run_id * 100000 + seq) as last_key from {resp} r group by l_partkey
""")
def last_per_key(spark, sf):
    """The last row of every key."""
    df = view(spark, sf, "resp").withColumn("last_key", F.expr("run_id * 100000 + seq"))
    return ranking.keep_latest(df, ["l_partkey"], ["last_key", "resp_id"]).select("l_partkey", "last_key")


@query("select query_id, count(*) as n_trials, sum(case when correct then 1 else 0 end) / count(*) as pass_rate from {trials} t group by query_id order by query_id")
def sorted_report(spark, sf):
    """H11, I16."""
    return quotas.difficulty(_trials(spark, sf), BY).select("query_id", "n_trials", "pass_rate").orderBy("query_id")

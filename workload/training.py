"""Registered queries: tokens, labels, packing and the streams."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rftspark.operators import packing, quotas, reports, tokens
from rftspark.plans import training
from rftspark.runtime import pinned, scratch_path
from rftspark.sources import files
from rftspark.streaming import incremental

from .base import query, table, view

TOKENS = r"regexp_extract_all({0}, '\w+|[^\w\s]')"
IDS = "list_transform(" + TOKENS + ", lambda t: cast(('0x' || substr(md5(t), 1, 8))::bigint % 31999 + 1 as int))"
PROMPT = (
    "concat('Below is an instruction that describes a task. Write a response that appropriately completes the request.', "
    "chr(10), chr(10), '### Instruction:', chr(10), query, chr(10), chr(10), '### Response:', chr(10))"
)


def _joined(df, *columns):
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), " ") for c in columns})


def _text(sql: str) -> str:
    return f"array_to_string({sql}, ' ')"


@query(f"select doc_id, cast(len({TOKENS.format('text')}) as int) as n, {_text(IDS.format('text'))} as ids from documents")
def tokenize_documents(spark, sf):
    """Native ids of whole documents."""
    df = tokens.tokenize(table(spark, sf, "documents"), {"text": "ids"})
    return _joined(df.select("doc_id", F.size("ids").alias("n"), "ids"), "ids")


@query("select doc_id, cast(least(len(regexp_extract_all(text, '[^\\s]+')), 64) as int) as n from documents")
def python_tokenizer(spark, sf):
    """An encoder of one's own on Arrow batches, cut at a maximum length."""

    def make_encoder():
        word = re.compile(r"[^\s]+", re.ASCII)
        return lambda texts: [[len(w) for w in word.findall(t)] for t in texts]

    df = tokens.tokenize(table(spark, sf, "documents"), {"text": "ids"}, 64, make_encoder)
    return df.select("doc_id", F.size("ids").alias("n"))


SUPERVISED = f"""
with s as (select id, {PROMPT} as src, concat(response, '</s>') as tgt from {{qa}} q),
i as (select id, list_slice({IDS.format("concat(src, tgt)")}, 1, 300) as ids, least(len(list_slice({TOKENS.format('src')}, 1, 300)), 300) as hidden from s)
"""


@query(SUPERVISED + """
select id, array_to_string(ids, ' ') as input_ids,
  array_to_string(list_concat(list_transform(range(least(hidden, len(ids))), lambda x: -100), list_slice(ids, hidden + 1, len(ids))), ' ') as labels,
  array_to_string(list_transform(ids, lambda x: 1), ' ') as attention_mask
from i
""")
def supervised_rows(spark, sf):
    """J1-J4."""
    return _joined(_examples(spark, sf, 300), "input_ids", "labels", "attention_mask")


def _source(spark, sf):
    return training.Source("qa", view(spark, sf, "qa"))


def _examples(spark, sf, max_len=None, **options):
    df = training.examples_of(_source(spark, sf), max_len=max_len, **options)
    return df.withColumn("id", F.substring("id", 4, 100))


@query(SUPERVISED + """
select id, cast(len(ids) as int) as n, cast((select max(len(ids)) from i) as int) as padded, array_to_string(list_slice(ids, len(ids), len(ids)), '') as last_id from i
""")
def padded_rows(spark, sf):
    """Padded to the longest row and back."""
    padded = tokens.pad_right(_examples(spark, sf, 300))
    wide = padded.withColumn("padded", F.size("input_ids"))
    back = tokens.unpad(wide)
    return back.select("id", F.size("input_ids").alias("n"), "padded", F.element_at("input_ids", -1).cast("string").alias("last_id"))


@query(SUPERVISED + """
select id, array_to_string(list_transform(ids, lambda x: case when x % 7 = 0 then -100 else x end), ' ') as labels from i
""")
def labels_from_ids(spark, sf):
    """Labels made from ids, padding masked, left side."""
    df = _examples(spark, sf, 300).drop("labels")
    marked = df.withColumns(
        {
            "input_ids": F.concat(F.array(F.lit(0), F.lit(0)), F.transform("input_ids", lambda x: F.when(x % 7 == 0, 0).otherwise(x))),
            "attention_mask": F.concat(F.array(F.lit(0), F.lit(0)), "attention_mask"),
        }
    )
    return _joined(tokens.unpad(marked, "left").select("id", "labels"), "labels")


PACKED = """
with recursive l as (select id, {len} as len, row_number() over (order by md5(concat({key}, '|42')), {key}) as k from {rows}),
w as (select k, id, len, cast(0 as bigint) as pack_id, cast(len as bigint) as load, cast(0 as bigint) as pos from l where k = 1
  union all select l.k, l.id, l.len, case when w.load + l.len <= {cap} then w.pack_id else w.pack_id + 1 end,
    case when w.load + l.len <= {cap} then w.load + l.len else l.len end,
    case when w.load + l.len <= {cap} then w.pos + 1 else 0 end from w join l on l.k = w.k + 1)
"""
QA_PACKS = PACKED.format(len="length(response)", rows="{qa} q", cap=4096, key="id")


def _lengths(spark, sf):
    return view(spark, sf, "qa").select("id", F.length("response").alias("len"))


@query(QA_PACKS + 'select id, len::int as len, pack_id, (load - len)::bigint as "offset", pos::int as pos from w')
def pack_exact(spark, sf):
    """Equal to one sequential pass, built from eight stretches."""
    return packing.assign_packs(_lengths(spark, sf), 4096, stretches=8)


@query("""
select max(n_chars) <= 1000000 as fits, count(*) as n, count(*) as n_distinct from documents
""")
def pack_sharded(spark, sf):
    """J8, sharded: every sequence once, no pack too long."""
    lengths = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.greatest(F.length("text"), F.lit(1)).alias("len"))
    placed = packing.assign_packs(lengths, 1_000_000, mode="sharded", stretches=4)
    packs = placed.groupBy("pack_id").agg(F.sum("len").alias("l"), F.count(F.lit(1)).alias("c"), F.countDistinct("id").alias("d"))
    return packs.agg((F.max("l") <= 1_000_000).alias("fits"), F.sum("c").alias("n"), F.sum("d").alias("n_distinct"))


@query(QA_PACKS + """
select count(*) as n_sequences, max(pack_id) + 1 as n_packs, avg(len) as avg_sequence_len, sum(len) / (max(pack_id) + 1) as avg_pack_len from w
""")
def pack_stats(spark, sf):
    """H14."""
    return packing.pack_stats(packing.assign_packs(_lengths(spark, sf), 4096, stretches=4))


@query(QA_PACKS + """
select pack_id, concat('0 ', string_agg(cast(load as varchar), ' ' order by pos)) as cu_seqlens, cast(max(len) as int) as max_segment from w group by pack_id
""")
def segment_offsets(spark, sf):
    """J10."""
    return _joined(packing.segment_offsets(packing.assign_packs(_lengths(spark, sf), 4096, stretches=4)), "cu_seqlens")


PACK_ROWS = SUPERVISED.replace("with s as", "with recursive s as") + """
, n as (select id, len(ids) as len from i),
""" + PACKED.format(len="len", rows="n", cap=1024, key="'qa:' || id").replace("\nwith recursive l as", "l as") + """
, e as (select w.pack_id, w.pos, i.ids, list_concat(list_transform(range(greatest(least(hidden, len(ids)), 1)), lambda x: -100), list_slice(ids, greatest(hidden, 1) + 1, len(ids))) as labels
  from w join i on i.id = w.id)
"""


@query(PACK_ROWS + """
select pack_id, string_agg(array_to_string(ids, ' '), ' ' order by pos) as input_ids, string_agg(array_to_string(labels, ' '), ' ' order by pos) as labels,
  string_agg(array_to_string(list_transform(ids, lambda x: pos + 1), ' '), ' ' order by pos) as attention_mask, 1024 as width
from e group by pack_id
""")
def pack_rows(spark, sf):
    """Assembled packs; the padding is checked by its width and cut for the comparison."""
    packed = training.build([_source(spark, sf)], pack_len=1024, max_len=300)
    wide = packed.withColumn("width", F.size("input_ids"))
    real = F.size(F.filter("attention_mask", lambda m: m > 0))
    cut = wide.withColumns({c: F.slice(c, F.lit(1), real) for c in ("input_ids", "labels", "attention_mask")})
    return _joined(cut, "input_ids", "labels", "attention_mask")


@query(SUPERVISED + "select 2 * count(*) as n, cast(2 * sum(len(ids)) as bigint) as n_tokens, cast(max(len(ids)) as int) as max_len from i")
def combined_sources(spark, sf):
    """Two sources with their own field names, shuffled and padded."""
    qa = view(spark, sf, "qa")
    other = qa.select(F.col("id").alias("key"), F.col("query").alias("q"), F.col("response").alias("a"))
    both = [training.Source("qa", qa), training.Source("other", other, "key", "q", "a")]
    built = training.build(both, max_len=300)
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return built.agg(F.count(F.lit(1)).alias("n"), F.sum(real).alias("n_tokens"), F.max(F.size("input_ids")).alias("max_len"))


@query(f"""
select avg(len({TOKENS.format('query')})) as average_query_token_size, avg(len({TOKENS.format('response')})) as average_response_token_size,
  cast(sum(len({TOKENS.format('query')})) as bigint) as total_query_tokens, cast(sum(len({TOKENS.format('response')})) as bigint) as total_response_tokens
from {{qa}} q
""")
def token_stats(spark, sf):
    """H8."""
    df = tokens.tokenize(view(spark, sf, "qa"), {"query": "query_tokens", "response": "response_tokens"})
    return reports.token_stats(df)


@query(SUPERVISED + "select cast(max(len(ids)) as int) as max_len from i")
def longest_row(spark, sf):
    """From the kept token table."""
    home = scratch_path(spark, "tokens")
    _examples(spark, sf, 300, cache_home=home)
    return reports.longest(_examples(spark, sf, 300, cache_home=home))


# --- streams --------------------------------------------------------------------------


def _trial_rounds(spark, sf, batches=4):
    """Trials by round of arrivals, numbered once; rounds behind the last count to it."""
    round_no = F.least(F.floor((F.col("trial_no") - 1) / 16), F.lit(batches - 1))
    rows = pinned(view(spark, sf, "trials").withColumn("round", round_no))
    return [rows.filter(F.col("round") == i) for i in range(batches)]


STREAMED = """
with r as (select *, row_number() over (partition by query_id order by event_id) as rk from {trials} t),
b as (select *, least(floor((rk - 1) / 16), 3) as batch from r),
c as (select *, coalesce(sum(case when correct then 1 else 0 end) over (partition by query_id order by batch range between unbounded preceding and 1 preceding), 0) as seen from b)
"""
KEPT = STREAMED + ", k as (select query_id, event_id, correct, rk as trial, cast(seen as bigint) as corrects_before from c where rk <= 60 and seen <= 3)"


def _arriving(spark, sf, build):
    """Path and schema of what ``build`` makes of a stream of trials, one micro-batch per round.

    The files of a round arrive together, as many as tasks wrote them, and the stream goes on from
    its checkpoint.
    """
    path, out, mark = (scratch_path(spark, n) for n in ("arrivals", "stream", "offsets"))
    for rows in _trial_rounds(spark, sf):
        files.write_parquet(rows, path, append=True)
        df = build(incremental.read_stream(spark, path, rows.schema, "parquet"))
        incremental.append_sink(df, out, mark).awaitTermination()
    return out, df.schema


def _run_rounds(spark, sf, build):
    out, schema = _arriving(spark, sf, build)
    return spark.read.schema(schema).parquet(out)


def _stopped(arrivals):
    return incremental.stop_stream(arrivals, ["query_id"], ["event_id"], 60, 3)


def _run(spark, df):
    out, mark = scratch_path(spark, "stream"), scratch_path(spark, "offsets")
    incremental.append_sink(df, out, mark).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query(KEPT + "select * from k")
def stream_stop(spark, sf):
    """K2: stateful stop rule over four micro-batches."""
    return _run_rounds(spark, sf, _stopped)


@query("select resp_id, given as ans, hit as correct from {resp} r")
def stream_grade(spark, sf):
    """K1, A4: grade and append what arrives."""
    path = scratch_path(spark, "responses")
    rows = view(spark, sf, "resp")
    files.write_jsonl(rows, path, compression="gzip", max_rows=100_000)
    arriving = incremental.read_stream(spark, path, rows.schema)
    graded = incremental.grade_stream(arriving, mode="math").select("resp_id", "ans", "correct")
    return _run(spark, graded)


RESUMED = STREAMED + """, f as (select *, query_id % 70 as t0, query_id % 5 as c0 from c)
select query_id, event_id, correct, rk + t0 as trial, cast(seen + c0 as bigint) as corrects_before from f where rk + t0 <= 60 and seen + c0 <= 3
"""


@query(RESUMED)
def stream_stop_resumed(spark, sf):
    """K2: counters of an earlier run to start from."""
    status = pinned(view(spark, sf, "trials").select("query_id").distinct()).withColumns(
        {"n_trials": F.col("query_id") % 70, "n_corrects": F.col("query_id") % 5}
    )
    return _run_rounds(
        spark, sf, lambda arrivals: incremental.stop_stream(arrivals, ["query_id"], ["event_id"], 60, 3, status=status)
    )


@query(STREAMED + ", k as (select *, row_number() over (partition by query_id order by batch, event_id) as n from c) "
       "select query_id, event_id, correct, n as trial, cast(seen as bigint) as corrects_before from k where n <= 20 and seen <= 5")
def stream_own_rule(spark, sf):
    """K2, L1: a rule of one's own in the stream."""
    def build(arrivals):
        return incremental.stop_stream(
            arrivals, ["query_id"], ["event_id"], 1000, 0, rule=lambda trials, corrects: trials >= 20 or corrects > 5
        )

    return _run_rounds(spark, sf, build)


def _kept_stream(spark, sf):
    """What the stop rule kept, as a stream of its own.

    A round leaves one file per shuffle partition at most. As many files make a micro-batch, so there
    are no more of them than rounds, however many partitions there are.
    """
    out, schema = _arriving(spark, sf, _stopped)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    return incremental.read_stream(spark, out, schema, "parquet", maxFilesPerTrigger=partitions)


def _last_round(spark, path):
    rounds = spark.read.parquet(path)
    return rounds.filter(F.col("round") == rounds.agg(F.max("round")).scalar()).drop("round")


@query(KEPT + "select query_id, count(*) as n_trials, cast(sum(case when correct then 1 else 0 end) as bigint) as n_corrects from k group by query_id")
def stream_progress(spark, sf):
    """K3: live counters of what the stop rule kept; here after the last micro-batch."""
    out, mark = scratch_path(spark, "progress"), scratch_path(spark, "offsets")

    def publish(status, batch_id):
        status.write.mode("overwrite").parquet(f"{out}/round={batch_id}")

    live = incremental.progress_stream(_kept_stream(spark, sf), ["query_id"])
    writer = live.writeStream.outputMode("complete").option("checkpointLocation", mark).trigger(availableNow=True)
    writer.foreachBatch(publish).start().awaitTermination()
    return _last_round(spark, out)


@query(KEPT + """
, s as (select query_id, count(*) as n_trials, sum(case when correct then 1 else 0 end) as n_corrects from k group by query_id)
select query_id, cast(floor((row_number() over (order by n_trials, query_id) - 1) / 10) as bigint) as batch_no from s where n_trials < 60 and n_corrects <= 3
""")
def stream_hand_out(spark, sf):
    """K3, K4: after every micro-batch of kept rows the work that is left; here the last round."""
    queries = pinned(view(spark, sf, "trials").select("query_id").distinct())
    out, mark = scratch_path(spark, "work"), scratch_path(spark, "offsets")
    incremental.hand_out(_kept_stream(spark, sf), queries, ["query_id"], 60, 3, out, mark, paths_per_batch=10).awaitTermination()
    return _last_round(spark, out).select("query_id", "batch_no")

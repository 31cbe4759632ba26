"""Registered queries: prompts, transcripts, query sets, files and batch requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from rftspark import schemas
from rftspark.operators import prompts, transcripts
from rftspark.plans.curation import curate, grade_path
from rftspark.runtime import scratch_path
from rftspark.sources import adapters, files, requests

from .base import derived, query, table, view

ALPACA = (
    "concat('Below is an instruction that describes a task. Write a response that appropriately completes the request.', "
    "chr(10), chr(10), '### Instruction:', chr(10), q.query, chr(10), chr(10), '### Response:', chr(10))"
)
USER = "concat('User:', chr(10), {0}, chr(10), chr(10), 'Assistant:', chr(10), {1})"


@query(f"""
select id, case q.turn % 4 when 0 then {USER.format('q.query', "''")}
  when 1 then concat('Below is an instruction that describes a task. Write a response that appropriately completes the request.', chr(10), chr(10), '### Instruction:', chr(10), q.query, chr(10), chr(10), '### Response: Let''s think step by step.')
  when 2 then {ALPACA} else {ALPACA} end as prompt, q.turn % 4 = 3 as defaulted
from {{qa}} q
""")
def render_prompts(spark, sf):
    """Templates by id, the default one for unknown ids."""
    ids = F.expr("case turn % 4 when 0 then 'qa' when 1 then 'wizardmath-cot' when 2 then 'alpaca' else 'unknown' end")
    df = view(spark, sf, "qa").withColumn("prompt_template", ids)
    return prompts.render(df, prompts.template_table(spark)).select("id", "prompt", "defaulted")


@query(f"""
with e as (select q1, a1, q2, a2 from (select max(query) filter (k = 1) as q1, max(response) filter (k = 1) as a1,
  max(query) filter (k = 2) as q2, max(response) filter (k = 2) as a2
  from (select *, row_number() over (order by id) as k from {{qa}} y) x) z),
r as (select q.*, case q.turn % 3 when 0 then 2 when 1 then 1 else 0 end as n from {{qa}} q)
select r.id, concat(case when n >= 1 then concat({USER.format('q1', 'a1')}, chr(10), chr(10)) else '' end,
  case when n >= 2 then concat({USER.format('q2', 'a2')}, chr(10), chr(10)) else '' end, {USER.format('r.query', "''")}) as prompt
from r, e
""")
def few_shot_prompts(spark, sf):
    """Examples from a table, their number by model."""
    df = view(spark, sf, "qa").withColumns(
        {
            "dataset": F.lit("chat"),
            "n_shots": F.expr("case turn % 3 when 0 then -1 when 1 then 1 else 0 end"),
            "agent": F.lit("EleutherAI--llemma_7b"),
            "prompt_template": F.lit("qa"),
        }
    )
    first_two = df.orderBy("id").limit(2)
    shown = F.transform(
        F.array_sort(F.collect_list(F.struct("id", F.col("query").alias("q"), F.col("response").alias("a")))),
        lambda e: F.struct(e["q"].alias("q"), e["a"].alias("a")),
    )
    examples = first_two.groupBy("dataset").agg(shown.alias("examples"))
    shots = prompts.shots_table(spark).unionByName(spark.createDataFrame([("chat", 2)], "dataset string, default_shots int"))
    with_examples = prompts.examples_for(df, examples, shots)
    return prompts.render(with_examples, prompts.template_table(spark)).select("id", "prompt")


@query("""
select id, case turn % 4 when 0 then concat('Solve.', chr(10), 'Q: ', query, chr(10), 'A:') else rtrim(concat('User:', chr(10), query, chr(10), chr(10), 'Assistant:', chr(10)), ' ') end as prompt,
  false as defaulted from {qa} q
""")
def template_from_file(spark, sf):
    """A template by the path of its file, others by id."""
    path = scratch_path(spark, "template")
    texts = {"sys_prompt": "Solve.\n", "query_prompt": "Q: ", "prompt_after_query": "\n", "resp_prompt": "A: ", "prompt_before_resp": ""}
    files.write_jsonl(spark.range(1).select(*[F.lit(v).alias(k) for k, v in texts.items()]), path)
    known = prompts.template_table(spark).unionByName(prompts.read_templates(spark, [path]))
    df = view(spark, sf, "qa").withColumn("prompt_template", F.when(F.col("turn") % 4 == 0, path).otherwise("qa"))
    return prompts.render(df, known).select("id", "prompt", "defaulted")


@query("""
select o_orderkey, case o_custkey % 7 when 0 then 'qa' when 1 then 'deepseekmath' when 2 then 'xwinmath' when 3 then 'mammoth2-cot'
  when 4 then 'llama3-math' else 'alpaca' end as cot, case when o_custkey % 7 = 1 then 'deepseekmath-tool' end as tool,
  cast(case when o_custkey % 7 in (0, 3) then 4 else 0 end as int) as shots, o_custkey % 7 = 6 as asks_answer
from orders
""")
def template_choice(spark, sf):
    """Template and number of examples by model name."""
    agent = F.expr(
        "case o_custkey % 7 when 0 then 'EleutherAI--llemma_7b' when 1 then 'deepseek-ai/deepseek-math-7b-rl' "
        "when 2 then 'Xwin-LM/Xwin-Math-7B' when 3 then 'TIGER-Lab--MAmmoTH2-8B' when 4 then 'meta-llama--Meta-Llama-3-8B-Instruct' "
        "when 5 then 'other' else 'some/MMIQC-model' end"
    )
    df = table(spark, sf, "orders").select("o_orderkey", agent.alias("agent"))
    chosen = prompts.choose_template(df, "cot").withColumnRenamed("prompt_template", "cot")
    return chosen.select(
        "o_orderkey", "cot", prompts.template_id(F.lit("tool"), F.col("agent")).alias("tool"),
        prompts.example_count(F.lit(-1), F.col("agent"), F.lit(4)).cast("int").alias("shots"),
        F.col("response_start").isNotNull().alias("asks_answer"),
    )


EN = "The following is an open-ended problem from an International {0} competition. "
TASK = (
    "'Please calculate the answer according to the given requirements and the information provided. Please use LaTeX format to represent "
    "the variables and formulas used in the solution process and results. Please end your solution with \"So the final answer is ', "
    "{box}, '.\" and give the result explicitly', {unit}, '.'"
)


@query(f"""
with r as (select p_partkey, p_name as question, p_type as context, p_size % 2 = 0 as many, p_size % 3 = 0 as has_unit, p_size % 4 as k from part)
select p_partkey, concat('{EN.format("Math")}',
  case when k = 3 then '' when not many then case k when 0 then 'The answer of The problem should be a numerical value. ' when 1 then 'The answer of The problem should be an interval. ' else 'The answer of The problem should be an expression. ' end
  when k = 0 then 'The problem has multiple answers, each of them should be a numerical value. '
  when k = 1 then 'The problem has multiple answers, each of them should be an interval. '
  else 'The problem has multiple answers, with the answers in order being an expression, an equation. ' end,
  {TASK.format(box="concat(case when many then concat(chr(92), 'boxed{multiple answers connected with commas}') else concat(chr(92), 'boxed{answer}') end, case when has_unit then '(unit)' else '' end)",
   unit="case when has_unit then concat(', note that the unit of the answer should not be included in ', chr(92), 'boxed{}') else '' end")},
  chr(10), question) as query
from r
""")
def olympiad_prompts(spark, sf):
    """Wording by subset, answer type, number of answers and unit."""
    df = table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("question"), F.col("p_type").alias("context"),
        (F.col("p_size") % 2 == 0).alias("is_multiple_answer"),
        F.when(F.col("p_size") % 3 == 0, "cm").otherwise("").alias("unit"),
        F.expr("case p_size % 4 when 0 then 'Numerical' when 1 then 'Interval' when 2 then 'Expression,Equation' else 'Tuple' end").alias("answer_type"),
    )
    return prompts.olympiad_query(df, "OE_TO_maths_en_COMP").select("p_partkey", "query")


@query("""
select p_partkey, concat('以下是中国物理竞赛中的证明题。请根据题目的要求，运用逻辑推理及常用定理证明题目中的命题。证明过程中使用的变量和公式请使用LaTeX格式表示。', chr(10), p_type, chr(10), p_name) as query from part
""")
def olympiad_proofs(spark, sf):
    """Proofs; context only outside mathematics."""
    df = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("question"), F.col("p_type").alias("context"))
    return prompts.olympiad_query(df, "TP_physics_zh_COMP").select("p_partkey", "query")


TRANSCRIPT = """
select o_orderkey, concat('Plan ', o_orderstatus, chr(10), '```python', chr(10), 'print(', cast(o_custkey as varchar(20)), ')', chr(10), '```', chr(10),
  case when o_custkey % 3 = 0 then '' else concat('```output', chr(10), cast(o_custkey as varchar(20)), chr(10), '```', chr(10)) end,
  case when o_custkey % 5 = 0 then concat('```python', chr(10), ' x = ', cast(o_orderkey as varchar(20)), chr(10), '```', chr(10)) else '' end,
  case when o_custkey % 7 = 0 then concat('```output', chr(10), '1', chr(10), '```', '```output', chr(10), '2', chr(10), '```') else '' end,
  case when o_custkey % 11 = 0 then 'The answer is 3' else '' end) as text,
  o_custkey % 3 <> 0 as out1, o_custkey % 5 = 0 as in2, o_custkey % 7 = 0 as out2, o_custkey % 11 = 0 as said, o_custkey,
  cast(o_custkey % 5000 as int) as n_tokens
from {orders}
"""
COUNTED = f"(select *, 1 + cast(in2 as int) as i, cast(out1 as int) + 2 * cast(out2 as int) as o from ({TRANSCRIPT.replace('{orders}', 'orders')}) t)"


@query(f"""
select o_orderkey, cast(i as int) as n_inputs, cast(o as int) as n_outputs, cast(case when i = o then 1 when o > i then 2 else 0 end as int) as state,
  case when i = o or said then 'finished' when o > i then 'over-output' when o >= 1 then 'call' when n_tokens >= 3276.8 then 'total-length' end as stop_reason
from {COUNTED} c
""")
def transcript_state(spark, sf):
    """C8, C9."""
    df = derived(spark, sf, TRANSCRIPT)
    marks = transcripts.CellMarks(max_n_calls=1)
    return transcripts.stop_reason(df, marks=marks).select("o_orderkey", "n_inputs", "n_outputs", "state", "stop_reason")


@query(f"""
select o_orderkey, 0 as cell_no, concat('print(', cast(o_custkey as varchar), ')') as cell from {COUNTED} c
union all select o_orderkey, 1, concat('x = ', cast(o_orderkey as varchar)) from {COUNTED} c where in2
""")
def transcript_cells(spark, sf):
    """C10."""
    return transcripts.cells(derived(spark, sf, TRANSCRIPT)).select("o_orderkey", "cell_no", "cell")


@query("""
with c as (select l_orderkey, l_linenumber, l_suppkey, l_partkey, concat('step ', cast(l_partkey as varchar)) as text,
  case when l_linenumber % 3 = 0 then null else repeat(concat(l_returnflag, cast(l_suppkey as varchar), '|'), cast(l_quantity as int)) end as o from lineitem),
d as (select *, case when length(o) > 20 then concat(left(o, 10), '...', right(o, 10)) else o end as cut from c)
select l_orderkey, count(*) as n_calls, string_agg(concat(text, case when cut is null then '' else concat(chr(10), '```output', chr(10), cut, chr(10), '```', chr(10)) end), '' order by l_linenumber, l_suppkey, l_partkey) as transcript
from d group by l_orderkey
""")
def transcript_assembly(spark, sf):
    """Outputs cut in the middle, wrapped, joined in call order."""
    marks = transcripts.CellMarks(trunc_len=(10, 10))
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_suppkey", "l_partkey").alias("call_no"),
        F.concat(F.lit("step "), F.col("l_partkey").cast("string")).alias("text"),
        F.expr("case when l_linenumber % 3 = 0 then null else repeat(concat(l_returnflag, cast(l_suppkey as string), '|'), cast(l_quantity as int)) end").alias("output"),
    )
    return transcripts.assemble(transcripts.truncated(df, "output", marks), ["l_orderkey"], marks)


# --- query sets -----------------------------------------------------------------------


def _part(spark, sf, **columns):
    return table(spark, sf, "part").select(*[F.expr(e).alias(n) for n, e in columns.items()])


@query("""
select p_name as query, case when p_size % 5 = 0 then null else concat(chr(92), 'frac{', cast(p_size as varchar), '}{2}') end as ref_ans,
  cast(case when p_size % 7 = 0 then case when p_name like 'We%' then 2 else 1 end else p_size % 5 + 1 end as int) as level, replace(p_type, ' ', '') as domain, 'math/train' as dataset
from part where p_size % 7 = 0 or p_size % 5 + 1 in (2, 3, 1, 4, 5)
""")
def load_math(spark, sf):
    """A13, H9."""
    raw = _part(
        spark, sf, problem="p_name", level="case when p_size % 7 = 0 then 'Level ?' else concat('Level ', p_size % 5 + 1) end", type="p_type",
        solution="case when p_size % 5 = 0 then concat('It is ', chr(92), 'fbox{3}') else concat('So ', chr(92), 'boxed{', chr(92), 'frac{', p_size, '}{2}}.') end",
    )
    return adapters.adapt(raw, "math/train")


@query("select p_name as query, cast(p_size as varchar) as ref_ans, 'gsm8k/test' as dataset from part")
def load_gsm8k(spark, sf):
    """A14."""
    raw = _part(spark, sf, question="p_name", answer="concat('#### 0 no', chr(10), '#### ', p_size)")
    return adapters.adapt(raw, "gsm8k/test")


@query("select p_name as query, cast(p_size as varchar) as ref_ans, p_size % 8 as n_step, 'gsm8k-fix/train' as dataset from part")
def load_gsm8k_fix(spark, sf):
    """A15."""
    raw = _part(spark, sf, query="p_name", gt_ans="cast(p_size as string)", query_metadata="named_struct('n_step', p_size % 8)")
    return adapters.adapt(raw, "gsm8k-fix/train")


@query("select p_name as query, cast(p_size as varchar) as ref_ans, p_brand as source, p_type as domain, 'mwpbench/gaokaobench' as dataset from part")
def load_mwpbench(spark, sf):
    """A16."""
    raw = _part(spark, sf, question="p_name", answer="cast(p_size as string)", data_source="concat('a.b.', p_brand)", data_topic="concat('c.', p_type)")
    return adapters.adapt(raw, "mwpbench/gaokaobench")


@query("select p_name as query, cast(p_size as varchar) as ref_ans, 'deepmind-mathematics' as dataset from part")
def load_generated_math(spark, sf):
    """A17."""
    return adapters.adapt(_part(spark, sf, question="p_name", answer="cast(p_size as string)"), "deepmind-mathematics")


@query(f"""
select concat('{EN.format("Math")}', 'The answer of The problem should be a numerical value. ',
  {TASK.format(box="concat(chr(92), 'boxed{answer}')", unit="''")}, chr(10), p_name) as query,
  cast(p_size as varchar) as ref_ans, cast(case when p_size % 2 = 0 then 0.01 end as double) as abs_tol, p_type as domain, 'olympiadbench/OE_TO_maths_en_COMP' as dataset from part
""")
def load_olympiad(spark, sf):
    """A18."""
    raw = _part(
        spark, sf, question="p_name", final_answer="array(cast(p_size as string), 'x')", error="case when p_size % 2 = 0 then '1e-2' end",
        subfield="p_type", answer_type="'Numerical'", is_multiple_answer="false", unit="cast(null as string)", context="'c'",
    )
    return adapters.adapt(raw, "olympiadbench/OE_TO_maths_en_COMP")


@query("""
select p_name as query, case p_size % 4 when 0 then 'True' when 1 then cast(p_size as varchar) when 2 then concat('[', cast(p_size as varchar), ', 2]') else 'option' end as ref_ans,
  case when p_size % 4 = 1 then cast(p_size as double) end as ref_num, 'theoremqa' as dataset from part
""")
def load_theoremqa(spark, sf):
    """A19, M4."""
    raw = _part(spark, sf, Question="p_name", Answer="case p_size % 4 when 0 then 'true' when 1 then cast(p_size as string) when 2 then concat('[', p_size, ', 2]') else 'option' end")
    return adapters.adapt(raw, "theoremqa")


@query("select p_name as query, cast(p_size as varchar) as ref_ans, p_type as domain, p_size % 5 as level, 'odyssey-math' as dataset from part")
def load_odyssey(spark, sf):
    """A20."""
    raw = _part(spark, sf, e="map(cast(p_partkey as string), named_struct('question', p_name, 'answer', cast(p_size as string), 'label', p_type, 'level', p_size % 5))")
    return adapters.adapt(raw, "odyssey-math")


@query("select p_name as query, cast(p_size as varchar) as ref_ans, p_brand as id, 'aops' as dataset from part")
def load_forum(spark, sf):
    """A21."""
    return adapters.adapt(_part(spark, sf, problem="p_name", answer="cast(p_size as string)", link="p_brand"), "aops")


@query("""
select 'gsm8k/test' as dataset, concat('q', cast(p_partkey as varchar)) as query, cast(p_size as varchar) as ref_ans, 8 as max_n_trials, 2 as min_n_corrects, -1 as level from part
union all select 'math/train', concat('m', cast(p_partkey as varchar)), case when p_size % 2 = 0 then cast(p_size as varchar) else cast(p_size as varchar) || '.5' end, 16, 3, cast(p_size % 5 + 1 as int)
  from part where p_size % 5 + 1 in (1, 3) and p_size % 2 = 0
union all select 'mine', query, ref_ans, 4, 0, -1 from (select concat('f', cast(p_partkey as varchar)) as query, cast(p_size as varchar) as ref_ans,
  row_number() over (order by md5(concat('f', cast(p_partkey as varchar), '|42')), concat('f', cast(p_partkey as varchar))) as k from part) x where k <= 50
""")
def load_many(spark, sf):
    """Several sets with filters, a sample and limits each."""
    raws = {
        "gsm8k/test": _part(spark, sf, question="concat('q', p_partkey)", answer="concat('x', chr(10), '#### ', p_size)"),
        "math/train;level=[1, 3];ref_ans=int": _part(
            spark, sf, problem="concat('m', p_partkey)", level="concat('Level ', p_size % 5 + 1)", type="p_type",
            solution="concat(chr(92), 'boxed{', p_size, case when p_size % 2 = 0 then '' else '.5' end, '}')",
        ),
        "mine;sample=50": _part(spark, sf, query="concat('f', p_partkey)", ref_ans="cast(p_size as string)"),
    }
    loaded = adapters.load_queries(raws, [8, 16, 4], [2, 3, 0])
    level = F.coalesce("level", F.lit(-1)).alias("level")
    return loaded.select("dataset", "query", "ref_ans", "max_n_trials", "min_n_corrects", level)


@query("""
select resp_id, dataset, r.query, p.p_name as domain, ref_ans, agent, resp from {resp} r join part p on p.p_partkey = r.l_partkey
""")
def collect_responses(spark, sf):
    """B1, B2: query columns on every response, long fields last."""
    queries = view(spark, sf, "resp").select("l_partkey", "dataset", "query", "ref_ans").distinct()
    queries = queries.join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("domain")), "l_partkey")
    found = adapters.collect_responses(queries, view(spark, sf, "resp").select("l_partkey", "resp_id", "agent", "resp"), ["l_partkey"])
    return adapters.output_order(found).drop("l_partkey")


@query("""
select p_name as query, case when p_size % 3 = 0 then concat('c', cast(p_size as varchar)) else cast(p_size as varchar) end as ref_ans from part
""")
def mapped_fields(spark, sf):
    """Reference field where there is one, else extracted from the solution."""
    from rftspark.functions import sqltext
    from rftspark.functions.extract import raw_answer

    df = _part(
        spark, sf, problem="p_name", ans="case when p_size % 3 = 0 then concat('c', p_size) end", solution="concat('The answer is ', p_size, '.')"
    )
    extract = raw_answer(sqltext.col("solution")).column()
    return requests.mapped_fields(df, {"query": "problem", "ref_ans": "ans"}, extract)


# --- files ----------------------------------------------------------------------------


@query("select resp_id, dataset, query, ref_ans, seq as n_step, resp from {resp} r")
def jsonl_round_trip(spark, sf):
    """A1, A3, M2: JSON lines out and in, unknown fields kept in a map."""
    path = scratch_path(spark, "jsonl")
    rows = view(spark, sf, "resp").select("resp_id", "dataset", "query", "ref_ans", F.col("seq").alias("n_step"), "resp")
    files.write_jsonl(rows, path)
    back = files.read_jsonl(spark, path, schemas.RESPONSE)
    return back.select(F.col("extras")["resp_id"].alias("resp_id"), "dataset", "query", "ref_ans", "n_step", "resp")


@query("select o_orderkey, o_custkey from orders")
def json_array_scan(spark, sf):
    """A2: files that hold one JSON array each."""
    path = scratch_path(spark, "arrays")
    # One array per customer group keeps every array small.
    grouped = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 64).alias("g")).agg(
        F.to_json(F.collect_list(F.struct("o_orderkey", "o_custkey"))).alias("value")
    )
    grouped.select("value").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    schema = schemas.T.StructType.fromDDL("o_orderkey long, o_custkey long")
    return files.read_json_array(spark, path, schema)


@query("select resp_id from {resp} r union all select resp_id from {resp} r where hit")
def append_sink(spark, sf):
    """A4."""
    path = scratch_path(spark, "append")
    df = view(spark, sf, "resp")
    files.write_parquet(df.select("resp_id"), path)
    files.write_parquet(df.filter("hit").select("resp_id"), path, append=True)
    return spark.read.parquet(path)


@query("select resp_id, agent from {resp} r")
def append_ledger(spark, sf):
    """A4: one batch per agent, each appended twice, as after a lost run; every row counts once."""
    path, df = scratch_path(spark, "ledger"), view(spark, sf, "resp").select("resp_id", "agent")
    for agent in ("agent0", "agent1", "agent2") * 2:
        files.append_once(df.filter(F.col("agent") == agent), path, agent)
    return files.read_batches(spark, path, df.schema)


def _run_files(spark, sf):
    """Graded runs as files, one directory per agent; every task writes its own file."""
    root = scratch_path(spark, "runs")
    df = view(spark, sf, "resp").withColumnRenamed("hit", "correct")
    rows = df.select("dataset", "query", "ref_ans", "resp", "agent", "correct", F.col("resp_id").alias("id"))
    for agent in ("agent0", "agent1", "agent2"):
        files.write_jsonl(rows.filter(F.col("agent") == agent), f"{root}/{agent}")
    return [f"{root}/{a}" for a in ("agent0", "agent1", "agent2")]


@query("select agent, count(*) as n from {resp} r where agent <> 'agent1' group by agent")
def scan_run_files(spark, sf):
    """Directories and a name pattern."""
    dirs = _run_files(spark, sf)
    scan = files.scan_runs(spark, [dirs[0], dirs[2]], schemas.RESPONSE, r"part-\d+")
    return scan.groupBy("agent").agg(F.count(F.lit(1)).alias("n"))


@query("select n from (select agent, count(*) as n from {resp} r group by agent) x")
def rows_per_file(spark, sf):
    """A5: counts per file, added up per run directory."""
    per_file = files.rows_per_file(files.scan_runs(spark, _run_files(spark, sf), schemas.RESPONSE))
    run = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1).alias("run")
    return per_file.groupBy(run).agg(F.sum("n").alias("n")).select("n")


@query("select query, least(count(*), 3) as n from {resp} r where hit group by query")
def curate_files(spark, sf):
    """Scan, pick and export."""
    out = scratch_path(spark, "curated")
    curate(spark, _run_files(spark, sf), r"part", 3, out)
    return spark.read.schema("query string").json(out).groupBy("query").agg(F.count(F.lit(1)).alias("n"))


@query("select resp_id as id, hit as correct from {resp} r")
def grade_files(spark, sf):
    """Graded copy of a response file."""
    root, out = scratch_path(spark, "raw"), scratch_path(spark, "graded")
    df = view(spark, sf, "resp")
    files.write_jsonl(df.select(F.col("resp_id").alias("id"), "dataset", "query", "ref_ans", "resp", "finish_reason"), root, compression="lz4")
    grade_path(spark, root, out, mode="math", compression="lz4")
    return spark.read.schema("id string, correct boolean").json(out)


@query("""
select l_key, cast(floor(i / 700) * 700 as bigint) as split_start, cast(least(floor(i / 700) * 700 + 700, n) as bigint) as split_end
from (select resp_id as l_key, row_number() over (order by resp_id) - 1 as i, count(*) over () as n from {resp} r) x
""")
def split_sink(spark, sf):
    """Numbered rows in files of a fixed size."""
    path = scratch_path(spark, "splits")
    files.write_splits(view(spark, sf, "resp").select(F.col("resp_id").alias("l_key")), path, ["l_key"], 700)
    return spark.read.schema("l_key string, split_start long, split_end long").json(path)


@query("""
select o_orderkey, concat('org--m', cast(o_custkey % 3 as varchar), '-outlen2048-t', case when o_custkey % 2 = 0 then '0' else '0.7' end, '-p',
  case when o_custkey % 2 = 0 then '1' else '0.95' end, '-prompt-alpaca-math--train-0shot-tag-a-seed', cast(o_orderkey % 5 as varchar), '.jsonl') as run_name
from orders
""")
def run_names(spark, sf):
    """A10."""
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.expr("concat('org/m', o_custkey % 3)").alias("model"), F.lit(2048).alias("max_new_toks"),
        F.expr("case when o_custkey % 2 = 0 then 0.0D else 0.7D end").alias("temperature"), F.lit(0.95).alias("top_p"),
        F.lit("alpaca").alias("prompt_template"), F.lit("math/train").alias("dataset"), F.lit(0).alias("n_shots"), F.lit("a").alias("tag"),
        (F.col("o_orderkey") % 5).alias("seed"),
    )
    return files.run_name(df).select("o_orderkey", "run_name")


def _requests(spark, sf):
    queries = view(spark, sf, "resp").select("query", "l_partkey").distinct()
    return requests.build_requests(queries, F.lit("org/set/train"), F.col("l_partkey"), n=2)


@query("""
select distinct concat('org/set/train:', cast(l_partkey as varchar)) as custom_id, query, 2 as n, 'system' as first_role from {resp} r
""")
def batch_requests(spark, sf):
    """B4, M9."""
    return _requests(spark, sf).select(
        "custom_id", F.element_at("body.messages", -1)["content"].alias("query"), F.col("body.n").alias("n"),
        F.col("body.messages")[0]["role"].alias("first_role"),
    )


@query("""
select distinct concat('org/set/train:', cast(l_partkey as varchar)) as custom_id, r.query from {resp} r
where query in (select query from {resp} s where hit and agent = 'agent0')
""")
def todo_requests(spark, sf):
    """Only prompts of the to-do set."""
    todo = view(spark, sf, "resp").filter("hit and agent = 'agent0'").select("query").distinct()
    queries = view(spark, sf, "resp").select("query", "l_partkey").distinct().join(todo, "query", "left_semi")
    built = requests.build_requests(queries, F.lit("org/set/train"), F.col("l_partkey"))
    return built.select("custom_id", F.element_at("body.messages", -1)["content"].alias("query"))


@query("""
with q as (select distinct l_partkey, query, ref_ans from {resp} r)
select 't' || cast(l_partkey % 2 as varchar) as task, concat('org/set/train:', cast(l_partkey as varchar)) as custom_id, 'org/set/train' as dataset, query,
  'm' || cast(l_partkey % 3 as varchar) as agent, cast(c as int) as choice_no, concat('The answer is ', cast(l_partkey + c as varchar)) as resp, ref_ans
from q, (select unnest([0, 1]) as c) n
""")
def batch_responses(spark, sf):
    """Paired files, one row per choice, reference joined by query."""
    root = scratch_path(spark, "batches")
    asked = _requests(spark, sf).withColumn("k", F.split_part("custom_id", F.lit(":"), F.lit(2)).cast("long"))
    choice = lambda c: F.struct(
        F.lit(c).alias("index"),
        F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("The answer is "), (F.col("k") + c).cast("string")).alias("content")).alias("message"),
    )
    answered = asked.select(
        "custom_id", "k",
        F.struct(F.struct(F.concat(F.lit("m"), (F.col("k") % 3).cast("string")).alias("model"), F.array(choice(0), choice(1)).alias("choices")).alias("body")).alias("response"),
    )
    # File names of a task come from the service; here the directory carries them.
    for kind, df in (("req", asked), ("resp", answered)):
        for t in (0, 1):
            files.write_jsonl(df.filter(F.col("k") % 2 == t).drop("k"), f"{root}/{kind}/task=t{t}")
    read = lambda kind, schema: spark.read.schema(
        schemas.T.StructType([*schema.fields, schemas.T.StructField("task", schemas._S)])
    ).json(f"{root}/{kind}")
    flat = requests.flatten_responses(read("resp", schemas.BATCH_RESPONSE), read("req", schemas.REQUEST), ["task", "custom_id"])
    answers = view(spark, sf, "resp").select(F.concat(F.lit(" "), "query", F.lit("\n")).alias("query"), "ref_ans", "resp_id")
    return requests.with_reference(flat, answers, ["resp_id"]).drop("prompt_template")


@query("select distinct concat('org/set/train:', cast(l_partkey as varchar)) as custom_id from {resp} r where l_partkey % 10 = 3")
def unmatched_responses(spark, sf):
    """Responses without a request."""
    asked = _requests(spark, sf)
    number = F.split_part("custom_id", F.lit(":"), F.lit(2)).cast("long")
    return requests.unmatched_responses(asked, asked.filter(number % 10 != 3), ["custom_id"]).select("custom_id")


@query("select doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as trimmed from documents")
def trimmed_text(spark, sf):
    """B6 over whole documents."""
    return table(spark, sf, "documents").select("doc_id", requests.trimmed(F.col("text")).alias("trimmed"))

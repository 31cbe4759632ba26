"""Registered queries: extraction, normalisation and grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from rftspark.functions import sqltext
from rftspark.functions.equality import percent_equal, set_equal
from rftspark.functions.extract import boxed_lenient, boxed_strict, clean, explicit_answer
from rftspark.functions.normalize import distinct_elements
from rftspark.functions.values import date_time
from rftspark.operators import grading
from rftspark.operators.quotas import difficulty
from rftspark.plans.verdicts import grade_stored
from rftspark.runtime import scratch_path, spread

from .base import derived, query, table, view


def _pool(spark, sf):
    return view(spark, sf, "resp", wide="lineitem")


@query("select resp_id, given as ans from {resp} r")
def extract_answers(spark, sf):
    """E1-E9 on five response styles."""
    return grading.extract_answers(_pool(spark, sf)).select("resp_id", "ans")


@query("select resp_id, case when seq % 5 in (1, 4) then '' else given end as raw from {resp} r")
def extract_strict(spark, sf):
    """E7 with announced answers only."""
    df = _pool(spark, sf)
    from rftspark.functions.extract import raw_answer

    return df.select("resp_id", raw_answer(sqltext.col("resp"), strict=True).column().alias("raw"))


@query("""
select doc_id, coalesce(
    list_extract(regexp_extract_all(text, '(?s)(?:\\$|\\\\\\(|\\\\\\[)([^$]+)(?:\\$|\\\\\\(|\\\\\\[)', 1), -1),
    list_extract(regexp_extract_all(replace(text, ',', ''), '-?\\d*\\.?\\d+'), -1), '') as raw
from documents
""")
def extract_from_documents(spark, sf):
    """Last formula, else last number, over whole documents."""
    from rftspark.functions.extract import raw_answer

    docs = table(spark, sf, "documents")
    return docs.select("doc_id", raw_answer(sqltext.col("text")).column().alias("raw"))


@query(r"""
select doc_id, rtrim(ltrim(trim(text, chr(9)||chr(10)||chr(13)||' '), chr(9)||chr(10)||chr(13)||' !)]}:./,#?$"''ки'),
    chr(9)||chr(10)||chr(13)||' ([{\:./,#?$"''ки') as cleaned
from documents
""")
def clean_text(spark, sf):
    """Both ends of whole documents."""
    return table(spark, sf, "documents").select("doc_id", clean(sqltext.col("text")).column().alias("cleaned"))


@query("""
select resp_id, given as strict, case when seq % 3 = 2 then concat(given, '}') else given end as lenient
from {resp} r where seq % 3 <> 1
union all select resp_id, null as strict, concat('{', given, ' and the rest') as lenient from {resp} r where seq % 3 = 1
""")
def boxed_content(spark, sf):
    r"""Nested, escaped and unclosed boxes."""
    text = F.expr(
        "concat('x ', chr(92), 'boxed{0} then ', chr(92), 'boxed{', case seq % 3 "
        "when 0 then concat(given, '}') "
        "when 1 then concat('{', given, ' and the rest') "
        "else concat(given, chr(92), '}}') end)"
    )
    df = _pool(spark, sf).withColumn("text", text)
    found = df.select(
        "resp_id",
        boxed_strict(sqltext.col("text")).column().alias("strict"),
        boxed_lenient(sqltext.col("text")).column().alias("lenient"),
    )
    # An escaped brace closes a strict box and is part of a lenient one; both keep the backslash.
    return found.withColumns({c: F.replace(c, F.lit("\\"), F.lit("")) for c in ("strict", "lenient")})


@query("""
select resp_id, case seq % 4 when 0 then given when 1 then null when 2 then 'True' else concat('$', given) end as announced
from {resp} r
""")
def explicit_cues(spark, sf):
    """Cue rules in order."""
    text = F.expr(
        "case seq % 4 when 0 then concat('Thus, ', given, ' is the answer, I think') "
        "when 1 then concat('we get ', given) when 2 then 'The statement is Yes.' "
        "else concat('Old. # Answer', chr(10), chr(10), 'answer: $', given, '$') end"
    )
    df = _pool(spark, sf).withColumn("text", text)
    return df.select("resp_id", explicit_answer(sqltext.col("text")).column().alias("announced"))


@query("select resp_id, coalesce(case when seq % 2 = 0 then 'kept' end, given) as ans from {resp} r")
def keep_given_answers(spark, sf):
    """Answers that are there stay."""
    df = _pool(spark, sf).withColumn("ans", F.when(F.col("seq") % 2 == 0, "kept"))
    return grading.extract_answers(df, keep=True).select("resp_id", "ans")


@query(r"""
with n as (select resp_id, seq % 16 as k, given as g from {resp} r)
select resp_id, case k
  when 0 then g when 1 then '\frac{'||g||'}{3}' when 2 then '\frac{1}{'||substr(g, 1, 1)||'}'||substr(g, 2)
  when 3 then g when 4 then g when 5 then g
  when 6 then '\sqrt{'||g||'}' when 7 then '\sin^{2}x+'||g
  when 8 then 'x-'||g||',x+'||g when 9 then g when 10 then 'Wednesday' when 11 then 'False'
  when 12 then '(0,'||g||']\cup(2,\infty)' when 13 then g||'i' when 14 then g else g end as norm
from n
""")
def normalize_answers(spark, sf):
    """F1-F19 on sixteen written forms."""
    b = "chr(92)"
    text = F.expr(
        f"case seq % 16 when 0 then concat(' ', given, '. ') when 1 then concat({b}, 'dfrac{{', given, '}}{{3}}') "
        f"when 2 then concat({b}, 'frac1', given) when 3 then concat({b}, 'text{{', given, '}}') "
        f"when 4 then concat('$', given, '.00$') when 5 then concat('x = ', given, {b}, '%') "
        f"when 6 then concat('sqrt ', given) when 7 then concat('sin^2 x + ', given) "
        f"when 8 then concat('x', {b}, 'pm ', given) when 9 then concat('((', given, '))') when 10 then 'wed' "
        f"when 11 then 'Incorrect, no' when 12 then concat('(0,', given, ']∪(2,∞)') when 13 then concat(given, 'j') "
        f"when 14 then concat('00', given, ' hours') else concat('a=b=', given) end"
    )
    df = _pool(spark, sf).withColumn("text", text)
    return grading.normalize_answers(df, "text", "norm").select("resp_id", "norm")


@query("""
select resp_id, given as ans, hit as correct,
  case when finish_reason = 'length' then 'truncated' when hit then 'literal' else 'numeric' end as match_tier
from {resp} r
""")
def grade_responses(spark, sf):
    """One scan, no shuffle."""
    graded = grading.grade(_pool(spark, sf), mode="math")
    return graded.select("resp_id", "ans", "correct", "match_tier")


@query("""
select resp_id, given as ans, hit as correct,
  case when finish_reason = 'length' then 'truncated' when hit then 'literal' else 'numeric' end as match_tier
from {resp} r
""")
def grade_from_store(spark, sf):
    """G1: half of the pool is graded first, its verdicts are read when the whole pool is graded."""
    home, pool = scratch_path(spark, "verdicts"), _pool(spark, sf)
    grade_stored(pool.filter("l_partkey % 2 = 0"), home, mode="math")
    return grade_stored(pool, home, mode="math").select("resp_id", "ans", "correct", "match_tier")


@query("select resp_id, hit as correct from {resp} r")
def grade_in_place(spark, sf):
    """G1 without dedup: one scan, no shuffle."""
    return grading.grade(_pool(spark, sf), mode="math", dedup=False).select("resp_id", "correct")


@query("select resp_id, hit as correct from {resp} r")
def grade_hot_pairs(spark, sf):
    """G1 with every pair treated as hot: salted join back."""
    return grading.grade(_pool(spark, sf), mode="math", dedup=True, hot_rows=20).select("resp_id", "correct")


def _form_responses(spark, sf):
    text = F.expr(
        "case when l_linenumber % 2 = 0 then concat('So it is ', chr(92), 'boxed{', pred, '}.') "
        "else concat('The answer is ', pred, '.') end"
    )
    return view(spark, sf, "forms", wide="lineitem").withColumn("resp", text)


@query("select resp_id, form, same as correct from {forms} f")
def grade_forms(spark, sf):
    """Twelve written forms with a right and a wrong variant each."""
    return grading.grade(_form_responses(spark, sf), mode="math", dedup=True).select("resp_id", "form", "correct")


def _written(spark, sf, name):
    """Verdicts of a view of (ref_ans, pred), the answer in a box."""
    text = F.concat(F.lit("So it is \\boxed{"), F.col("pred"), F.lit("}."))
    rows = view(spark, sf, name, wide="lineitem").select("*", text.alias("resp"), F.lit("What is x?").alias("query"))
    return grading.grade(rows, mode="math", dedup=True).select("resp_id", "form", "correct")


@query("select resp_id, form, same as correct from {composed} f")
def grade_composed(spark, sf):
    """Twenty composed forms: brackets, nested ratios, powers, factorials, logarithms, mixed numbers."""
    return _written(spark, sf, "composed")


@query("select resp_id, form, same as correct from {identities} f")
def grade_identities(spark, sf):
    """Expressions, equations and inequalities with free variables."""
    return _written(spark, sf, "identities")


@query("select resp_id, form, same as correct from {unions} f")
def interval_unions(spark, sf):
    """Touching, nested and overlapping parts, single points, intersections, infinite ends."""
    return _written(spark, sf, "unions")


@query("select doc_id, doc_id % 2 = 0 as correct from documents")
def grade_long_answers(spark, sf):
    """Answers as long as the documents: nested and alternating parentheses, a long ratio, a long sum of roots."""
    text = """
      select doc_id, 'math/train' as dataset, 'What is x?' as query, 'stop' as finish_reason,
        case doc_id % 6 div 2
          when 0 then cast(doc_id + off as string)
          when 1 then concat(chr(92), 'frac{', w + 2 * off, '}{2}')
          else cast(2 * w + off as string) end as ref_ans,
        concat('The answer is ', chr(92), 'boxed{', case doc_id % 6 div 2
          when 0 then case when doc_id % 12 < 6 then concat(repeat('(', w), doc_id, repeat(')', w))
            else concat(repeat('([', 20 * w), doc_id, repeat('])', 20 * w)) end
          when 1 then concat(chr(92), 'frac{', repeat('1+', w - 1), '1}{2}')
          else concat(repeat(concat(chr(92), 'sqrt{4}+'), w - 1), chr(92), 'sqrt{4}') end, '}') as resp
      from (select *, cast(doc_id % 2 as int) as off from _long) t
    """
    words = F.greatest(F.lit(1), F.size(F.split(F.coalesce("text", F.lit("")), " "))).alias("w")
    # Only ids and lengths move; small tasks, since an answer may be as long as thousands of others.
    lengths = table(spark, sf, "documents").select("doc_id", words)
    spread(lengths, rows=5_000).createOrReplaceTempView("_long")
    return grading.grade(spark.sql(text), mode="math").select("doc_id", "correct")


@query("""
select form, count(*) as n, cast(sum(case when same then 1 else 0 end) as bigint) as n_correct
from {forms} f group by form
""")
def correct_by_form(spark, sf):
    graded = grading.grade(_form_responses(spark, sf), mode="math", dedup=True)
    return graded.groupBy("form").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("n_correct")
    )


@query("""
select count(*) as n, count(*) filter (lost) as n_undecided, count(*) filter (lost) / count(*) as undecided_rate
from (select form = 7 and not same or form = 11 and not same and ref_ans = '20' as lost from {forms} f) x
""")
def undecided_share(spark, sf):
    """What only a symbolic check could decide."""
    return grading.undecided_rate(grading.grade(_form_responses(spark, sf), mode="math", dedup=True))


@query("""
select concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-', cast(l_suppkey as varchar(20)), '-', cast(l_partkey as varchar(20))) as resp_id,
  case l_orderkey % 4
    when 0 then l_partkey % 2 = 0
    when 1 then l_partkey % 2 = 0
    when 2 then (l_partkey % 5) * 0.01 <= 0.02 * 1.01
    else l_partkey % 2 = 0 end as correct
from lineitem
""")
def grade_olympiad(spark, sf):
    """Lists in any order, signs, tolerance per row, intervals in order."""
    text = """
      select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_suppkey as string), '-', cast(l_partkey as string)) as resp_id,
        'olympiadbench/OE_TO_maths_en_COMP' as dataset, 'q' as query, 'stop' as finish_reason,
        case l_orderkey % 4
          when 0 then concat(chr(92), 'boxed{', q, '}, so ', chr(92), 'boxed{', q + 100, '}')
          when 1 then concat('$', q, chr(92), 'pm ', 2, '$')
          when 2 then cast(q as string)
          else concat('$(', q, ',', q + 100, ']$') end as ref_ans,
        case l_orderkey % 4
          when 0 then concat(chr(92), 'boxed{', q + 100, ',', chr(92), 'frac{', 2 * (q + off), '}{2}}')
          when 1 then concat(chr(92), 'boxed{', q - 2, ',', q + 2 + off, '}')
          when 2 then concat(chr(92), 'boxed{', q, '.0', l_partkey % 5, '}')
          else concat(chr(92), 'boxed{(', q, ',', case off when 0 then q + 100 else q + 101 end, ']}') end as resp,
        case when l_orderkey % 4 = 2 then 0.02D end as abs_tol
      from (select *, cast(l_quantity as int) as q, cast(l_partkey % 2 as int) as off from {lineitem}) t
    """
    return grading.grade(derived(spark, sf, text, wide="lineitem"), dedup=True).select("resp_id", "correct")


@query("""
select dataset, query, count(*) as n_trials, cast(sum(case when hit then 1 else 0 end) as bigint) as n_corrects,
  avg(case when hit then 1.0 else 0.0 end) as pass_rate, 1 - avg(case when hit then 1.0 else 0.0 end) as fail_rate
from {resp} r group by dataset, query
""")
def pass_rates(spark, sf):
    """H11 on graded responses."""
    return difficulty(grading.grade(_pool(spark, sf), mode="math"), ["dataset", "query"])


@query("""
select event_id, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%H:%M:00') as clock,
  strftime(ts, '%Y-%m-%d %H:%M:%S') as moment from events
""")
def date_forms(spark, sf):
    """Dates and times of every event, written in other formats."""
    ts = F.col("ts")
    df = table(spark, sf, "events").select(
        "event_id",
        F.date_format(ts, "d/M/yyyy").alias("a"),
        F.date_format(ts, "h:m a").alias("b"),
        F.date_format(ts, "yyyy/M/d H:m:s").alias("c"),
    )
    # Day before month wherever both readings are possible.
    return df.select(
        "event_id",
        *[date_time(sqltext.col(c)).column().alias(n) for c, n in (("a", "day"), ("b", "clock"), ("c", "moment"))],
    )


@query("""
with v as (select event_id, value as r, round(value / 100, 3) as p from events),
f as (select event_id, p, unnest([r / 100, r * 100]) as x from v)
select event_id, bool_or(((p > 0 and p < 1) or (p > 1 and p < 100)) and ((x > 0 and x < 1) or (x > 1 and x < 100))
  and abs(x - p) <= greatest(0.001 * greatest(abs(x), abs(p)), 1e-8)) as same
from f group by event_id
""")
def percent_forms(spark, sf):
    """G7 on event values and their rounded hundredth."""
    r, p = sqltext.col("r"), sqltext.col("p")
    df = table(spark, sf, "events").select(
        "event_id", F.col("value").alias("r"), F.round(F.col("value") / 100, 3).alias("p")
    )
    return df.select("event_id", percent_equal(r, p).column().alias("same"))


@query("""
select resp_id, cast(case when given = ref_ans then 2 else 3 end as int) as n_elements,
  case when given = ref_ans then concat_ws('|', least(given, '70000'), greatest(given, '70000'))
  else array_to_string(list_sort([given, ref_ans, '70000']), '|') end as elements
from {resp} r
""")
def set_elements(spark, sf):
    """Distinct elements of a list answer, merged and sorted."""
    df = _pool(spark, sf).withColumn("text", F.expr("concat('{', given, ',70000 or ', ref_ans, ',', given, '.0}')"))
    found = df.withColumn("e", distinct_elements(sqltext.col("text")).column())
    return found.select(
        "resp_id", F.size("e").alias("n_elements"), F.array_join(F.transform("e", lambda e: e["norm"]), "|").alias("elements")
    )


@query("""
select resp_id, given = ref_ans as same from {resp} r
""")
def matched_sets(spark, sf):
    """One-to-one match of two element lists."""
    df = _pool(spark, sf).select(
        "resp_id",
        distinct_elements(sqltext.Sql("concat('(', given, ',77777)')")).column().alias("a"),
        distinct_elements(sqltext.Sql("concat('77777.0 or ', ref_ans)")).column().alias("b"),
    )
    return df.select("resp_id", set_equal(sqltext.col("a"), sqltext.col("b")).column().alias("same"))


@query("select resp_id, given = ref_ans and finish_reason <> 'length' as correct from {resp} r")
def custom_evaluator(spark, sf):
    """L2: a Python equality on the distinct pair table."""
    rule = grading.python_evaluator(lambda ref, ans: int(ref) == int(ans))
    return grading.grade(_pool(spark, sf), evaluator=rule).select("resp_id", "correct")


@query("""
select doc_id, regexp_matches(text, '[^\\x00-\\x7F]') as non_ascii, contains(text, 'ind the') or (contains(text, 'all') and contains(text, 'separate')) as set_question
from documents
""")
def text_predicates(spark, sf):
    """C5, C6 over whole documents."""
    return table(spark, sf, "documents").select(
        "doc_id", F.col("text").rlike(r"[^\x00-\x7F]").alias("non_ascii"), grading.wants_set(F.col("text")).alias("set_question")
    )

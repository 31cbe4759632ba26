"""Tables, derived views and the catalogue of registered queries.

A derived view is one SQL text for both engines, so that a query and its check start from
the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rftspark.runtime import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Response pool: the answer a response gives is kept in ``given``; ``hit`` says it is right.
RESP = """
select concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-',
    cast(l_suppkey as varchar(20)), '-', cast(l_partkey as varchar(20))) as resp_id,
  case when l_partkey % 2 = 0 then 'math/train' else 'gsm8k-fix/train' end as dataset,
  concat('What is item ', cast(l_partkey as varchar(20)), '?') as query,
  case when l_partkey % 2 = 0 then cast(floor(l_partkey / 2) as bigint) % 5 + 1 else 0 end as level,
  cast(p_size as varchar(20)) as ref_ans,
  concat('agent', cast(l_suppkey % 3 as varchar(20))) as agent,
  case when l_returnflag = 'N' and l_quantity > 45 then 'length' else 'stop' end as finish_reason,
  l_orderkey as run_id, l_linenumber as seq, l_suppkey, l_partkey, v as given,
  (v = cast(p_size as varchar(20)) and not (l_returnflag = 'N' and l_quantity > 45)) as hit,
  case l_linenumber % 5
    when 0 then concat('Step one. Therefore, the answer is $', chr(92), 'boxed{', v, '}$.')
    when 1 then concat('We add things up.', chr(10), '#### ', v)
    when 2 then concat('So $x$ is found. Therefore, $', v, '$ is our answer.')
    when 3 then concat('The answer is ', v, '.')
    else concat('Adding 1,000 and more we get ', v) end as resp
from (select l.*, p_size, case when (l_orderkey * 7 + l_linenumber) % 100 < l_partkey % 100
             then cast(p_size as varchar(20)) else cast(cast(l_quantity as int) + 50 as varchar(20)) end as v
      from {lineitem} l join {part} p on l_partkey = p_partkey) t
"""

# Graded pool without text.
TRIALS = """
select user_id as query_id, event_id,
  cast(row_number() over (partition by user_id order by event_id) as int) as trial_no,
  (event_id * 7919 + user_id * 31) % 100 < user_id % 100 as correct, event_type as agent,
  user_id % 6 as level
from {events}
"""

# Query and response pairs.
QA = """
select concat(cast(a.conv_id as varchar(20)), '-', cast(a.turn as varchar(20))) as id,
  a.conv_id, a.turn, a.text as query, b.text as response
from {conversations} a join {conversations} b on a.conv_id = b.conv_id and b.turn = a.turn + 1
where a.role = 'user' and b.role = 'assistant'
"""

# Answers in many written forms. ``same`` says whether the second form has the value of the first.
FORMS = """
select concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-',
    cast(l_suppkey as varchar(20)), '-', cast(l_partkey as varchar(20))) as resp_id,
  form, same, l_linenumber, l_orderkey,
  case form when 3 then 'Find the values of x.' else 'What is x?' end as query,
  case form
    when 0 then s
    when 1 then concat(s, '007')
    when 2 then s
    when 3 then concat('{', s, ',', t, '}')
    when 4 then concat(chr(92), 'begin{pmatrix}', s, chr(92), chr(92), t, chr(92), 'end{pmatrix}')
    when 5 then concat('[', s, ',', big, ')')
    when 6 then concat(substr(day, 9, 2), '/', substr(day, 6, 2), '/', substr(day, 1, 4))
    when 7 then 'True'
    when 8 then concat(chr(92), 'sqrt{', cast(a * a as varchar(20)), '}')
    when 9 then concat(chr(92), 'frac{', s, chr(92), 'pi}{', t, '}')
    when 10 then s
    else cast(a % 20 + 1 as varchar(20)) end as ref_ans,
  case form
    when 0 then concat(chr(92), 'frac{', cast(a * b + off as varchar(20)), '}{', t, '}')
    when 1 then concat(s, ',00', cast(7 + off as varchar(20)))
    when 2 then concat('0.', lpad(cast(a + off as varchar(20)), 2, '0'))
    when 3 then concat(t, ' and ', cast(a + 60 * off as varchar(20)))
    when 4 then concat(chr(92), 'begin{bmatrix}', s, chr(92), chr(92), chr(92), 'frac{', cast(2 * (b + off) as varchar(20)), '}{2}', chr(92), 'end{bmatrix}')
    when 5 then concat('[', chr(92), 'frac{', cast(2 * a as varchar(20)), '}{2},', big, case off when 0 then ')' else ']' end)
    when 6 then concat(substr(day, 1, 4), '-', substr(day, 6, 2), '-', case off when 0 then substr(day, 9, 2) else '32' end)
    when 7 then case off when 0 then 'yes' else 'no' end
    when 8 then cast(a + off as varchar(20))
    when 9 then concat(cast(a + off as varchar(20)), chr(92), 'pi/', t)
    when 10 then case off when 0 then concat(s, ' km') else concat(cast(a + 60 as varchar(20)), ' hours') end
    else split_part('one,two,three,four,five,six,seven,eight,nine,ten,eleven,twelve,thirteen,fourteen,fifteen,sixteen,seventeen,eighteen,nineteen,twenty,fifty', ',', a % 20 + 1 + off) end as pred
from (select l_orderkey, l_linenumber, l_suppkey, l_partkey, cast(l_quantity as int) as a, l_linenumber + 1 as b,
        cast(cast(l_quantity as int) as varchar(20)) as s, cast(l_linenumber + 1 as varchar(20)) as t,
        cast(cast(l_quantity as int) + 60 as varchar(20)) as big,
        cast(l_partkey % 2 as int) as off, l_partkey % 2 = 0 as same,
        cast(cast(l_shipdate as date) as varchar(20)) as day,
        cast((l_orderkey + l_linenumber) % 12 as int) as form
      from {lineitem}) q
"""

# Values written as composed expressions; a wrong one is off by one.
COMPOSED = r"""
select resp_id, form, same,
  case form
    when 0 then concat(f, 'frac{', a + off, '}{', 3 * b, '}')
    when 1 then concat(2 * (a + b) + off, '')
    when 2 then concat(case b when 2 then 2 when 3 then 6 when 4 then 24 when 5 then 120 when 6 then 720 when 7 then 5040 else 40320 end + off, '')
    when 3 then concat(b + off, '')
    when 4 then concat(a + off, '.5')
    when 5 then concat(b + off, '')
    when 6 then concat(a + off, '.5')
    when 7 then concat(cast(b * (b - 1) / 2 as int) + off, '')
    when 8 then concat(a + off, '')
    when 9 then concat(a * a - 1 + off, '')
    when 10 then concat(2 * a - b + off, '')
    when 11 then concat(f, 'frac{', a * (b + 1) + off, '}{2}')
    when 12 then concat(a + 1 + off, '')
    when 13 then concat(a + off, '')
    when 14 then concat(f, 'frac{', a + b + off, '}{2}')
    when 15 then concat(cast(power(2, b + 1) as bigint) + off, '')
    when 16 then concat(a + off, '')
    when 17 then concat(b + off, '')
    when 18 then concat(a + 1 + off, '')
    else concat(a + off, '') end as ref_ans,
  case form
    when 0 then concat(f, 'frac{', f, 'frac{', a, '}{', b, '}}{3}')
    when 1 then concat('2(', a, '+', b, ')')
    when 2 then concat(b, '!')
    when 3 then concat(f, 'log_2 ', cast(power(2, b) as bigint))
    when 4 then concat(a, '+', f, 'sin{', f, 'frac{', f, 'pi}{6}}')
    when 5 then concat(f, 'ln(e^', b, ')')
    when 6 then concat(a, f, 'frac{1}{2}')
    when 7 then concat(f, 'binom{', b, '}{2}')
    when 8 then concat(f, 'frac{', a, '^{3}}{', a, '^{2}}')
    when 9 then concat('(', a, '+1)(', a, '-1)')
    when 10 then concat(a, '-(', b, '-', a, ')')
    when 11 then concat(f, 'frac{', a, '(', b, '+1)}{2}')
    when 12 then concat(f, 'sqrt{', a, '^{2}+2*', a, '+1}')
    when 13 then concat(f, 'lfloor ', a, '.7', f, 'rfloor')
    when 14 then concat('((', a, '+', b, ')*2)/4')
    when 15 then concat('2^{', b, '+1}')
    when 16 then concat(a, f, 'tan{', f, 'frac{', f, 'pi}{4}}')
    when 17 then concat(f, 'frac{', b, '!}{(', b, '-1)!}')
    when 18 then concat(f, 'cos{0}+', a)
    else concat('-(-', a, ')') end as pred
from (select concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-',
          cast(l_suppkey as varchar(20)), '-', cast(l_partkey as varchar(20))) as resp_id,
        cast(l_quantity as int) as a, cast(l_linenumber as int) + 1 as b, cast(l_partkey % 2 as int) as off, l_partkey % 2 = 0 as same,
        chr(92) as f, cast((l_orderkey + l_linenumber) % 20 as int) as form
      from {lineitem}) q
"""

# Expressions and relations with free variables in two written forms.
IDENTITIES = r"""
select resp_id, form, same,
  case form
    when 0 then concat('x+', a)
    when 1 then concat('(x+', a, ')^2')
    when 2 then concat('x<', a)
    when 3 then concat('x^2-', a * a)
    when 4 then concat(f, 'frac{x+y}{', b, '}')
    when 5 then concat(f, 'sin^2 x+', f, 'cos^2 x+', a)
    when 6 then concat(a, 'x+y=', b)
    when 7 then concat('x', f, 'geq ', a)
    when 8 then concat(f, 'frac{x^2-', a * a, '}{x-', a, '}')
    else concat('(a+b)^', b) end as ref_ans,
  case form
    when 0 then concat(a + off, '+x')
    when 1 then concat('x^2+', 2 * a, 'x+', a * a + off)
    when 2 then concat(a + off, '>x')
    when 3 then concat('(x-', a + off, ')(x+', a, ')')
    when 4 then concat('x/', b, '+y/', b + off)
    when 5 then concat(a + 1 + off, '')
    when 6 then concat(b + off, '-y=', a, 'x')
    when 7 then concat(a + off, f, 'leq x')
    when 8 then concat('x+', a + off)
    else concat('(b+a)^{', b - 1 + off, '}(a+b)') end as pred
from (select concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-',
          cast(l_suppkey as varchar(20)), '-', cast(l_partkey as varchar(20))) as resp_id,
        cast(l_quantity as int) as a, cast(l_linenumber as int) + 1 as b, cast(l_partkey % 2 as int) as off, l_partkey % 2 = 0 as same,
        chr(92) as f, cast((l_orderkey + l_linenumber) % 10 as int) as form
      from {lineitem}) q
"""

# Unions and intersections of intervals, and their normal form.
UNIONS = r"""
select resp_id, form, same,
  case form
    when 0 then concat('[', a, ',', a + 9 + off, ']')
    when 1 then concat('(', a, ',', a + 9 + off, ')')
    when 2 then concat('[', a, ',', a + 9 + off, ']')
    when 3 then concat('(', a, ',', a + 9, case off when 0 then ')' else ']' end)
    when 4 then concat('[', a + 3, ',', a + 5 + off, ']')
    when 5 then concat('(-', f, 'infty,', f, 'infty)')
    when 6 then concat('(', a, ',', a + 5, ')', f, 'cup(', a + 5, ',', a + 9 + off, ')')
    else concat('[', a, ',', a + 2, ')', f, 'cup(', a + 4 + off, ',', a + 9, ']') end as ref_ans,
  case form
    when 0 then concat('[', a, ',', a + 5, ']', f, 'cup[', a + 5, ',', a + 9, ']')
    when 1 then concat('(', a, ',', a + 9, ')', f, 'cup(', a + 1, ',', a + 2, ')')
    when 2 then concat('(', a + 3, ',', a + 9, ']', f, 'cup[', a, ',', a + 5, ')')
    when 3 then concat('(', a, ',', a + 5, ')', f, 'cup', f, '{', a + 5, f, '}', f, 'cup(', a + 5, ',', a + 9, ')')
    when 4 then concat('[', a, ',', a + 5, ']', f, 'cap[', a + 3, ',', a + 9, ']')
    when 5 then concat('(-', f, 'infty,', a, ']', f, 'cup[', a - 1 + 2 * off, ',', f, 'infty)')
    when 6 then concat('(', a + 5, ',', a + 9, ')', f, 'cup(', a, ',', a + 5, ')')
    else concat('(', a + 4, ',', a + 9, ']', f, 'cup[', a, ',', a + 1, ']', f, 'cup[', a + 1, ',', a + 2, ')') end as pred
from (select concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-',
          cast(l_suppkey as varchar(20)), '-', cast(l_partkey as varchar(20))) as resp_id,
        cast(l_quantity as int) as a, cast(l_partkey % 2 as int) as off, l_partkey % 2 = 0 as same,
        chr(92) as f, cast((l_orderkey + l_linenumber) % 8 as int) as form
      from {lineitem}) q
"""

VIEWS = {
    "resp": RESP, "trials": TRIALS, "qa": QA, "forms": FORMS, "composed": COMPOSED, "identities": IDENTITIES, "unions": UNIONS,
}

CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def derived(spark: SparkSession, sf: str, text: str, wide: str = "") -> DataFrame:
    """Rows of a SQL text over ``{table}`` names; rows of the table ``wide`` are spread before its texts are made."""
    for t in TABLES:
        if "{" + t + "}" in text:
            rows = table(spark, sf, t)
            (spread(rows) if t == wide else rows).createOrReplaceTempView(f"_{t}")
            text = text.replace("{" + t + "}", f"_{t}")
    return spark.sql(text)


def view(spark: SparkSession, sf: str, name: str, wide: str = "") -> DataFrame:
    """A derived view as a DataFrame."""
    return derived(spark, sf, VIEWS[name], wide)


def expand(sql: str) -> str:
    """Check SQL with its derived views written out."""
    for name, text in VIEWS.items():
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
        sql = sql.replace("{" + name + "}", f"({text})")
    return sql


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that checks it."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if fn.__name__ in CATALOG:
            raise ValueError(f"{fn.__name__} is registered twice")
        CATALOG[fn.__name__] = (fn, None if sql is None else expand(sql))
        return fn

    return register

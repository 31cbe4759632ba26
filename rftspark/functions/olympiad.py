r"""Olympiad comparison: lists of answers, each within a tolerance of its reference.

The reference side is raw text (often several ``\boxed{}`` or ``$…$`` parts), the other
side an extracted answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import fixed
from . import sqltext as F
from .sqltext import Sql, let, quoted
from .text import replace_each, strip, until_closing_brace
from .values import closed_form_value, float_value

CJK = r"[\u4e00-\u9fff]+"


def _boxed_parts(c: Sql) -> Sql:
    r"""Contents of all ``\boxed{}``, joined; NULL when one never closes."""

    def contents(pieces: Sql) -> Sql:
        found = F.transform(
            F.sequence(F.lit(2), F.size(pieces)),
            lambda i: until_closing_brace(
                F.array_join(F.slice(pieces, i, F.size(pieces)), "\\boxed{"), escapes=False
            ),
        )
        return let(
            found,
            lambda fs: F.when(
                F.forall(fs, lambda f: f["closed"]),
                F.array_join(F.transform(fs, lambda f: f["content"]), ","),
            ),
        )

    return let(F.split(c, r"\\boxed\{", -1), contents)


def _last_line_formulas(c: Sql) -> Sql:
    line = F.substring_index(strip(c), "\n", -1)
    return let(
        F.regexp_extract_all(line, r"\$(.*?)\$", 1),
        lambda fs: F.when(F.size(fs) > 0, F.array_join(fs, ",")).otherwise(c),
    )


def prepare(c: Sql) -> Sql:
    """Comparison text of one side; NULL when its braces do not match."""
    found = F.when(F.contains(c, "\\boxed{"), _boxed_parts(c)).otherwise(_last_line_formulas(c))
    member = let(
        found,
        lambda s: F.when(F.contains(s, "\\in "), F.split(s, r"\\in ", -1)[1]).otherwise(s),
    )
    plain = replace_each(member, fixed.OLYMPIAD_REPLACED)
    edges = F.btrim(plain, fixed.OLYMPIAD_EDGE_CHARS)
    return F.regexp_replace(edges, r"\\(?:mathrm|mathbf)\{~?([^}]*)\}", "$1")


def split_items(c: Sql) -> Sql:
    r"""Items between commas outside ``()`` and ``[]``; ``\pm`` gives two items."""
    pieces = F.split(c, r"(?<=[(\[)\],])", -1)
    start = F.struct(
        F.lit(0).alias("depth"), F.lit("").alias("open"), Sql("array()").cast("array<string>").alias("items")
    )

    def step(acc: Sql, piece: Sql) -> Sql:
        text = F.concat(acc["open"], piece)
        ends = F.endswith(piece, ",") & (acc["depth"] == 0)
        turn = F.when(piece.rlike(r"[(\[]$"), 1).when(piece.rlike(r"[)\]]$"), -1).otherwise(0)
        return F.struct(
            (acc["depth"] + turn).alias("depth"),
            F.when(ends, "").otherwise(text).alias("open"),
            F.when(
                ends,
                F.concat(acc["items"], F.array(strip(F.substring(text, F.lit(1), F.length(text) - 1)))),
            ).otherwise(acc["items"]).alias("items"),
        )

    items = let(
        F.aggregate(pieces, start, step),
        lambda a: F.when(a["open"] == "", a["items"]).otherwise(
            F.concat(a["items"], F.array(strip(a["open"])))
        ),
    )
    signs = F.transform(
        items,
        lambda e: F.when(
            F.contains(e, "\\pm"),
            F.array(F.replace(e, "\\pm", "+"), F.replace(e, "\\pm", "-")),
        ).otherwise(F.array(e)),
    )
    return F.flatten(signs)


def latex_value(c: Sql) -> Sql:
    """Value of the right side of an item; NULL when it has no closed form."""
    right = F.coalesce(F.try_element_at(F.split(c, "=", -1), 2), c)
    plain = F.regexp_replace(F.regexp_replace(right, r"\s+", ""), r"\\[dt]frac", r"\\frac")
    plain = replace_each(plain, (("\\cdot", "*"), ("\\times", "*")))
    return let(plain, lambda s: F.coalesce(float_value(s), closed_form_value(s)))


def item(c: Sql) -> Sql:
    """STRUCT of everything the comparison of one item needs."""
    interval = c.rlike(r"^[(\[].*[)\]]$")
    ends = F.transform(
        F.split(c, r"\\cup", -1),
        lambda p: F.struct(
            F.concat(F.substring(p, 1, 1), F.substring(p, -1, 1)).alias("ends"),
            F.transform(
                F.split(F.btrim(p, "[]()"), ",", -1),
                lambda e: F.struct(strip(e).alias("norm"), latex_value(e).alias("value")),
            ).alias("parts"),
        ),
    )
    return F.struct(
        c.alias("text"),
        float_value(c).alias("number"),
        latex_value(c).alias("value"),
        F.when(interval, ends).alias("interval"),
    )


def _within(a: Sql, b: Sql, tol: Sql) -> Sql:
    return F.coalesce(F.abs(a - b) <= tol * F.lit(1.01), F.lit(False))


def same_item(ref: Sql, pred: Sql, tol: Sql) -> Sql:
    """Equal text, equal intervals part by part in order, or numbers within the tolerance."""

    def ends_match(x: Sql, y: Sql) -> Sql:
        n = F.least(F.size(x["parts"]), F.size(y["parts"]))
        pairs = F.arrays_zip(F.slice(x["parts"], 1, n), F.slice(y["parts"], 1, n))
        return (x["ends"] == y["ends"]) & F.forall(
            pairs,
            lambda p: (Sql(f"{p.text}['0'].norm") == Sql(f"{p.text}['1'].norm"))
            | _within(Sql(f"{p.text}['0'].value"), Sql(f"{p.text}['1'].value"), tol),
        )

    intervals = (F.size(ref["interval"]) == F.size(pred["interval"])) & F.forall(
        F.zip_with(ref["interval"], pred["interval"], ends_match), lambda ok: F.coalesce(ok, F.lit(False))
    )
    r, p = ref["number"], pred["number"]
    numbers = _within(r, p, tol) | _within(r / 100, p, tol) | _within(r * 100, p, tol)
    both_equations = F.contains(ref["text"], "=") & F.contains(pred["text"], "=")
    return (
        ((ref["text"] == pred["text"]) & (ref["text"] != F.lit("")))
        | F.coalesce(intervals, F.lit(False))
        | numbers
        | (_within(ref["value"], pred["value"], tol) & ~both_equations)
    )


def _matched(refs: Sql, preds: Sql, tols: Sql) -> Sql:
    """Every reference item takes one still free predicted item."""

    def take(acc: Sql, i: Sql) -> Sql:
        ref = F.element_at(refs, i)
        hit = F.array_position(
            F.transform(acc["rest"], lambda p: same_item(ref, p, F.element_at(tols, i))), True
        )
        return let(
            hit,
            lambda j: F.struct(
                (acc["ok"] & (j > 0)).alias("ok"),
                F.filter(acc["rest"], lambda p, k: (k + 1) != j).alias("rest"),
            ),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.size(refs)),
        F.struct(F.lit(True).alias("ok"), preds.alias("rest")),
        take,
        lambda acc: acc["ok"],
    )


def add_olympiad_verdict(df: DataFrame, ref: str, pred: str, tolerance: str, target: str) -> DataFrame:
    """Add a BOOLEAN; ``tolerance`` is an ARRAY<DOUBLE>: one value for all items, or one each."""
    sides = F.col("_sides")
    items = F.col("_items")
    tols = F.when(
        F.size(F.col(tolerance)) <= 1,
        F.array_repeat(F.coalesce(F.try_element_at(F.col(tolerance), 1), F.lit(1e-8)), F.size(items[0])),
    ).otherwise(F.col(tolerance))
    df = df.withColumn("_sides", F.transform(F.array(F.col(ref), F.col(pred)), prepare).column())
    split = F.transform(sides, lambda s: F.transform(split_items(F.regexp_replace(s, CJK, "")), item))
    df = df.withColumn("_items", F.when(sides[0] != sides[1], split).column())
    df = df.withColumn("_limits", tols.column())
    verdict = (
        F.when(F.isnull(F.col(ref)), None)
        .when(sides[0] == sides[1], True)
        .when(
            (F.size(items[0]) == F.size(items[1])) & (F.size(F.col("_limits")) == F.size(items[0])),
            F.when(F.size(items[0]) == 0, True).otherwise(_matched(items[0], items[1], F.col("_limits"))),
        )
        .otherwise(False)
    )
    return df.withColumn(target, verdict.column()).drop("_sides", "_items", "_limits")

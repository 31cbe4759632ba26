"""Equality tiers for one pair of reference and predicted answer."""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from . import sqltext as F
from .expressions import expression, same_expression
from .normalize import ARRAY_START, distinct_elements, unwrap_all
from .sqltext import Sql, let
from .text import without_ends
from .values import LOOKS_LIKE_DATE, closed_form_value, date_time, float_value, numeric_value, thousands_value


@dataclass(frozen=True)
class Tolerance:
    """Limits of numeric equality."""

    rel: float = 1e-9
    abs: float = 1e-8
    percent_rel: float = 1e-3
    percentages: bool = True
    ascii_only: bool = True


DEFAULT = Tolerance()


def close(a: Sql, b: Sql, rel: float, absolute: float) -> Sql:
    limit = F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    # Digits without end read as infinity, which is near no number.
    return F.abs(a - b) <= F.least(limit, F.lit(sys.float_info.max))


def could_be_percent(v: Sql) -> Sql:
    return ((v > 0) & (v < 1)) | ((v > 1) & (v < 100))


def percent_equal(ref: Sql, pred: Sql, tol: Tolerance = DEFAULT) -> Sql:
    """Equal up to a factor of 100, for values that could be percentages."""
    forms = [
        could_be_percent(x) & close(x, pred, tol.percent_rel, tol.abs) for x in (ref / 100, ref * 100)
    ]
    return F.lit(tol.percentages) & could_be_percent(pred) & (forms[0] | forms[1])


def number_equal(ref: Sql, pred: Sql, tol: Tolerance = DEFAULT) -> Sql:
    return F.coalesce(close(ref, pred, tol.rel, tol.abs) | percent_equal(ref, pred, tol), F.lit(False))


def same_element(ref: Sql, pred: Sql, tol: Tolerance = DEFAULT) -> Sql:
    """Equality of two STRUCT<norm, value> elements."""
    return (F.lower(ref["norm"]) == F.lower(pred["norm"])) | number_equal(ref["value"], pred["value"], tol)


def set_equal(ref: Sql, pred: Sql, tol: Tolerance = DEFAULT) -> Sql:
    """Two arrays of one size whose elements match one to one.

    Every predicted element takes the first reference element that is like it and still free.
    """

    def take(free: Sql, p: Sql) -> Sql:
        likes = F.transform(free, lambda r: F.coalesce(same_element(r, p, tol), F.lit(False)))
        return let(
            F.array_position(likes, F.lit(True)),
            # Without a like nothing is taken, so something is left over at the end.
            lambda at: F.when(at == 0, free).otherwise(F.filter(free, lambda _, i: i != at - 1)),
        )

    return (F.size(ref) == F.size(pred)) & (F.size(F.aggregate(pred, ref, take)) == 0)


def _cell(c: Sql) -> Sql:
    return F.struct(c.alias("norm"), numeric_value(c).alias("value"))


def table_text(c: Sql) -> Sql:
    """ARRAY<ARRAY<STRING>> of a matrix or a comma list; NULL for other text."""
    body = F.regexp_extract(c, r"\\begin\{array\}(?:\{\})?(.*)\\end\{array\}", 1)
    rows = F.transform(F.split(body, r"\\+(?!frac|sqrt)", -1), lambda r: F.split(r, "&", -1))
    return F.when(_has_array(c), rows).when(
        F.contains(c, ","), F.array(F.split(unwrap_all(c), ",", -1))
    )


def _has_array(c: Sql) -> Sql:
    return F.contains(c, ARRAY_START)


def table_cells(text: Sql) -> Sql:
    """ARRAY<ARRAY<STRUCT<norm, value>>>; a single column counts as a single row."""
    rows = F.when(F.forall(text, lambda r: F.size(r) == 1), F.array(F.flatten(text))).otherwise(text)
    return F.transform(rows, lambda r: F.transform(r, _cell))


def table_equal(ref: Sql, pred: Sql, tol: Tolerance = DEFAULT) -> Sql:
    """Same shape and equal cells."""
    cells = F.zip_with(
        ref,
        pred,
        lambda x, y: (F.size(x) == F.size(y))
        & F.forall(F.zip_with(x, y, lambda p, q: same_element(p, q, tol)), lambda ok: ok),
    )
    return (F.size(ref) == F.size(pred)) & F.forall(cells, lambda ok: F.coalesce(ok, F.lit(False)))


def intervals_of(c: Sql) -> Sql:
    r"""ARRAY<ARRAY<part>> of intervals and single points joined by ``\cup`` and, binding tighter, ``\cap``.

    A part is STRUCT<kind, low, high>. NULL when a part has no such form or its ends are out of order.
    """

    def part(p: Sql) -> Sql:
        opening = F.regexp_extract(p, r"^\\?([(\[])[^,]+,[^,]+[)\]]$", 1)
        ends = F.split(F.regexp_extract(p, r"^\\?[(\[]([^,]+,[^,]+?)\\?[)\]]$", 1), ",", -1)
        point = F.regexp_extract(p, r"^\\?\{([^,]+?)\\?\}$", 1)
        shape = F.when(
            opening != "",
            F.struct(
                F.concat(opening, F.substring(p, F.length(p), F.lit(1))).alias("kind"),
                ends[0].alias("low"),
                F.try_element_at(ends, F.lit(2)).alias("high"),
            ),
        ).when(point != "", F.struct(F.lit("{}").alias("kind"), point.alias("low"), point.alias("high")))
        return let(
            shape,
            lambda i: let(
                F.transform(F.array(i["low"], i["high"]), _cell),
                lambda ends: F.when(
                    F.isnotnull(i),
                    F.struct(i["kind"].alias("kind"), _end(ends[0]).alias("low"), _end(ends[1]).alias("high")),
                ),
            ),
        )

    def in_order(i: Sql) -> Sql:
        return (i["kind"] == "{}") | F.coalesce(i["low"]["value"] < i["high"]["value"], F.lit(True))

    unions = F.transform(
        F.split(F.replace(c, F.lit(" "), F.lit("")), r"\\cup", -1),
        lambda u: F.transform(F.split(u, r"\\cap", -1), part),
    )
    fine = lambda ps: F.forall(ps, lambda p: p.isNotNull() & in_order(p))
    return let(unions, lambda us: F.when(F.forall(us, fine), us))


def _end(cell: Sql) -> Sql:
    """An end of an interval; infinity has a value too."""
    text = cell["norm"]
    infinite = F.lit("Infinity").cast("double")
    value = F.when(text.isin("\\infty", "+\\infty"), infinite).when(text == "-\\infty", -1.0 * infinite).otherwise(cell["value"])
    return F.struct(text.alias("norm"), value.alias("value"))


def _spans(parts: Sql) -> Sql:
    """ARRAY<STRUCT<low, open_low, high, open_high>> of parts whose ends all have values; NULL otherwise.

    The intersections are taken, empty ones left out, and the rest is sorted by its low ends, closed before open.
    """

    def span(p: Sql) -> Sql:
        return F.struct(
            p["low"]["value"].alias("low"), F.startswith(p["kind"], "(").alias("open_low"),
            p["high"]["value"].alias("high"), F.endswith(p["kind"], F.lit(")")).alias("open_high"),
        )

    def meet(a: Sql, b: Sql) -> Sql:
        return F.struct(
            F.greatest(a["low"], b["low"]).alias("low"),
            ((a["open_low"] & (a["low"] >= b["low"])) | (b["open_low"] & (b["low"] >= a["low"]))).alias("open_low"),
            F.least(a["high"], b["high"]).alias("high"),
            ((a["open_high"] & (a["high"] <= b["high"])) | (b["open_high"] & (b["high"] <= a["high"]))).alias("open_high"),
        )

    def met(ps: Sql) -> Sql:
        return let(F.transform(ps, span), lambda ss: F.aggregate(F.slice(ss, F.lit(2), F.size(ss)), F.element_at(ss, 1), meet))

    valued = F.forall(parts, lambda ps: F.forall(ps, lambda p: p["low"]["value"].isNotNull() & p["high"]["value"].isNotNull()))
    some = F.filter(
        F.transform(parts, met),
        lambda s: (s["low"] < s["high"]) | ((s["low"] == s["high"]) & ~s["open_low"] & ~s["open_high"]),
    )
    return F.when(valued, F.array_sort(some))


def union_form(parts: Sql, tol: Tolerance = DEFAULT) -> Sql:
    """Normal form of a union: disjoint spans from left to right, touching and overlapping ones merged."""

    def sweep(done: Sql, s: Sql) -> Sql:
        last = F.element_at(done, -1)
        touch = close(last["high"], s["low"], tol.rel, tol.abs)
        joined = F.struct(
            last["low"].alias("low"), last["open_low"].alias("open_low"), F.greatest(last["high"], s["high"]).alias("high"),
            F.when(last["high"] == s["high"], last["open_high"] & s["open_high"])
            .when(last["high"] > s["high"], last["open_high"]).otherwise(s["open_high"]).alias("open_high"),
        )
        reach = F.when(touch, ~last["open_high"] | ~s["open_low"]).otherwise(s["low"] < last["high"])
        return F.when(F.size(done) == 0, F.array(s)).when(
            reach, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))
        ).otherwise(F.concat(done, F.array(s)))

    return let(_spans(parts), lambda ss: F.when(ss.isNotNull(), F.aggregate(ss, F.slice(ss, F.lit(1), F.lit(0)), sweep)))


def interval_equal(ref: Sql, pred: Sql, tol: Tolerance = DEFAULT) -> Sql:
    """Equal unions: by their normal form where all ends have values, else the same parts in any order."""

    def same(a: Sql, b: Sql) -> Sql:
        return (
            (a["kind"] == b["kind"])
            & same_element(a["low"], b["low"], tol)
            & same_element(a["high"], b["high"], tol)
        )

    def same_parts(x: Sql, y: Sql) -> Sql:
        return (
            (F.size(x) == F.size(y))
            & F.forall(x, lambda a: F.exists(y, lambda b: same(a, b)))
            & F.forall(y, lambda b: F.exists(x, lambda a: same(a, b)))
        )

    def near(a: Sql, b: Sql) -> Sql:
        return (a == b) | number_equal(a, b, tol)

    def same_spans(x: Sql, y: Sql) -> Sql:
        pairs = F.zip_with(
            x, y,
            lambda a, b: near(a["low"], b["low"]) & near(a["high"], b["high"])
            & (a["open_low"] == b["open_low"]) & (a["open_high"] == b["open_high"]),
        )
        return (F.size(x) == F.size(y)) & F.forall(pairs, lambda ok: F.coalesce(ok, F.lit(False)))

    def same_forms(forms: Sql) -> Sql:
        by_parts = (
            (F.size(ref) == F.size(pred))
            & F.forall(ref, lambda x: F.exists(pred, lambda y: same_parts(x, y)))
            & F.forall(pred, lambda y: F.exists(ref, lambda x: same_parts(x, y)))
        )
        known = forms[0].isNotNull() & forms[1].isNotNull()
        return F.when(known, same_spans(forms[0], forms[1])).otherwise(by_parts)

    both = F.transform(F.array(ref, pred), lambda parts: union_form(parts, tol))
    return F.when(ref.isNotNull() & pred.isNotNull(), let(both, same_forms))


def any_value(c: Sql) -> Sql:
    """Number of an answer; ``1,234`` may be a number or a pair, so its number counts too."""
    return F.coalesce(float_value(c), thousands_value(c), closed_form_value(c))


def _verdict(correct: Sql | bool, tier: str) -> Sql:
    value = correct if isinstance(correct, Sql) else F.lit(correct)
    return F.struct(value.alias("correct"), F.lit(tier).alias("match_tier"))


def _cheap_tiers(
    ref: Sql, ref_norm: Sql, ref_num: Sql, pred: Sql, pred_norm: Sql, wants_set: Sql, tol: Tolerance
) -> Sql:
    """Dates, rejected answers, equal texts and plain numbers; NULL leaves it open."""
    # Both must look like dates before either is parsed.
    dates = (
        pred.rlike(LOOKS_LIKE_DATE)
        & ref.rlike(LOOKS_LIKE_DATE)
        & (F.size(F.array_distinct(F.transform(F.array(ref, pred), date_time))) == 1)
        & F.isnotnull(date_time(pred))
    )
    blocked = pred_norm == ""
    if tol.ascii_only:
        blocked = blocked | pred_norm.rlike(r"[^\x00-\x7F]")
    p, r = float_value(pred_norm), F.coalesce(ref_num, float_value(ref_norm))
    return (
        F.when(ref.isNull(), F.lit(None).cast("struct<correct:boolean,match_tier:string>"))
        .when(pred.isNull(), _verdict(False, "rejected"))
        .when(dates, _verdict(True, "datetime"))
        .when(blocked, _verdict(False, "rejected"))
        .when(F.lower(pred_norm) == F.lower(ref_norm), _verdict(True, "literal"))
        .when(wants_set, F.lit(None))
        .when(close(r, p, tol.rel, tol.abs), _verdict(True, "numeric"))
        .when(percent_equal(r, p, tol), _verdict(True, "percent"))
        # Two unequal plain numbers cannot become equal further down.
        .when(p.isNotNull() & float_value(ref_norm).isNotNull() & ref_num.isNull(), _verdict(False, "numeric"))
    )


def add_verdict(
    df: DataFrame, ref: str, ref_norm: str, ref_num: str, pred: str, pred_norm: str, set_mode: Sql,
    tol: Tolerance = DEFAULT,
) -> DataFrame:
    """Add ``correct`` and ``match_tier``: the first tier that decides, cheap ones first.

    ``match_tier`` is ``none`` where no tier could decide; such a pair counts as wrong.
    Every later tier runs only on the rows the earlier ones left open.
    """
    a, b = F.col(ref_norm), F.col(pred_norm)
    before = df.columns
    both = F.array(a, b)
    sets, values, intervals, tables, written = (
        F.col(n) for n in ("_sets", "_values", "_intervals", "_tables", "_written")
    )

    def parsed(condition: Sql, expression) -> Column:
        """Both sides parsed by one copy of the expression, where ``condition`` holds."""
        return F.when(condition, F.transform(both, expression)).column()

    def known(pair: Sql) -> Sql:
        return F.isnotnull(pair[0]) & F.isnotnull(pair[1])

    # Few projections: each one is analysed as a whole.
    wants_set = F.coalesce(set_mode, F.lit(False))
    df = df.withColumns(
        {
            "_set_mode": wants_set.column(),
            "_v": _cheap_tiers(F.col(ref), a, F.col(ref_num), F.col(pred), b, wants_set, tol).column(),
        }
    )
    undecided = F.isnull(F.col("_v")) & F.isnotnull(F.col(ref))
    df = df.withColumns(
        {
            "_sets": parsed(undecided & F.col("_set_mode"), distinct_elements),
            "_values": parsed(undecided & ~F.col("_set_mode"), any_value),
        }
    )
    same_value = number_equal(values[0], values[1], tol)
    still_open = undecided & ~F.col("_set_mode") & ~same_value
    df = df.withColumns(
        {
            "_intervals": parsed(still_open, intervals_of),
            "_tables": parsed(still_open, lambda c: let(table_text(c), table_cells)),
            "_written": parsed(still_open & ~known(values), expression),
        }
    )
    verdict = (
        F.when(~undecided, F.col("_v"))
        .when(F.col("_set_mode"), _verdict(set_equal(sets[0], sets[1], tol), "set"))
        .when(same_value, _verdict(True, "closed_form"))
        .when(interval_equal(intervals[0], intervals[1], tol), _verdict(True, "interval"))
        .when(table_equal(tables[0], tables[1], tol), _verdict(True, "elementwise"))
        .when(
            known(written),
            _verdict(
                same_expression(
                    written[0], written[1], lambda x, y: number_equal(x, y, tol), lambda x, y: close(x, y, tol.rel, tol.abs)
                ),
                "expression",
            ),
        )
        .when(known(values), _verdict(False, "closed_form"))
        .when(known(intervals), _verdict(False, "interval"))
        .when(known(tables), _verdict(False, "elementwise"))
        .otherwise(_verdict(False, "none"))
    )
    return df.select(*before, verdict.column().alias("_v")).select(*before, "_v.correct", "_v.match_tier")

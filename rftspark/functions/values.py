"""Numbers, closed-form values, dates and times written in answers."""

from __future__ import annotations

from collections.abc import Callable


from . import sqltext as F
from .sqltext import Sql, let

LOOKS_LIKE_DATE = r"^\d{1,4}[-/:]\d"
FLOAT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

_POWER = r"(?:\^(?:\{-?\d+(?:\.\d+)?\}|\d))?"
_NUMBER = r"(?:\d+(?:\.\d+)?|\\pi)" + _POWER
_FLAT = r"\{[^{}]*\}"
# Possessive: a repeated group that may give back text recurses once per repeat in the JVM.
_NESTED = r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"
_DEEP = rf"\{{[^{{}}]*+(?:{_NESTED}[^{{}}]*+)*+\}}"
_ROOT = r"\\sqrt(?:\[\d+\])?" + _NESTED + _POWER
_RATIO = r"\\frac" + _DEEP + _DEEP + _POWER


def float_value(c: Sql) -> Sql:
    """DOUBLE of plain or scientific notation, else NULL."""
    return F.when(c.rlike(FLOAT), F.trim(c).try_cast("double"))


def _sum_of_products(c: Sql, atom: str, value: Callable[[Sql], Sql]) -> Sql:
    """Evaluate ``a*b+c…`` whose factors all match ``atom``; NULL for anything else."""
    tokens = F.regexp_extract_all(c, F.lit(f"{atom}|[-+*/]"), F.lit(0))
    # factor: product of the term so far, NULL until its first factor.
    start = F.struct(
        F.lit(0.0).alias("total"),
        F.lit(1.0).alias("sign"),
        F.lit(None).cast("double").alias("factor"),
        F.lit(False).alias("divide"),
    )

    def step(acc: Sql, t: Sql) -> Sql:
        closes = t.isin("+", "-")
        return (
            F.when(
                closes,
                F.struct(
                    (acc["total"] + acc["sign"] * F.coalesce(acc["factor"], F.lit(0.0))).alias("total"),
                    # A sign in front of a term's first factor joins the sign before it.
                    (
                        F.when(t == "-", -1.0).otherwise(1.0)
                        * F.when(acc["factor"].isNull(), acc["sign"]).otherwise(1.0)
                    ).alias("sign"),
                    F.lit(None).cast("double").alias("factor"),
                    F.lit(False).alias("divide"),
                ),
            )
            .when(
                t.isin("*", "/"),
                F.struct(acc["total"], acc["sign"], acc["factor"], (t == "/").alias("divide")),
            )
            .otherwise(
                let(
                    value(t),
                    lambda v: F.struct(
                        acc["total"],
                        acc["sign"],
                        (
                            F.coalesce(acc["factor"], F.lit(1.0))
                            * F.when(acc["divide"], 1.0 / F.nullif(v, F.lit(0.0))).otherwise(v)
                        ).alias("factor"),
                        F.lit(False).alias("divide"),
                    ),
                )
            )
        )

    def evaluate(ts: Sql) -> Sql:
        whole = (F.size(ts) > 0) & (F.array_join(ts, "") == c) & ~c.rlike(r"[-+*/]$|^[*/]|[-+*/][*/]|\d\.\d+\.")
        return F.when(
            whole,
            let(F.aggregate(ts, start, step), lambda a: a["total"] + a["sign"] * a["factor"]),
        )

    return let(tokens, evaluate)


def _powered(t: Sql, base: Sql) -> Sql:
    # Where nothing is found there is nothing to cast: a failed cast costs an exception.
    exponent = F.when(F.contains(t, "^"), F.regexp_extract(t, r"\^\{?(-?[\d.]+)\}?$", 1).try_cast("double"))
    return F.pow(base, F.coalesce(exponent, F.lit(1.0)))


def _number(t: Sql) -> Sql:
    base = F.coalesce(F.when(t.rlike(r"^[\d.]"), F.regexp_extract(t, r"^[\d.]+", 0).try_cast("double")), F.pi())
    return _powered(t, base)


def _with_roots(t: Sql) -> Sql:
    inner = F.regexp_extract(t, r"\\sqrt(?:\[\d+\])?\{(.*?)\}(?:\^\{?-?[\d.]+\}?)?$", 1)
    numbered = F.when(F.contains(t, "\\sqrt["), F.regexp_extract(t, r"\\sqrt\[(\d+)\]", 1).try_cast("double"))
    degree = F.coalesce(numbered, F.lit(2.0))
    # Roots of negative numbers and zeroth roots have no real value.
    root = let(
        _sum_of_products(inner, _NUMBER, _number),
        lambda v: F.pow(F.when(v >= 0, v), 1.0 / F.nullif(degree, F.lit(0.0))),
    )
    return F.when(F.startswith(t, "\\sqrt"), _powered(t, root)).otherwise(_number(t))


def _with_ratios(t: Sql) -> Sql:
    sides = F.transform(
        F.array(
            F.regexp_extract(t, rf"^\\frac({_DEEP})", 1),
            F.regexp_extract(t, rf"^\\frac{_DEEP}({_DEEP})", 1),
        ),
        lambda side: let(
            F.substring(side, F.lit(2), F.length(side) - 2),
            lambda s: _sum_of_products(s, f"{_ROOT}|{_NUMBER}", _with_roots),
        ),
    )
    return F.when(
        F.startswith(t, F.lit("\\frac")),
        # A power behind the ratio would bind to its last brace only.
        let(sides, lambda p: F.when((p[1] != 0) & ~t.rlike(r"\}\^"), p[0] / p[1])),
    ).otherwise(_with_roots(t))


def closed_form_value(c: Sql) -> Sql:
    r"""DOUBLE of numbers, ``\pi``, roots, powers, ratios, their products and sums; else NULL."""
    # (x) without a sign inside is a factor of its own.
    flat = F.regexp_replace(c, r"\(([^()+\-,]*)\)", r"*$1*")
    flat = F.regexp_replace(F.regexp_replace(flat, r"^\*+|\*+$", ""), r"([-+])\*+", "$1")
    flat = F.regexp_replace(F.regexp_replace(flat, r"\*+([-+])", "$1"), r"\*{2,}", "*")
    return F.when(
        # A mixed number is a sum, see ``expressions``.
        c.rlike(r"[\d\\]") & ~c.rlike(r"[,=<>&]|\\(?:infty|cup|cap|begin)|\d\\frac\{\d+\}\{\d+\}(?!\^)"),
        let(flat, lambda s: _sum_of_products(s, f"{_RATIO}|{_ROOT}|{_NUMBER}", _with_ratios)),
    )


def thousands_value(c: Sql) -> Sql:
    """DOUBLE of ``1,234,567``; NULL for text without such groups."""
    return F.when(
        c.rlike(r"^[+-]?\d{1,3}(?:,\d{3})++(\.\d+)?$"), F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    )


def numeric_value(c: Sql) -> Sql:
    """Plain number, else closed form."""
    return F.coalesce(float_value(c), closed_form_value(c))


def date_time(c: Sql) -> Sql:
    """Uniform text of a date, a time or both; NULL for anything else.

    Formats: year first with ``-`` or ``/``; day/month/year before month/day/year; times
    with or without seconds; 12-hour clock only for a time alone.
    """

    def uniform_date(d: Sql) -> Sql:
        day = F.coalesce(
            *[F.try_to_date(d, form) for form in ("yyyy-M-d", "yyyy/M/d", "d/M/yyyy", "M/d/yyyy")]
        )
        return F.date_format(day, "yyyy-MM-dd")

    def uniform_time(t: Sql, half: Sql) -> Sql:
        def clock(u: Sql) -> Sql:
            hour = F.when(half == "", F.when(u[0] < 24, u[0])).when(
                (u[0] >= 1) & (u[0] <= 12), u[0] % 12 + F.when(half == "PM", 12).otherwise(0)
            )
            return F.when(
                (u[1] < 60) & (u[2] < 60), F.format_string("%02d:%02d:%02d", hour, u[1], u[2])
            )

        units = F.transform(F.split(F.concat(t, ":0"), ":", -1), lambda x: x.try_cast("int"))
        return let(units, lambda u: F.when(F.isnotnull(u[0]), clock(u)))

    def parts(s: Sql) -> Sql:
        return F.struct(
            F.regexp_extract(s, r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}/\d{1,2}/\d{4})(?:$|\s)", 1).alias("d"),
            F.regexp_extract(s, r"(?:^|\s)(\d{1,2}:\d{1,2}(?::\d{1,2})?)(?:\s+[aApP][mM])?$", 1).alias("t"),
            F.upper(F.regexp_extract(s, r"\s([aApP][mM])$", 1)).alias("half"),
        )

    def joined(s: Sql, p: Sql) -> Sql:
        only_date, only_time = p["t"] == "", p["d"] == ""
        return F.when(
            only_date, F.when(s == p["d"], uniform_date(p["d"]))
        ).when(
            only_time, F.when(F.startswith(s, p["t"]), uniform_time(p["t"], p["half"]))
        ).when(
            p["half"] == "", F.concat(uniform_date(p["d"]), " ", uniform_time(p["t"], p["half"]))
        )

    return F.when(
        c.rlike(LOOKS_LIKE_DATE), let(parts(c), lambda p: F.when((p["d"] != "") | (p["t"] != ""), joined(c, p)))
    )

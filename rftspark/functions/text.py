"""Small text expressions shared by the extraction, normalisation and prompt jobs."""

from __future__ import annotations

from collections.abc import Iterable

from . import sqltext as F
from .sqltext import Sql, let, quoted


# What Python's str.strip() removes; Spark's trim() alone removes only blanks.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Sql) -> Sql:
    return F.btrim(c, WHITESPACE)


def lstrip(c: Sql, extra: str = "") -> Sql:
    return Sql(f"trim(LEADING {quoted(WHITESPACE + extra)} FROM {c.text})")


def rstrip(c: Sql, extra: str = "") -> Sql:
    return Sql(f"trim(TRAILING {quoted(WHITESPACE + extra)} FROM {c.text})")


def after_last(c: Sql, mark: str) -> Sql:
    """Text behind the last ``mark``; the whole text without one."""
    return F.substring_index(c, mark, -1)


def replace_each(c: Sql, pairs: Iterable[tuple[str, str]]) -> Sql:
    """Literal replacements, applied one after the other."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def without_ends(c: Sql, front: int, back: int) -> Sql:
    """Drop ``front`` leading and ``back`` trailing characters."""
    return F.substring(c, F.lit(front + 1), F.length(c) - (front + back))


def until_closing_brace(c: Sql, escapes: bool) -> Sql:
    """Follow brace depth in text that starts just behind an opening brace.

    Returns STRUCT<content, closed>: the text before the matching brace, or all of it
    with ``closed`` false. With ``escapes`` a brace behind a backslash does not count.
    The text is cut behind every counting brace, so the fold has one step per brace.
    """
    brace = r"(?<!\\)[{}]" if escapes else "[{}]"
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("end"))

    def step(acc: Sql, piece: Sql) -> Sql:
        turn = (
            F.when(~piece.rlike(f"{brace}$"), F.lit(0))
            .when(F.endswith(piece, F.lit("{")), F.lit(1))
            .otherwise(F.lit(-1))
        )
        return F.when(acc["depth"] == 0, acc).otherwise(
            F.struct(
                (acc["depth"] + turn).alias("depth"),
                (acc["end"] + F.length(piece)).alias("end"),
            )
        )

    folded = F.aggregate(F.split(c, f"(?<={brace})", -1), start, step)
    return let(
        folded,
        lambda f: F.struct(
            F.when(f["depth"] == 0, F.substring(c, F.lit(1), f["end"] - 1)).otherwise(c).alias("content"),
            (f["depth"] == 0).alias("closed"),
        ),
    )


def middle_cut(c: Sql, head: int, tail: int, mark: str = "...") -> Sql:
    """Keep ``head`` leading and ``tail`` trailing characters of longer text."""
    total = head + tail
    if total <= 0:
        return c
    # A tail of 0 keeps the whole text behind the mark, as a slice from -0 does.
    end = F.substring(c, F.lit(-tail), F.lit(tail)) if tail > 0 else c
    return F.when(
        F.length(c) > total, F.concat(F.substring(c, 1, head), F.lit(mark), end)
    ).otherwise(c)

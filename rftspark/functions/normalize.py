"""Bring an answer into its normal form with one native column expression.

The stages run in a fixed order because each one sees the output of the one before.
Plain integers skip them all: no stage changes one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from . import fixed
from . import sqltext as F
from .extract import LETTER, NO_LETTER, beyond, clean, truth_word
from .sqltext import Sql, let
from .text import replace_each, strip, without_ends

PLAIN_INTEGER = r"^-?[1-9][0-9]{0,17}$"
ARRAY_START = "\\begin{array}"
#: A character that the literal replacements could concern, and one that a function, zero or unit could.
REPLACEABLE = beyond(r"0123456789()[]{}+-*/=<>|!&@#_^ ")
LETTER_OR_POINT = beyond(NO_LETTER.replace(".", ""))
#: Last character of a text with a unit; the end of a pattern may stand before a line end.
UNIT_END = beyond("".join(ch for ch in NO_LETTER if ch not in ".\r\n"))
#: A style command or an environment; every one begins with a backslash.
STYLED = r"\\(?:" + "|".join(
    re.escape(x[1:]) for x in (*fixed.STYLE_COMMANDS, *(f"\\{edge}{{{env}}}" for env in fixed.ENVIRONMENTS for edge in ("begin", "end")))
) + ")"

_FN = fixed.FUNCTION_NAMES
_FIRST = "".join(sorted({name[0] for name in _FN.split("|")}))


def _has(c: Sql, text: str) -> Sql:
    return F.contains(c, F.lit(text))


def _sub(c: Sql, pattern: str, replacement: str) -> Sql:
    return F.regexp_replace(c, pattern, replacement)


_PLAIN_OPEN, _ESCAPED_OPEN = r"[(\[{]", r"\\[(\[{]"
_PLAIN_CLOSE, _ESCAPED_CLOSE = r"^[)\]}]++", r"^(?:[)\]}]\\)++"
_OPENERS = "([{"


def unwrap_run(c: Sql) -> Sql:
    """Remove the layers that enclose the whole text and open with one run of parentheses, all plain or all escaped.

    One pass over the text, however many layers there are and however their kinds alternate. The
    opening run and the closing run, read inwards, agree on some layers. Each kind is
    counted by itself: a layer's partner is its mirror image unless the text between the
    runs closes its kind so often that it was closed before, or closes it a different
    number of times than it opens it. The first layer that fails ends the enclosing ones.
    """
    escaped = F.startswith(c, "\\")
    width = F.when(escaped, 2).otherwise(1)
    left = F.replace(F.regexp_extract(c, rf"^(?:(?:{_ESCAPED_OPEN})++|{_PLAIN_OPEN}++)", 0), F.lit("\\"), F.lit(""))
    closing = F.regexp_extract(F.reverse(c), F.when(escaped, _ESCAPED_CLOSE).otherwise(_PLAIN_CLOSE), 0)
    right = F.translate(F.replace(closing, F.lit("\\"), F.lit("")), ")]}", _OPENERS)

    def agreed(x: Sql) -> Sql:
        """Layers on which both runs agree, from the outside."""
        shorter = F.least(F.length(x["left"]), F.length(x["right"]))
        first = F.array_position(
            F.zip_with(F.split(x["left"], "", -1), F.split(x["right"], "", -1), lambda a, b: F.coalesce(a == b, F.lit(True))), F.lit(False)
        )
        same = F.startswith(x["left"], x["right"]) | F.startswith(x["right"], x["left"])
        return F.when(same, shorter).otherwise(F.least(shorter, (first - 1).cast("int")))

    def enclosing(layers: Sql, m: Sql) -> Sql:
        """How many of the ``m`` agreed layers enclose the text."""
        middle = F.substring(c, m * width + 1, F.length(c) - 2 * m * width)
        # Plain ones also count behind a backslash.
        marks = F.regexp_extract_all(middle, F.when(escaped, r"\\[()\[\]{}]").otherwise(r"[()\[\]{}]"), 0)
        marks = F.transform(marks, lambda t: F.substring(t, F.length(t), F.lit(1)))
        pairs = [(o, k) for o, k in zip(_OPENERS, ")]}", strict=True)]
        start = F.struct(*[F.lit(0).alias(f"{w}{i}") for i in range(len(pairs)) for w in ("now", "low")])

        def count(d: Sql, t: Sql) -> Sql:
            now = [d[f"now{i}"] + F.when(t == o, 1).when(t == k, -1).otherwise(0) for i, (o, k) in enumerate(pairs)]
            return F.struct(*[x for i, n in enumerate(now) for x in (n.alias(f"now{i}"), F.least(n, d[f"low{i}"]).alias(f"low{i}"))])

        def first_failure(d: Sql) -> Sql:
            ends = []
            for i, (o, _) in enumerate(pairs):
                n = F.length(layers) - F.length(F.replace(layers, F.lit(o), F.lit("")))
                fine = F.when(d[f"now{i}"] == 0, F.greatest(n + d[f"low{i}"], F.lit(0))).otherwise(0)
                # The text before the first such layer that is not fine; all of it if every one is.
                ends.append(F.length(F.substring_index(layers, o, fine + 1)))
            return F.least(*ends)

        return let(F.aggregate(marks, start, count), first_failure)

    def cut(k: Sql) -> Sql:
        return F.substring(c, k * width + 1, F.length(c) - 2 * k * width)

    def unwrapped(x: Sql) -> Sql:
        return let(
            agreed(x),
            lambda m: F.when(m == 0, c).otherwise(let(enclosing(F.substring(x["left"], F.lit(1), m), m), cut)),
        )

    return F.when(c.rlike(r"^\\?[(\[{]"), let(F.struct(left.alias("left"), right.alias("right")), unwrapped)).otherwise(c)


def unwrap_all(c: Sql) -> Sql:
    """Remove enclosing parentheses until none is left."""
    return let(
        c,
        lambda s: let(
            # Every round removes what it can of one run of plain or escaped leading parentheses.
            F.size(F.regexp_extract_all(F.regexp_extract(s, r"^(?:\\?[(\[{])++", 0), rf"(?:{_ESCAPED_OPEN})++|{_PLAIN_OPEN}++", 0)),
            lambda n: F.when(n == 0, s).otherwise(
                F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), s, lambda acc, _: unwrap_run(acc))
            ),
        ),
    )


def weekday(c: Sql) -> Sql:
    """Full weekday name for a single word that starts like one."""

    def named(word: Sql) -> Sql:
        chain = F.when(_has(word, " "), None)
        for day in fixed.WEEKDAYS:
            chain = chain.when(F.startswith(word, day[:3].lower()), day)
        return chain

    return F.when(c.rlike(LETTER), let(strip(F.lower(c)), named))


def _drop_style(c: Sql, command: Sql) -> Sql:
    """Unwrap the first ``\\cmd{x}`` or ``{\\cmd x}``; a bare command just goes."""
    at = F.instr(c, command)

    def join(before: Sql, after: Sql) -> Sql:
        braced = let(
            _first_group(after), lambda m: F.when(m.isNotNull(), m).otherwise(after)
        )
        return (
            F.when(F.startswith(after, F.lit("{")), F.concat(before, braced))
            .when(
                F.endswith(before, F.lit("{")) & _has(after, "}"),
                F.concat(
                    without_ends(before, 0, 1),
                    F.substring_index(after, "}", 1),
                    F.substring(after, F.instr(after, F.lit("}")) + 1, F.length(after)),
                ),
            )
            .otherwise(F.concat(before, after))
        )

    return F.when(at == 0, c).otherwise(
        let(
            strip(F.substring(c, F.lit(1), at - 1)),
            lambda before: let(
                strip(F.substring(c, at + F.length(command), F.length(c))),
                lambda after: join(before, after),
            ),
        )
    )


def _first_group(c: Sql) -> Sql:
    """Text with its leading brace pair removed; NULL when the pair never closes."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"))
    folded = F.aggregate(
        F.split(c, "(?<=[{}])", -1),
        start,
        lambda acc, piece: F.when((acc["at"] > 0) & (acc["depth"] == 0), acc).otherwise(
            F.struct(
                (
                    acc["depth"]
                    + F.when(F.endswith(piece, F.lit("{")), 1).when(F.endswith(piece, F.lit("}")), -1).otherwise(0)
                ).alias("depth"),
                (acc["at"] + F.length(piece)).alias("at"),
            )
        ),
    )
    return let(
        folded,
        lambda f: F.when(
            f["depth"] == 0,
            F.concat(
                F.substring(c, F.lit(2), f["at"] - 2),
                F.substring(c, f["at"] + 1, F.length(c)),
            ),
        ),
    )


def drop_styles(c: Sql) -> Sql:
    commands = F.array(*[F.lit(x) for x in fixed.STYLE_COMMANDS])
    environments = [(f"\\{edge}{{{env}}}", "") for env in fixed.ENVIRONMENTS for edge in ("begin", "end")]
    return F.when(c.rlike(STYLED), replace_each(F.aggregate(commands, c, _drop_style), environments)).otherwise(c)


def degrees(c: Sql) -> Sql:
    def named(s: Sql) -> Sql:
        return _sub(_sub(s, r"^(\d+) ?\^?\\?circ$", "$1"), r"(?<!\d)(\d++) ?\^?\\?circ", r"{$1*\\frac{\\pi}{180}}")

    return let(F.replace(c, F.lit("rad"), F.lit("")), lambda s: F.when(_has(s, "circ"), named(s)).otherwise(s))


def function_powers(c: Sql) -> Sql:
    r"""``sin`` → ``\sin^{1}``, ``\sin^2`` → ``\sin^{2}``."""
    c = _sub(c, rf"(?=\\?[{_FIRST}])\\?({_FN})\^(\d+)", r"\\$1^{$2}")
    return _sub(c, rf"(?=\\?[{_FIRST}])\\?({_FN})(?!\^)", r"\\$1^{1}")


def drop_units(c: Sql) -> Sql:
    def dropped(s: Sql) -> Sql:
        for unit in ("|".join(fixed.UNITS), r"a\.?m\.?", r"p\.?m\.?"):
            s = _sub(s, rf"(?<![-\d.*^{{}}])([-\d.*^{{}}]++)(?:{unit})e?s?$", "$1")
        return s

    return let(c, lambda s: F.when(F.substring(s, F.lit(-1), F.lit(1)).rlike(UNIT_END), dropped(s)).otherwise(s))


def replace_literals(c: Sql) -> Sql:
    def replaced(s: Sql) -> Sql:
        return replace_each(replace_each(s, [(x, "") for x in fixed.REMOVED]), fixed.REPLACED)

    return let(c, lambda s: F.when(s.rlike(REPLACEABLE), replaced(s)).otherwise(s))


def _infinity_and_spaces(c: Sql) -> Sql:
    named = F.when(_has(c, "\\infty"), c).otherwise(F.replace(c, F.lit("inf"), F.lit("\\infty")))
    return F.replace(named, F.lit(" "), F.lit(""))


def _functions_and_arrays(c: Sql) -> Sql:
    s = _sub(degrees(c), rf"(?<!\\)(?=[{_FIRST}p])(pi\b|{_FN})", r"\\$1")
    s = _sub(function_powers(s), r"\{[a-z]?matrix\}", "{array}")
    s = _sub(s, r"\\begin\{array\}\{[lcr]*\}", r"\\begin{array}{}")
    return F.when(c.rlike(LETTER), s).otherwise(c)


def _row_breaks(c: Sql) -> Sql:
    return F.when(_has(c, ARRAY_START), c).otherwise(F.replace(c, F.lit("\\\\"), F.lit("")))


def _imaginary_unit(c: Sql) -> Sql:
    return F.when(_has(c, "j") & ~_has(c, "i"), F.replace(c, F.lit("j"), F.lit("i"))).otherwise(c)


def _zeros_and_units(c: Sql) -> Sql:
    s = drop_units(_sub(_sub(c, r"(?<=\d)\.0+([^\d])", "$1"), r"(?<=\d)\.0+$", ""))
    return F.when(c.rlike(LETTER_OR_POINT), s).otherwise(c)


def _leading_point(c: Sql) -> Sql:
    return F.when(F.startswith(c, F.lit(".")), F.concat(F.lit("0"), c)).otherwise(c)


def is_set(c: Sql) -> Sql:
    return (
        (_has(c, "or") & c.rlike(r"[^a-z]or(x|[^a-z])"))
        | (F.startswith(c, F.lit("{")) & F.endswith(c, F.lit("}")))
        | (F.startswith(c, F.lit("\\{")) & F.endswith(c, F.lit("\\}")))
    )


def fix_sqrt(c: Sql) -> Sql:
    s = _sub(c, r"\\?sqrt[({\[](\w+)[)}\]]", r"\\sqrt{$1}")
    return F.when(_has(c, "sqrt"), _sub(s, r"\\?sqrt\s*(\d+)", r"\\sqrt{$1}")).otherwise(c)


def fix_fracs(c: Sql) -> Sql:
    r"""Give ``\frac12`` and ``\frac1{72}`` their braces; too short a rest leaves all as is."""

    def braced(p: Sql) -> Sql:
        first, second = F.substring(p, 1, 1), F.substring(p, 2, 1)
        rest = F.substring(p, F.lit(3), F.length(p))
        return F.when(F.startswith(p, F.lit("{")), p).otherwise(
            F.concat(
                F.lit("{"), first, F.lit("}"),
                F.when(second == "{", F.lit("{")).otherwise(F.concat(F.lit("{"), second, F.lit("}"))),
                rest,
            )
        )

    def fix(s: Sql, parts: Sql) -> Sql:
        tail = F.slice(parts, F.lit(2), F.size(parts))
        short = F.exists(tail, lambda p: ~F.startswith(p, F.lit("{")) & (F.length(p) < 2))
        return F.when(short, s).otherwise(
            F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(tail, braced)), "\\frac")
        )

    return F.when(_has(c, "\\frac"), let(F.split(c, r"\\frac", -1), lambda parts: fix(c, parts))).otherwise(c)


def fix_slashes(c: Sql) -> Sql:
    return F.when(_has(c, "/"), _sub(c, r"(\b\d+|sqrt\(.*?\))/(\d+|sqrt\(.*?\)\b)", r"\\frac{$1}{$2}")).otherwise(c)


def plus_minus(c: Sql) -> Sql:
    r"""``a\pm b`` → ``a-b,a+b``."""
    pattern = r"([\w.\\{}+\-*^]+?)(?:\\pm|\\mp)([\w.\\{}+\-*^]+)"
    return F.when(
        c.rlike(pattern), _sub(unwrap_all(c), pattern, r"$1-$2,$1+$2")
    ).otherwise(c)


def _equalities(c: Sql) -> Sql:
    variable = (
        rf"^([a-z]|[A-Z]{{2}}|\\?({fixed.VARIABLE_NAMES}))"
        r"\^?\{?-?(?:'|\\prime|\d)*+\}?(\(-?([\d.]+|[a-z])?\))?$"
    )

    def two_sided(s: Sql, parts: Sql) -> Sql:
        left = strip(parts[0])
        drop = left.rlike(variable) | ~left.rlike("[a-zA-Z]")
        return F.when(F.size(parts) > 2, F.element_at(parts, -1)).when(
            (F.size(parts) == 2) & drop, F.element_at(parts, -1)
        ).otherwise(s)

    return F.when(_has(c, ARRAY_START) | ~_has(c, "="), c).otherwise(
        let(F.split(c, "=", -1), lambda parts: two_sided(c, parts))
    )


ELEMENT_STAGES = (
    fix_sqrt,
    lambda s: F.when(F.startswith(s, "frac"), F.concat("\\", s)).otherwise(s),
    fix_fracs,
    lambda s: _sub(fix_slashes(s), r"^[a-z]\\in", ""),
    lambda s: F.when(_has(s, ","), s).otherwise(unwrap_all(s)),
    _equalities,
    lambda s: F.when(_has(s, "\\pm") | _has(s, "\\mp"), plus_minus(s)).otherwise(s),
)


def normal_element(c: Sql) -> Sql:
    """Stages applied to each element of an answer."""
    return _sub(F.chain(c, ELEMENT_STAGES), "^0+([1-9])", "$1")


def raw_elements(c: Sql) -> Sql:
    """Split a list-like answer at commas and ``or``."""
    return F.transform(
        F.split(F.replace(unwrap_all(c), F.lit("or"), F.lit(",")), ",", -1), strip
    )


def distinct_elements(c: Sql) -> Sql:
    """ARRAY<STRUCT<raw, norm, value>> of a list-like answer: equal ones merged, sorted."""
    from .equality import same_element
    from .values import numeric_value

    filled = F.transform(
        raw_elements(c),
        lambda e: let(
            normal_element(e),
            lambda n: F.struct(e.alias("raw"), n.alias("norm"), numeric_value(n).alias("value")),
        ),
    )
    return let(
        filled,
        lambda xs: F.array_sort(
            F.filter(
                xs,
                lambda x, i: ~F.exists(F.slice(xs, F.lit(1), i), lambda y: same_element(x, y)),
            )
        ),
    )


def _elements(c: Sql) -> Sql:
    listed = F.array_join(F.transform(distinct_elements(c), lambda e: e["norm"]), ",")
    return F.when(c == "", c).when(is_set(c), listed).otherwise(normal_element(c))


def _single(c: Sql) -> Sql:
    return F.when(_has(c, ","), c).otherwise(unwrap_all(c))


def _number_word(c: Sql) -> Sql:
    words = F.create_map(
        *[F.lit(x) for i, word in enumerate(fixed.NUMBER_WORDS, 1) for x in (word, str(i))]
    )
    return F.coalesce(F.try_element_at(words, c), c)


def _bars(c: Sql) -> Sql:
    return clean(_sub(c, r"\\mid([a-z])", r"\\mid $1"))


def _chains_to_lists(c: Sql) -> Sql:
    """Several equal inequality signs without a list become commas."""
    listed = F.lower(c).rlike(",|and|or")

    def many(sign: str) -> Sql:
        return (F.regexp_count(c, F.lit(sign)) > 1) & ~listed

    return F.when(many("<"), F.replace(c, F.lit("<"), F.lit(","))).when(
        many(">"), F.replace(c, F.lit(">"), F.lit(","))
    ).otherwise(c)


MATH_STAGES = (
    lambda c: replace_literals(clean(strip(c))),
    _infinity_and_spaces,
    drop_styles,
    _functions_and_arrays,
    _row_breaks,
    _imaginary_unit,
    _zeros_and_units,
    _leading_point,
    _elements,
    _single,
    _number_word,
    _bars,
    _chains_to_lists,
)


def normal_math(c: Sql) -> Sql:
    """Normal form of a mathematical answer."""
    return F.chain(c, MATH_STAGES)


def normal_answer(c: Sql) -> Sql:
    """Normal form of any answer: truth word, weekday or mathematical text."""
    cleaned = clean(strip(F.replace(c, "\n", "")))
    return F.when(c.rlike(PLAIN_INTEGER), c).otherwise(
        let(cleaned, lambda s: F.coalesce(truth_word(s), weekday(s), normal_math(s)))
    )


def normalize(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add normal forms: ``columns`` maps source to target column.

    All columns run through one copy of the expression.
    """
    texts = F.array(*[F.col(c) for c in columns])
    kept = [c for c in df.columns if c not in columns.values()]
    found = [F.col("_normal")[i].column().alias(target) for i, target in enumerate(columns.values())]
    return df.select("*", F.transform(texts, normal_answer).column().alias("_normal")).select(*kept, *found)

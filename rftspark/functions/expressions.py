"""Values of written expressions, and identity of expressions with free variables.

One fold over the tokens keeps the open bracket's registers: the sum so far, the sign of
its term, the product of its factors, the atoms that stand side by side, and the last of
them, which a power or factorial may still take. Opening a bracket puts the registers
on a stack and closing one hands its value to the registers below, so that every token costs
the same and the whole is linear in the length of the answer.

Letters are free variables. Two expressions are the same when they agree at seeded points,
some of them negative; a polynomial that vanishes at random points vanishes everywhere but
for a chance that is negligible.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from . import sqltext as F
from .sqltext import Sql, let

#: Seed and number of the points at which identities are tried.
SEED, POINTS = 20, 4
GREEK = ("alpha", "beta", "gamma", "delta", "theta", "lambda", "mu", "omega", "phi", "rho", "sigma", "tau", "varphi", "varepsilon")
UNARY = {
    "\\sin": "sin", "\\cos": "cos", "\\tan": "tan", "\\cot": "cot", "\\sec": "sec", "\\csc": "csc", "\\arcsin": "asin",
    "\\arccos": "acos", "\\arctan": "atan", "\\exp": "exp", "\\ln": "ln", "\\lg": "log10",
}
INVERSE = {"\\sin": "asin", "\\cos": "acos", "\\tan": "atan"}
COMMANDS = (*UNARY, "\\log", "\\sqrt", "\\frac", "\\binom")
OPENING = {"(": ")", "[": "]", "{": "}", "\\lfloor": "\\rfloor", "\\lceil": "\\rceil"}

_TOKEN = r"\\[A-Za-z]+|\d+\.?\d*|\.\d+|[A-Za-z]|[-+*/^_!(){}\[\]]"
_FLAT = r"\{[^{}]*+\}"
_NESTED = rf"\{{[^{{}}]*+(?:{_FLAT}[^{{}}]*+)*+\}}"
_DEEP = rf"\{{[^{{}}]*+(?:{_NESTED}[^{{}}]*+)*+\}}"
_BLOCK = rf"\\(?:frac|binom){_DEEP}{_DEEP}|\\sqrt(?:\[[^\[\]]*+\])?{_DEEP}"
_HEAD = r"\\(?:arc)?(?:sin|cos|tan|cot|sec|csc|log|ln|lg|exp)" + rf"(?:[_^]{_FLAT})*+"
_ATOMS = r"(?:\d+\.?\d*|\\(?:pi|" + "|".join(GREEK) + r")|(?<![A-Za-z])[a-z](?![a-z]{3}))++"
_RELATION = r"^([^<>=]+?)(<|>|=|\\leq(?:slant)?|\\le(?!ft)|\\geq?(?:slant)?)([^<>=]+)$"
MIXED = r"(?<![\d.^_A-Za-z)}\]])(\d++)(\\frac\{\d++\}\{\d++\})(?!\^)"


def _letter(t: Sql, point: Sql) -> Sql:
    """Value of a letter at a point, from 0.4 to 2.4; negative at the third, of either sign at the fourth."""
    share = F.pmod(F.xxhash64(t, point, F.lit(SEED)), F.lit(1_000_003)) / 1_000_003.0
    minus = (point == 2) | ((point == 3) & (F.pmod(F.xxhash64(F.lit(SEED), point, t), F.lit(2)) == 0))
    return (0.4 + 2.0 * share) * F.when(minus, -1.0).otherwise(1.0)


def _value(t: Sql, point: Sql) -> Sql:
    """Value of a token at a point; NULL for signs, brackets, commands and the imaginary unit."""
    return (
        F.when(t.rlike(r"^[\d.]"), t.try_cast("double")).when(t == "\\pi", F.pi()).when(t == "e", F.e())
        .when(t.rlike(r"^(?:[A-Za-hj-z]|\\(?:" + "|".join(GREEK) + "))$"), _letter(t, point))
    )


#: Registers of a bracket, with their values where it opens.
FRESH = {
    "total": 0.0, "sign": 1.0, "product": 1.0, "divide": False, "run": 1.0, "last": None, "call": "", "held": None,
    "power": None, "mode": "", "close": "",
}
NAN = F.lit("NaN").cast("double")
KINDS = {"last": "double", "held": "double", "power": "double"}


def _frame(values: dict[str, object]) -> Sql:
    return F.struct(*[
        (Sql(f"CAST({F.as_text(v)} AS {KINDS[n]})") if v is None else v if isinstance(v, Sql) else F.lit(v)).alias(n)
        for n, v in values.items()
    ])


def _with(f: Sql, **changed: object) -> Sql:
    return _frame({n: changed[n] if n in changed else f[n] for n in FRESH})


def _factor(f: Sql) -> Sql:
    """Product of the term with the atoms that stand side by side."""
    atoms = f["run"] * f["last"]
    return F.when(f["divide"], f["product"] / F.nullif(atoms, F.lit(0.0))).otherwise(f["product"] * atoms)


def _whole(v: Sql) -> Sql:
    return (v >= 0) & (v <= 170) & (v == F.floor(v))


def _ratio_of_factorials(n: Sql, k: Sql) -> Sql:
    """n! / (n - k)! / k! for whole numbers; 170 is the largest factorial that a double holds."""
    steps = F.sequence(F.lit(1), F.greatest(k, F.lit(1.0)).cast("int"))
    return F.when(
        _whole(n) & _whole(k) & (k <= n),
        F.when(k == 0, 1.0).otherwise(F.aggregate(steps, F.lit(1.0), lambda a, i: a * (n - k + i) / i)),
    )


def _factorial(v: Sql) -> Sql:
    steps = F.sequence(F.lit(1), F.greatest(v, F.lit(1.0)).cast("int"))
    return F.when(_whole(v), F.aggregate(steps, F.lit(1.0), lambda a, i: a * i))


def _called(f: Sql, v: Sql) -> Sql:
    """Value of a command for its last argument."""
    inverse = f["power"] == -1.0
    out = F.when(f["call"] == "\\frac", f["held"] / F.nullif(v, F.lit(0.0)))
    out = out.when(f["call"] == "\\binom", _ratio_of_factorials(f["held"], v))
    out = out.when(f["call"] == "\\sqrt", F.pow(F.when(v >= 0, v), 1.0 / F.nullif(F.coalesce(f["held"], F.lit(2.0)), F.lit(0.0))))
    out = out.when(f["call"] == "\\log", F.ln(v) / F.nullif(F.ln(F.coalesce(f["held"], F.lit(math.e))), F.lit(0.0)))
    out = out.when(f["call"] == "\\lfloor", F.floor(v).cast("double")).when(f["call"] == "\\lceil", F.ceil(v).cast("double"))
    for name, function in INVERSE.items():
        out = out.when((f["call"] == name) & F.coalesce(inverse, F.lit(False)), Sql(f"{function}({v.text})"))
    for name, function in UNARY.items():
        out = out.when(f["call"] == name, Sql(f"{function}({v.text})"))
    power = F.when(f["power"].isNull() | (inverse & f["call"].isin(*INVERSE)), 1.0).otherwise(f["power"])
    return F.when(power == 1.0, out).otherwise(F.pow(out, power))


def _atom(f: Sql, v: Sql) -> Sql:
    """Registers after a value that is complete; what has no value is NaN from here on."""
    known = F.coalesce(v, NAN)
    run = F.when(f["last"].isNull(), f["run"]).otherwise(f["run"] * f["last"])
    return _with(f, run=run, last=known, call="", held=None, power=None)


def _given(f: Sql, v: Sql) -> Sql:
    """Registers after a value: an exponent, a base, an argument or an atom of its own."""
    first = f["call"].isin("\\frac", "\\binom") & f["held"].isNull()
    return (
        F.when(f["mode"] == "^", _with(f, last=F.pow(f["last"], v), mode=""))
        .when(f["mode"] == "call^", _with(f, power=v, mode=""))
        .when((f["mode"] == "_") | first, _with(f, held=v, mode=""))
        .otherwise(_atom(f, F.when(f["call"] == "", v).otherwise(_called(f, v))))
    )


def _step(acc: Sql, t: Sql) -> Sql:
    """One token ``t`` (text, value)."""
    f, s, text = acc["f"], acc["s"], t["text"]

    def state(frame: Sql, stack: Sql = s, bad: Sql | bool = False) -> Sql:
        return F.struct(frame.alias("f"), stack.alias("s"), (bad if isinstance(bad, Sql) else F.lit(bad)).alias("bad"))

    stop = state(f, bad=True)
    # Nothing waits for a value: no command, no exponent.
    idle = (f["call"] == "") & (f["mode"] == "")
    sign = F.when(text == "-", -1.0).otherwise(1.0)
    ready = idle & f["last"].isNotNull()
    index = (text == "[") & (f["call"] == "\\sqrt") & f["held"].isNull()
    opened = F.when(index, _with(f, mode="_")).when(F.startswith(text, "\\"), _with(f, call=text)).otherwise(f)
    closes = F.create_map(*[F.lit(x) for pair in OPENING.items() for x in pair])
    closing = (text == f["close"]) & ready & (F.size(s) > 0)
    inner = F.coalesce(f["total"] + f["sign"] * _factor(f), NAN)
    # A value comes as a token, or from the bracket that closes.
    come = F.struct(
        F.when(closing, F.element_at(s, -1)).otherwise(f).alias("f"), F.when(closing, inner).otherwise(t["value"]).alias("v"),
        F.when(closing, F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s).alias("s"),
    )
    return (
        F.when(acc["bad"], acc)
        .when(t["value"].isNotNull() | closing, let(come, lambda x: state(_given(x["f"], x["v"]), x["s"])))
        .when(
            text.isin("+", "-"),
            F.when(f["last"].isNull(), state(_with(f, sign=f["sign"] * sign), bad=~idle)).otherwise(
                state(
                    _with(f, total=f["total"] + f["sign"] * _factor(f), sign=sign, product=1.0, divide=False, run=1.0, last=None),
                    bad=~idle,
                )
            ),
        )
        .when(
            text.isin("*", "/"),
            F.when(ready, state(_with(f, product=_factor(f), divide=text == "/", run=1.0, last=None))).otherwise(stop),
        )
        .when(
            text == "^",
            F.when((f["call"] != "") & (f["mode"] == "") & f["power"].isNull(), state(_with(f, mode="call^")))
            .when(ready, state(_with(f, mode="^"))).otherwise(stop),
        )
        .when(text == "_", state(_with(f, mode="_"), bad=(f["call"] != "\\log") | (f["mode"] != "")))
        .when(text == "!", F.when(ready, state(_with(f, last=F.coalesce(_factorial(f["last"]), NAN)))).otherwise(stop))
        .when(text.isin(*COMMANDS), state(_with(f, call=text), bad=~idle))
        .when(
            text.isin(*OPENING),
            state(
                _frame({**FRESH, "close": F.try_element_at(closes, text)}), F.concat(s, F.array(opened)),
                bad=F.startswith(text, "\\") & ~idle,
            ),
        )
        .otherwise(stop)
    )


def _prepared(c: Sql) -> Sql:
    """Arguments and bases get the braces that writers leave out; a mixed number becomes a sum."""
    c = F.regexp_replace(c, r"\\?arc\\(sin|cos|tan)\^\{1\}", r"\\arc$1")
    c = F.regexp_replace(c, r"\\(pi|" + "|".join(GREEK) + r")(?=[A-Za-z])", r"{\\$1}")
    c = F.regexp_replace(F.regexp_replace(c, r"\\[dt]binom", r"\\binom"), r"\\div(?![a-z])", "/")
    c = F.regexp_replace(F.regexp_replace(c, MIXED, "($1+$2)"), r"_(\w)", r"_{$1}")
    c = F.regexp_replace(c, rf"({_HEAD})({_ATOMS})", "$1{$2}")
    return F.regexp_replace(c, rf"({_HEAD}|\^)({_BLOCK})", "$1{$2}")


def _values(c: Sql) -> Sql:
    """ARRAY<DOUBLE>: the value at every point, one if there is no letter; NULL for what is no expression."""
    free = r"(?<![A-Za-z\\])(?!e(?![A-Za-z]))[A-Za-z]|\\(?:" + "|".join(GREEK) + r")(?![a-z])"
    start = F.struct(
        _frame(FRESH).alias("f"), F.slice(F.array(_frame(FRESH)), F.lit(1), F.lit(0)).alias("s"), F.lit(False).alias("bad")
    )

    def folded(tokens: Sql, point: Sql) -> Sql:
        typed = F.transform(tokens, lambda t: F.struct(t.alias("text"), _value(t, point).alias("value")))

        def result(a: Sql) -> Sql:
            f = a["f"]
            fine = ~a["bad"] & (F.size(a["s"]) == 0) & (f["call"] == "") & (f["mode"] == "") & f["last"].isNotNull()
            value = f["total"] + f["sign"] * _factor(f)
            return F.when(fine, F.coalesce(value, NAN))

        return let(F.aggregate(typed, start, _step), result)

    def evaluated(text: Sql, tokens: Sql) -> Sql:
        chosen = F.sequence(F.lit(0), F.when(text.rlike(free), POINTS - 1).otherwise(0))
        return F.when(
            (F.size(tokens) > 0) & (F.array_join(tokens, "") == text),
            let(
                F.transform(chosen, lambda point: folded(tokens, point)),
                lambda vs: F.when(F.forall(vs, lambda v: v.isNotNull()), vs),
            ),
        )

    return let(_prepared(c), lambda p: let(F.regexp_extract_all(p, F.lit(_TOKEN), F.lit(0)), lambda ts: evaluated(p, ts)))


def expression(c: Sql) -> Sql:
    r"""STRUCT<kind, at>: values at all points of an expression, or of left minus right of a relation.

    ``kind`` is '' for an expression, '=', '<' or '\le' for a relation, the last two turned round
    where need be. NULL for what is neither, for words of four letters and more, and for texts
    with an i, the imaginary unit.
    """
    # One pattern for both, so that an expression is a relation to 0 without a sign.
    sides = F.array(
        F.coalesce(F.nullif(F.regexp_extract(c, _RELATION, 1), F.lit("")), c),
        F.coalesce(F.nullif(F.regexp_extract(c, _RELATION, 3), F.lit("")), F.lit("0")),
    )
    sign = F.substring(F.regexp_extract(c, _RELATION, 2), F.lit(1), F.lit(2))

    def difference(v: Sql) -> Sql:
        n = F.greatest(F.size(v[0]), F.size(v[1]))
        turned = F.when(sign.isin(">", "\\g"), -1.0).otherwise(1.0)
        longer = [F.when(F.size(x) == n, x).otherwise(F.array_repeat(F.element_at(x, 1), n)) for x in (v[0], v[1])]
        return F.when(v[0].isNotNull() & v[1].isNotNull(), F.zip_with(*longer, lambda a, b: turned * (a - b)))

    kind = F.when(sign.isin("<", ">"), F.lit("<")).when(sign.isin("\\l", "\\g"), F.lit("\\le")).otherwise(sign)
    readable = c.rlike(r"^[-+*/^_!(){}\[\]\\<>=.\w]+$") & ~c.rlike(r"(?<![A-Za-z\\])[A-Za-z]{4}|\\begin|\.\d*\.")
    return F.when(
        readable,
        let(let(F.transform(sides, _values), difference), lambda d: F.when(d.isNotNull(), F.struct(kind.alias("kind"), d.alias("at")))),
    )


def same_expression(a: Sql, b: Sql, equal: Callable[[Sql, Sql], Sql], near: Callable[[Sql, Sql], Sql]) -> Sql:
    """Whether two results of ``expression`` agree wherever they have a value, and have one somewhere.

    ``equal`` compares two constants, ``near`` the values at a point. An equation may be multiplied by -1.
    """

    def agree(turned: float) -> Sql:
        n = F.greatest(F.size(a["at"]), F.size(b["at"]))
        longer = [F.when(F.size(x) == n, x).otherwise(F.array_repeat(F.element_at(x, 1), n)) for x in (a["at"], b["at"])]
        pairs = F.zip_with(*longer, lambda x, y: F.struct(x.alias("x"), (y * turned).alias("y")))

        def alike(p: Sql) -> Sql:
            return F.when(F.isnan(p["x"]) | F.isnan(p["y"]), F.isnan(p["x"]) & F.isnan(p["y"])).when(
                (n == 1) & (a["kind"] == ""), equal(p["x"], p["y"])
            ).otherwise(near(p["x"], p["y"]))

        return let(pairs, lambda ps: F.forall(ps, alike) & F.exists(ps, lambda p: ~F.isnan(p["x"])))

    return (a["kind"] == b["kind"]) & (agree(1.0) | ((a["kind"] == "=") & agree(-1.0)))

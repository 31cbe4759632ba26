"""SQL expression text with Python operators.

The answer grammar is a few hundred built-in functions long. Building it call by call over
the JVM gateway takes seconds per query; building the SQL text takes none, and
``F.expr(text)`` parses it in one go. Any Spark SQL function can be called by its name:
``sqltext.concat(a, b)``; Python lambdas become SQL lambdas.
"""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_names = itertools.count()
_ESCAPES = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\t": "\\t", "\r": "\\r"}


def quoted(text: str) -> str:
    """A Spark SQL string literal."""
    parts = [
        _ESCAPES.get(ch) or (ch if ch.isprintable() else f"\\u{ord(ch):04x}") for ch in text
    ]
    return "'" + "".join(parts) + "'"


class Sql:
    """One SQL expression."""

    def __init__(self, text: str):
        self.text = text

    def column(self) -> Column:
        return F.expr(self.text)

    def alias(self, name: str) -> Sql:
        return Sql(f"{self.text} AS {name}")

    def __getitem__(self, key: str | int) -> Sql:
        return Sql(f"{self.text}[{key}]" if isinstance(key, int) else f"{self.text}.{key}")

    def cast(self, kind: str) -> Sql:
        return Sql(f"CAST({self.text} AS {kind})")

    def try_cast(self, kind: str) -> Sql:
        return Sql(f"TRY_CAST({self.text} AS {kind})")

    def rlike(self, pattern: str) -> Sql:
        return Sql(f"regexp_like({self.text}, {quoted(pattern)})")

    def isNull(self) -> Sql:
        return Sql(f"isnull({self.text})")

    def isNotNull(self) -> Sql:
        return Sql(f"isnotnull({self.text})")

    def isin(self, *values: str) -> Sql:
        return Sql(f"`in`({self.text}, {', '.join(quoted(v) for v in values)})")

    def _binary(self, sign: str, other: object, swap: bool = False) -> Sql:
        left, right = (as_text(other), self.text) if swap else (self.text, as_text(other))
        return Sql(f"`{sign.lower()}`({left}, {right})")

    def __eq__(self, other): return self._binary("=", other)  # type: ignore[override]
    def __ne__(self, other): return ~self._binary("=", other)  # type: ignore[override]
    def __lt__(self, other): return self._binary("<", other)
    def __le__(self, other): return self._binary("<=", other)
    def __gt__(self, other): return self._binary(">", other)
    def __ge__(self, other): return self._binary(">=", other)
    def __add__(self, other): return self._binary("+", other)
    def __radd__(self, other): return self._binary("+", other, swap=True)
    def __sub__(self, other): return self._binary("-", other)
    def __mul__(self, other): return self._binary("*", other)
    def __rmul__(self, other): return self._binary("*", other, swap=True)
    def __truediv__(self, other): return self._binary("/", other)
    def __rtruediv__(self, other): return self._binary("/", other, swap=True)
    def __mod__(self, other): return self._binary("%", other)
    def __and__(self, other): return self._binary("AND", other)
    def __or__(self, other): return self._binary("OR", other)
    def __invert__(self): return Sql(f"`not`({self.text})")
    __hash__ = None  # type: ignore[assignment]


class Case(Sql):
    """``CASE WHEN``; complete after ``otherwise`` or as it is (else NULL)."""

    def __init__(self, branches: tuple[str, ...]):
        self.branches = branches
        super().__init__(f"`when`({', '.join(branches)})")

    def when(self, condition: Sql, value: object) -> Case:
        return Case((*self.branches, f"{as_text(condition)}, {as_text(value)}"))

    def otherwise(self, value: object) -> Sql:
        return Case((*self.branches, as_text(value)))


def as_text(value: object) -> str:
    """Text of an expression, a Python literal or a lambda."""
    if isinstance(value, Sql):
        return value.text
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return quoted(value)
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    if callable(value):
        return _lambda(value)
    raise TypeError(f"no SQL text for {value!r}")


def _lambda(body: Callable[..., Sql]) -> str:
    names = [f"x{next(_names)}" for _ in inspect.signature(body).parameters]
    head = names[0] if len(names) == 1 else f"({', '.join(names)})"
    return f"{head} -> {as_text(body(*[Sql(n) for n in names]))}"


def lit(value: object) -> Sql:
    return Sql(as_text(value))


def col(name: str) -> Sql:
    return Sql(name)


def when(condition: Sql, value: object) -> Case:
    return Case((f"{as_text(condition)}, {as_text(value)}",))


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return Sql(f"transform(array({as_text(value)}), {_lambda(body)})[0]")


def chain(value: Sql, stages: Sequence[Callable[[Sql], Sql]]) -> Sql:
    """Apply stages one after the other; each may read its input many times.

    A fold over the stage number. Unlike nested lambdas its depth does not grow with the number
    of stages, which keeps analysis short.
    """
    last = len(stages) - 1

    def step(acc: Sql, i: Sql) -> Sql:
        branches = [part for n, f in enumerate(stages[:-1]) for part in (as_text(i == n), as_text(f(acc)))]
        return Case((*branches, as_text(stages[last](acc))))

    return Sql(f"aggregate(sequence(0, {last}), {as_text(value)}, {_lambda(step)})")


def __getattr__(name: str) -> Callable[..., Sql]:
    if name.startswith("_"):
        raise AttributeError(name)
    function = {"create_map": "map"}.get(name, name)
    return lambda *args: Sql(f"{function}({', '.join(as_text(a) for a in args)})")

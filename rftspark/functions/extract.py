"""Find the final answer inside a response, as one native column expression."""

from __future__ import annotations

import functools
import operator

from . import fixed
from . import sqltext as F
from .sqltext import Sql, let
from .text import after_last, lstrip, rstrip, strip, until_closing_brace, without_ends


def beyond(chars: str) -> str:
    """Pattern of one character that is none of these ASCII ones. Ranges in a class take the JVM some twenty times as long."""
    return "[^" + "".join(f"\\x{ord(ch):02x}" for ch in chars) + "]"


NO_LETTER = "".join(chr(i) for i in range(128) if not chr(i).isalpha())
#: A letter, or any character beyond ASCII. Stages on words leave a text without one alone.
LETTER = beyond(NO_LETTER)


def clean_trailing(c: Sql) -> Sql:
    """Strip, then drop meaningless characters and blanks from the end."""
    return rstrip(lstrip(c), fixed.TRAILING_CHARS)


def clean_leading(c: Sql) -> Sql:
    return lstrip(rstrip(c), fixed.LEADING_CHARS)


def clean(c: Sql) -> Sql:
    return clean_trailing(clean_leading(c))


def boxed_strict(c: Sql) -> Sql:
    r"""Content of the last ``\boxed{…}``; NULL when there is none or it never closes."""
    tail = F.when(F.contains(c, F.lit("\\boxed")), after_last(c, "\\boxed"))
    return let(
        tail,
        lambda t: F.when(
            F.startswith(t, F.lit("{")),
            let(
                until_closing_brace(F.substring(t, F.lit(2), F.length(t)), escapes=False),
                lambda m: F.when(m["closed"], m["content"]),
            ),
        ),
    )


def boxed_lenient(c: Sql) -> Sql:
    """Text behind the last ``oxed``: a braced group (or its rest), else up to a ``$``."""
    return let(
        after_last(c, "oxed"),
        lambda t: F.when(
            F.startswith(t, F.lit("{")),
            until_closing_brace(F.substring(t, F.lit(2), F.length(t)), escapes=True)["content"],
        ).otherwise(strip(F.substring_index(t, "$", 1))),
    )


def truth_word(c: Sql) -> Sql:
    """``True`` / ``False`` for text holding such a word, else NULL; commands that hold one do not count."""
    def word(s: Sql) -> Sql:
        has = lambda *words: functools.reduce(operator.or_, (F.contains(s, F.lit(w)) for w in words))
        return F.when(has("yes", "true"), F.lit("True")).when(has("no", "false"), F.lit("False"))

    def plain(s: Sql) -> Sql:
        commands = F.contains(s, F.lit("noindent")) | F.contains(s, F.lit("binom"))
        return F.when(commands, F.regexp_replace(s, r"noindent|\\[dt]?binom", "")).otherwise(s)

    return let(c, lambda s: F.when(s.rlike(LETTER), let(let(strip(F.lower(s)), plain), word)))


def _before_cue(c: Sql, cue: str) -> Sql:
    piece = strip(F.element_at(F.split(c, cue, -1), -2))
    return strip(F.regexp_extract(piece, r"(?:^|,|\.|!\|?)([^,.!]*)$", 1))


def explicit_answer(resp: Sql) -> Sql:
    """The answer a response announces; NULL when it announces none."""
    narrowed = clean_trailing(resp)
    for mark in fixed.NARROWING_MARKS:
        narrowed = strip(after_last(narrowed, mark))

    def unwrap(c: Sql) -> Sql:
        return let(
            c,
            lambda s: F.when(
                F.startswith(s, F.lit("$")) & F.endswith(s, F.lit("$")), without_ends(s, 1, 1)
            ).otherwise(s),
        )

    def announced(t: Sql) -> Sql:
        found = F.when(F.contains(t, F.lit("oxed{")), boxed_lenient(t))
        for cue in fixed.BEFORE_CUES:
            found = found.when(F.contains(t, F.lit(cue)), unwrap(_before_cue(t, cue)))
        for cue in fixed.AFTER_CUES:
            found = found.when(F.contains(t, F.lit(cue)), unwrap(strip(after_last(t, cue))))
        return found.when(
            F.contains(t, F.lit("statement")),
            F.coalesce(truth_word(after_last(t, "is ")), unwrap(t)),
        )

    return let(narrowed, announced)


def guessed_answer(resp: Sql) -> Sql:
    """The last formula, else the last number, else the empty string."""
    formula = F.regexp_extract_all(
        resp, F.lit(r"(?s)(?:\$|\\\(|\\\[)([^$]+)(?:\$|\\\(|\\\[)"), F.lit(1)
    )
    number = F.regexp_extract_all(
        F.replace(resp, F.lit(","), F.lit("")), F.lit(r"-?\d*\.?\d+"), F.lit(0)
    )
    return F.coalesce(
        F.try_element_at(formula, F.lit(-1)), F.try_element_at(number, F.lit(-1)), F.lit("")
    )


def raw_answer(resp: Sql, strict: bool = False) -> Sql:
    """The answer text before normalisation; never NULL."""
    fallback = F.lit("") if strict else guessed_answer(resp)
    return F.coalesce(explicit_answer(resp), fallback, F.lit(""))

"""Numeric expressions: guarded parsing, half-even rounding, right-closed bins."""

from __future__ import annotations

from collections.abc import Sequence

from tablewright.functions.sql import number, q, text

# What a plain number looks like (Spark's own cast also takes `1d`, `1f`).
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# White space as Unicode defines it.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# White space inside numbers, as part of a character class: kept short, it is tested per character.
NUMBER_BLANKS = r"\s\xa0\u2000-\u200a\u202f"
# Money signs and thousands separators removed before parsing.
MONEY_SIGNS = "$₹€£¥,"
# What a number with signs can begin with.
_NUMBER_STARTS = (
    "0123456789+-.%" + MONEY_SIGNS + " \t\n\x0b\x0c\r\u00a0"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f"
)
# Everything but digits, dot and minus.
NOT_NUMERIC_CHARS = r"[^\d.-]"


def as_double(name: str) -> str:
    return f"cast({q(name)} as double)"


def looks_numeric(x: str) -> str:
    return f"{x} rlike {text(NUMBER_PATTERN)}"


def _with_signs(signs: str) -> str:
    """The number pattern with any of the signs allowed between its characters.

    One match decides what would otherwise take a replacement per value; text that is
    no number fails at its first character. Possessive runs keep it linear.
    """
    s = f"[{signs}{NUMBER_BLANKS}]*+"
    digits = rf"(?:\d{s})++"
    return rf"^{s}(?:[+-]{s})?(?:{digits}(?:\.{s}(?:{digits})?)?|\.{s}{digits})(?:[eE]{s}(?:[+-]{s})?{digits})?$"


def looks_money_percent(x: str) -> str:
    """Does the text read as a number once money signs, percent signs and blanks are gone?

    Only text with a fitting first character is matched: most text columns hold none.
    """
    return f"(instr({text(_NUMBER_STARTS)}, left({x}, 1)) > 0 and {x} rlike {text(_with_signs(MONEY_SIGNS + '%'))})"


def parse_money_percent(x: str) -> str:
    """Double, or NULL when the text is no number after removing signs; strips only what matched."""
    stripped = f"translate({x}, {text(MONEY_SIGNS + '%' + WHITE_SPACE)}, '')"
    return f"case when {looks_money_percent(x)} then cast({stripped} as double) end"


def round2(x: str) -> str:
    """Two decimals of a column, half to even, on the scaled binary value."""
    return f"rint(({x}) * 100) / 100"


def round_scalar(x: str, digits: int) -> str:
    """Rounds the exact binary value, half to even, as figures in reports are rounded.

    `format_number` does that; `round` would decide on the printed decimal digits.
    """
    return f"cast(replace(format_number({x}, {digits}), ',', '') as double)"


def pct2(part: str, whole: str) -> str:
    return round_scalar(f"coalesce(try_divide({part}, {whole}) * 100, 0D)", 2)


def bin_right(x: str, edges: Sequence[float], labels: Sequence[str]) -> str:
    """Label of the right-closed bin `(edge[i-1], edge[i]]`; the last bin is open above."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need one label more than inner edges")
    cases = " ".join(f"when {x} <= {number(e)} then {text(t)}" for e, t in zip(edges, labels))
    return f"case when {x} is null then null {cases} else {text(labels[-1])} end"


def money(x: str) -> str:
    return f"concat('$', format_number({x}, 2))"


def one_decimal(x: str) -> str:
    return f"replace(format_number({x}, 1), ',', '')"

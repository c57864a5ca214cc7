"""Mixed-format date text -> timestamp: the text is rewritten to ISO order, then cast once."""

from __future__ import annotations

from tablewright.functions.sql import text

# Prefixes that make text look like a date. The profile's list is
# stricter than the cleaner's (no dots, comma required after `Aug 15`).
PROFILE_DATE_PATTERNS = (
    r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}",
    r"^[A-Za-z]{3,9}\s+\d{1,2},\s*\d{4}",
    r"^\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}",
)
CLEAN_DATE_PATTERNS = (
    r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}",
    r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}",
    r"^[a-zA-Z]{3,9}\s+\d{1,2},?\s+\d{4}",
    r"^\d{1,2}\s+[a-zA-Z]{3,9}\s+\d{4}",
)
# English month names; the first three letters also stand for the month.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
)
# Two-digit years below this fall into the 2000s.
CENTURY_PIVOT = 76

_BLANK = r"[\s\xa0]*"
_WEEKDAY = r"(?i)(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_MONTH = r"(0?[1-9]|1[0-2])"
_DAY = r"(0?[1-9]|[12]\d|3[01])"
_LATE_DAY = r"(?:1[3-9]|2\d|3[01])"
_SEP = r"[-/.]"
_NAME = "((?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS) + r"|sept))\.?"
_NUMBER = r"(\d{1,2})(?:st|nd|rd|th)?"
_YEAR = r"(\d{4}|\d{2})"
# Hour, minute, second, fraction (digits beyond a microsecond are cut), half of the day; then a zone.
_CLOCK = (
    r"[\sTt,]+(?=\d{1,2}(?::|\s*[AaPp]\.?[Mm]))(\d{1,2})(?::(\d{2}))?(?::(\d{2}))?(?:[.,](\d{1,6})\d*)?(?:\s*([AaPp])\.?[Mm]\.?)?"
    r"(?:\s*(?:Z|UTC|GMT)?(?:[+-]\d{2}(?::?\d{2})?)?)?"
)


def looks_like_date(trimmed: str, patterns=CLEAN_DATE_PATTERNS) -> str:
    either = "|".join(f"(?:{p})" for p in patterns)
    return f"(length({trimmed}) >= 6 and {trimmed} rlike {text(either)})"


def order_evidence(x: str) -> tuple[str, str]:
    """Tests for text that can only be day-first, and only month-first."""
    def only(first: str, second: str) -> str:
        return f"{x} rlike {text(rf'^{_BLANK}{first}{_SEP}{second}{_SEP}(?:\d{{4}}|\d{{2}})(?!\d)')}"

    return only(_LATE_DAY, _MONTH), only(_MONTH, _LATE_DAY)


def _whole(body: str) -> str:
    return text(f"^{_BLANK}{body}(?:{_CLOCK})?{_BLANK}$")


def _clock(x: str) -> str:
    """` 15:00:00.5` of the time behind a date, nothing without one, NULL for an hour that does not exist."""
    pattern = text(f"^.*?{_CLOCK}{_BLANK}$")

    def part(i: int) -> str:
        return f"regexp_extract({x}, {pattern}, {i})"

    hour, half = f"cast({part(1)} as int)", f"lower({part(5)})"
    in_day = (f"case when {half} = '' then {hour} when {hour} > 12 then null "
              f"else {hour} % 12 + if({half} = 'p', 12, 0) end")
    rest = ", ".join(f"if({part(i)} = '', '00', {part(i)})" + end for i, end in ((2, ", ':'"), (3, ", '.'"), (4, "")))
    return f"case when {x} rlike {pattern} then concat(' ', {in_day}, ':', {rest}) else '' end"


def parse_timestamp(x: str, day_first: bool = False, pivot: int = CENTURY_PIVOT) -> str:
    """Timestamp without time zone, or NULL.

    A value is an optional weekday, one of the layouts below, and an optional time with 12 or 24
    hours. Year-first text reads as y-m-d. Text such as `5/8/2026` reads month-first and, where that
    cannot be, day-first (`day_first` swaps the two). A month alone is its first day. A zone suffix is
    dropped, keeping the value's own wall-clock, whatever the session's zone is.
    """
    months = "array(" + ", ".join(text(m[:3]) for m in MONTHS) + ")"

    def replaced(body: str, order: str) -> tuple[str, str]:
        return _whole(body), f"regexp_replace({x}, {_whole(body)}, '{order}')"

    def named(body: str, year: int, name: int, day: int | None) -> tuple[str, str]:
        pattern = _whole(body)
        month = f"array_position({months}, lower(left(regexp_extract({x}, {pattern}, {name}), 3)))"
        own_day = "'1'" if day is None else f"regexp_extract({x}, {pattern}, {day})"
        return pattern, f"concat({full_year(f'regexp_extract({x}, {pattern}, {year})')}, '-', {month}, '-', {own_day})"

    def full_year(y: str) -> str:
        return f"if(length({y}) = 4, {y}, concat(if(cast({y} as int) < {pivot}, '20', '19'), {y}))"

    orders = [(f"{_MONTH}{_SEP}{_DAY}{_SEP}", "$1-$2"), (f"{_DAY}{_SEP}{_MONTH}{_SEP}", "$2-$1")]
    if day_first:
        orders.reverse()
    day_month = [replaced(rf"{head}(\d{{4}})", f"$3-{rest}") for head, rest in orders]
    for head, rest in orders:
        pattern, year_last = replaced(rf"{head}(\d{{2}})", f"$3-{rest}")
        day_month.append((pattern, f"concat(if(cast(regexp_extract({x}, {pattern}, 3) as int) < {pivot}, '20', '19'), {year_last})"))
    # What a value begins with leaves a few layouts to try.
    families = [
        (rf"^{_BLANK}\d{{4}}", [
            replaced(rf"(\d{{4}}){_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}})", "$1-$2-$3"),
            replaced(r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3"),
            replaced(r"(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})", "$1-$2-$3 $4:$5:$6"),
            replaced(rf"(\d{{4}}){_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}})[\sTt]+(\d{{1,2}})", "$1-$2-$3 $4:00"),
            replaced(r"(\d{4})[-/](\d{1,2})", "$1-$2-1"),
        ]),
        (rf"^{_BLANK}\d{{1,2}}{_SEP}\d", [*day_month, replaced(r"(\d{1,2})[-/](\d{4})", "$2-$1-1")]),
        (r"\d{2}", [
            named(rf"{_WEEKDAY}{_NAME}\s+{_NUMBER},?\s+{_YEAR}", 3, 1, 2),
            named(rf"{_WEEKDAY}{_NUMBER}(?:\s+of)?[\s-]*{_NAME}[\s,-]*{_YEAR}", 3, 2, 1),
            named(rf"{_WEEKDAY}{_NAME}[\s,-]+(\d{{4}})", 2, 1, None),
        ]),
    ]

    def first_of(layouts: list[tuple[str, str]]) -> str:
        return f"case {' '.join(f'when {x} rlike {pattern} then {value}' for pattern, value in layouts)} end"

    date = f"case {' '.join(f'when {x} rlike {text(sign)} then {first_of(layouts)}' for sign, layouts in families)} end"
    # Most dates have no time: its pattern is tried only where there is a sign of one.
    return f"try_cast(concat({date}, if({x} rlike ':|[AaPp][.]?[Mm]', {_clock(x)}, '')) as timestamp_ntz)"


def wall_clock(x: str, zone: str = "UTC") -> str:
    """What a clock in `zone` showed at an instant, as a timestamp without zone; the session's zone plays no part."""
    return f"timestampadd(microsecond, unix_micros(from_utc_timestamp({x}, {text(zone)})), timestamp_ntz'1970-01-01 00:00:00')"

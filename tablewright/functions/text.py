"""Text expressions: trimming, null tokens, title case, booleans, domain dictionaries."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from tablewright.functions.names import name_key
from tablewright.functions.numbers import WHITE_SPACE
from tablewright.functions.sql import any_of, sql_map, text

# Text that means "missing" once trimmed and lower-cased.
NULL_TOKENS = ("nan", "none", "null", "n/a", "", "undefined", "<na>")
# Text read as true / false.
TRUE_TOKENS = ("true", "yes", "y", "1", "1.0", "t")
FALSE_TOKENS = ("false", "no", "n", "0", "0.0", "f")
# The narrower list the profile uses to call a column boolean.
PROFILE_BOOL_TOKENS = ("true", "false", "yes", "no", "y", "n", "0", "1")
# Name fragments of columns whose casing is left alone.
KEEP_CASE_KEYWORDS = ("id", "code", "email", "url")
# Spellings of known business domains.
DOMAINS: dict[str, dict[str, str]] = {
    "gender": {
        "m": "Male", "male": "Male", "m.": "Male", "man": "Male",
        "f": "Female", "female": "Female", "f.": "Female", "woman": "Female",
        "other": "Other", "unknown": "Unknown",
    },
    "region": {
        "north": "North", "north region": "North", "northern": "North",
        "south": "South", "south region": "South", "southern": "South",
        "east": "East", "east region": "East", "eastern": "East",
        "west": "West", "west region": "West", "western": "West",
        "central": "Central",
    },
    "account_status": {
        "active": "Active", "act": "Active", "enabled": "Active",
        "inactive": "Inactive", "inact": "Inactive", "disabled": "Inactive",
        "pending": "Pending", "suspended": "Suspended",
    },
    "status": {
        "active": "Active", "inactive": "Inactive", "pending": "Pending",
        "draft": "Draft", "audited": "Audited",
    },
    "payment_method": {
        "upi": "UPI", "credit card": "Credit Card", "cc": "Credit Card",
        "debit card": "Debit Card", "dc": "Debit Card", "net banking": "Net Banking",
        "cash on delivery": "Cash on Delivery", "cod": "Cash on Delivery",
    },
    "customer_segment": {
        "consumer": "Consumer", "corporate": "Corporate",
        "home office": "Home Office", "sme": "SME",
    },
}

_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def trim_text(x: str) -> str:
    return f"trim(both {text(WHITE_SPACE)} from {x})"


def null_tokens_to_null(trimmed: str) -> str:
    return f"case when lower({trimmed}) not in {any_of(NULL_TOKENS)} then {trimmed} end"


def title_case(x: str) -> str:
    """First letter of every letter run upper, the rest lower (`usb-c 4k` -> `Usb-C 4K`)."""
    runs = text(f"([{_CASED}]+|[^{_CASED}]+)")
    by_run = f"array_join(transform(regexp_extract_all({x}, {runs}, 1), r -> initcap(r)), '')"
    # Plain words need no run splitting, and initcap stays inside generated code.
    return f"case when {x} rlike '^[A-Za-z ]*$' then initcap({x}) else {by_run} end"


def domain_for(column: str, domains: Mapping[str, Mapping[str, str]]) -> str | None:
    """First dictionary whose key contains, or is contained in, the column name."""
    key = name_key(column)
    return next((rule for rule in domains if rule in key or key in rule), None)


def keeps_case(column: str) -> bool:
    return any(kw in name_key(column) for kw in KEEP_CASE_KEYWORDS)


def map_values(x: str, mapping: Mapping[str, str]) -> str:
    """Dictionary lookup on lower-cased text, else title case."""
    return f"coalesce(try_element_at({sql_map(mapping.items())}, lower({x})), {title_case(x)})"


def is_token(x: str, tokens: Collection[str]) -> str:
    """Is the text, in any casing, one of few short words? Longer text is told by its length alone."""
    return f"(length({x}) <= {max(len(t) for t in tokens)} and lower({x}) in {any_of(tokens)})"


def parse_boolean(x: str) -> str:
    token = f"lower({trim_text(x)})"
    return f"case when {token} in {any_of(TRUE_TOKENS)} then true when {token} in {any_of(FALSE_TOKENS)} then false end"

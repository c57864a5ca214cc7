"""Column-name rules: snake_case headers, keyword lookup, naming diagnostics."""

from __future__ import annotations

import re
from collections.abc import Sequence

# Name fragments of fields that must not be negative.
POSITIVE_KEYWORDS = (
    "price", "unit_price", "quantity", "qty", "amount", "salary", "income",
    "age", "revenue", "cost", "spend", "sales", "experience",
)
# Characters that make a header non-standard.
NONSTANDARD_CHARS = " -()%#$/\\"
# Words written in place of symbols when `symbol_words` is on.
SYMBOL_WORDS = {"%": "pct", "$": "usd"}


def snake_name(header: str, symbol_words: bool = False) -> str:
    text = str(header)
    if symbol_words:
        for symbol, word in SYMBOL_WORDS.items():
            text = text.replace(symbol, f" {word} ")
    words = re.split(r"[\s\-./\\()\[\]_]+", text.strip())
    kept = [re.sub(r"[^a-zA-Z0-9]", "", w) for w in words]
    return "_".join(w for w in kept if w).lower() or "unnamed_col"


def snake_names(headers: Sequence[str], symbol_words: bool = False) -> list[str]:
    """New names by position; a name already taken gets the next free `_1`, `_2`, ..."""
    taken: set[str] = set()
    out = []
    for header in headers:
        base = name = snake_name(header, symbol_words)
        n = 0
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name)
        out.append(name)
    return out


def find_column(columns: Sequence[str], keywords: Sequence[str]) -> str | None:
    """First exact (case-blind) match in keyword order; only then substring matches."""
    lowered = [(c, c.lower().strip()) for c in columns]
    for matches in (str.__eq__, lambda name, kw: kw in name):
        for kw in keywords:
            hit = next((c for c, name in lowered if matches(name, kw)), None)
            if hit is not None:
                return hit
    return None


def name_key(column: str) -> str:
    return column.lower().replace(" ", "_")


def expects_positive(column: str) -> bool:
    return any(kw in name_key(column) for kw in POSITIVE_KEYWORDS)


def is_nonstandard(column: str) -> bool:
    return column != column.lower() or any(c in column for c in NONSTANDARD_CHARS)


def date_prefix(column: str) -> str:
    """`order_date` -> `order_`; `date` -> ``: what the parts of the name say besides that it is a date."""
    parts = [part.replace("date", "") for part in column.split("_")]
    return "".join(f"{part}_" for part in parts if part)

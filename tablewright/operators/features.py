"""Derived columns: calendar parts, revenue, discount, profit, full name, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.names import date_prefix, find_column
from tablewright.functions.numbers import as_double, bin_right, round2
from tablewright.functions.sql import is_numeric, q, time_columns
from tablewright.operators.entry import finite
from tablewright.operators.impute import CATEGORIES

# Keyword lists by priority.
QUANTITY_KEYS = ("quantity", "qty", "units_sold", "volume")
PRICE_KEYS = ("unit_price", "price", "item_price", "rate")
DISCOUNT_KEYS = ("discount_pct", "discount", "discount_rate")
REVENUE_KEYS = ("gross_revenue", "revenue", "sales", "net_revenue", "calculated_revenue")
COST_KEYS = ("operating_cost", "cost", "total_cost", "cogs", "expenses")
FIRST_NAME_KEYS = ("first_name", "fname")
LAST_NAME_KEYS = ("last_name", "lname")
CREDIT_KEYS = ("credit_score", "cibil_score")
EXPERIENCE_KEYS = ("experience_yrs", "experience", "years_experience", "tenure")
# Tier edges (right-closed) and labels.
CREDIT_EDGES = (579, 669, 739, 799)
CREDIT_LABELS = ("Poor (<580)", "Fair (580-669)", "Good (670-739)", "Very Good (740-799)", "Exceptional (800+)")
EXPERIENCE_EDGES = (2, 5, 10)
EXPERIENCE_LABELS = ("Junior (0-2 yrs)", "Mid-Level (3-5 yrs)", "Senior (6-10 yrs)", "Lead/Principal (10+ yrs)")


def calendar_parts(column: str, keep_null_weekend: bool = False) -> dict[str, str]:
    """Part name -> expression. A missing date counts as no weekend unless asked otherwise."""
    d = q(column)
    return {
        "year": f"year({d})",
        "month": f"month({d})",
        "quarter": f"concat(year({d}), 'Q', quarter({d}))",
        "month_year": f"date_format({d}, 'yyyy-MM')",
        "day_name": f"date_format({d}, 'EEEE')",
        "is_weekend": f"weekday({d}) >= 5" if keep_null_weekend else f"coalesce(weekday({d}) >= 5, false)",
    }


# How each calendar part is described.
_PART_NOTES = {
    "year": "Extracted calendar year from", "month": "Extracted month number (1-12) from",
    "quarter": "Extracted fiscal quarter from", "month_year": "Extracted YYYY-MM period from",
    "day_name": "Extracted day of week name from", "is_weekend": "Extracted weekend boolean flag from",
}


def revenue(quantity: str, price: str) -> str:
    return round2(f"{quantity} * {price}")


def discount_rate(x: str) -> str:
    """Percentages above 1 are divided by 100; smaller (and negative) values are taken as rates."""
    return f"if({x} > 1, {x} / 100, {x})"


def margin_pct(profit: str, revenue: str) -> str:
    """0.0 where revenue is missing or not positive."""
    return f"case when {revenue} > 0 then {round2(f'{profit} / {revenue} * 100')} else 0D end"


def full_name(first: str, last: str) -> str:
    return f"trim(concat(coalesce({first}, ''), ' ', coalesce({last}, '')))"


def credit_tier(x: str) -> str:
    return bin_right(x, CREDIT_EDGES, CREDIT_LABELS)


def experience_level(x: str) -> str:
    return bin_right(x, EXPERIENCE_EDGES, EXPERIENCE_LABELS)


class _Builder:
    """Adds columns one projection at a time and keeps a note about each."""

    def __init__(self, df: DataFrame):
        self.df, self.notes = df, {}

    def find(self, keywords: tuple[str, ...], numeric: bool = False) -> str | None:
        name = find_column(self.df.columns, keywords)
        return name if name and (not numeric or is_numeric(self.df.schema[name].dataType)) else None

    def missing(self, *names: str) -> bool:
        return not set(names) & set(self.df.columns)

    def add(self, new: dict[str, str], notes: dict[str, str], order: tuple[str, ...] = ()) -> None:
        """`order` lists the values of new ordered categories, least first; it stays with the columns."""
        self.df = self.df.select("*", *[F.expr(e).alias(n, metadata={CATEGORIES: list(order)} if order else {}) for n, e in new.items()])
        self.notes |= notes


def derive_features(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Every feature the columns allow, and a note per feature. Existing columns are not overwritten."""
    b = _Builder(finite(df))
    for date in time_columns(df):
        prefix = date_prefix(date)
        parts = {p: e for p, e in calendar_parts(date).items() if b.missing(prefix + p)}
        if parts:
            b.add({prefix + p: e for p, e in parts.items()},
                  {prefix + p: f"{_PART_NOTES[p]} '{date}'" for p in parts})

    qty, price = b.find(QUANTITY_KEYS, numeric=True), b.find(PRICE_KEYS, numeric=True)
    if qty and price:
        name = "revenue" if b.missing("revenue", "total_amount") else "calculated_revenue"
        b.add({name: revenue(as_double(qty), as_double(price))}, {name: f"Calculated Revenue = ({qty} × {price})"})
        discount = b.find(DISCOUNT_KEYS, numeric=True)
        if discount:
            b.add({"discount_amount": round2(f"{q(name)} * {discount_rate(as_double(discount))}")}, {})
            b.add({"net_revenue": round2(f"{q(name)} - discount_amount")},
                  {"net_revenue": f"Calculated Net Revenue after {discount}"})

    gross, cost = b.find(REVENUE_KEYS, numeric=True), b.find(COST_KEYS, numeric=True)
    if gross and cost and b.missing("profit", "net_profit"):
        b.add({"gross_profit": round2(f"{as_double(gross)} - {as_double(cost)}")},
              {"gross_profit": f"Calculated Gross Profit = ({gross} - {cost})"})
        b.add({"profit_margin_pct": margin_pct("gross_profit", as_double(gross))},
              {"profit_margin_pct": f"Calculated Profit Margin % = (Profit / {gross} × 100)"})

    first, last = b.find(FIRST_NAME_KEYS), b.find(LAST_NAME_KEYS)
    if first and last and b.missing("full_name"):
        b.add({"full_name": full_name(q(first), q(last))}, {"full_name": f"Combined '{first}' and '{last}' into 'full_name'"})

    credit = b.find(CREDIT_KEYS, numeric=True)
    if credit and b.missing("credit_tier"):
        b.add({"credit_tier": credit_tier(as_double(credit))},
              {"credit_tier": f"Binned '{credit}' into standardized credit rating tiers"}, CREDIT_LABELS)
    experience = b.find(EXPERIENCE_KEYS, numeric=True)
    if experience and b.missing("experience_level"):
        b.add({"experience_level": experience_level(as_double(experience))},
              {"experience_level": f"Binned '{experience}' into professional experience levels"}, EXPERIENCE_LABELS)
    return b.df, b.notes

"""Column expressions shared by the reports; all built-in, JVM-side functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result types fixed across engines (T4): integer sums as BIGINT, money sums
# as DECIMAL(38,2), averages as DOUBLE computed from an exact decimal sum.
MONEY_SUM = "decimal(38,2)"
COUNT_SUM = "bigint"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def line_total(quantity: str | Column = "Quantity", price: str | Column = "SalePrice") -> Column:
    """Quantity * SalePrice, exact decimal (decimal(21,2) for int * decimal(10,2))."""
    return col(quantity) * col(price)


def cents(price: str | Column = "SalePrice") -> Column:
    """A 2-decimal money value as whole cents (exact: the scale is 2)."""
    return (col(price) * 100).cast("long")


#: Limb of a price in cents: quantity times a limb stays far inside a long.
LIMB = 100_000


def line_cents_sum(quantity: str | Column = "Quantity", price: str | Column = "SalePrice") -> Column:
    """Sum of Quantity * SalePrice in whole cents, as decimal(38,0).

    The price is split into two limbs whose products are summed as longs, so
    the per-line work stays on the fast fixed-width path, and the sums are put
    together once per group. A single product or the sum of cents in one long
    would overflow; from the second level up the sums are decimal.
    """
    c, q = cents(price), col(quantity).cast("long")
    high = F.sum(F.call_function("div", c, F.lit(LIMB).cast("long")) * q)
    low = F.sum((c % LIMB) * q)
    return (high.cast("decimal(38,0)") * LIMB + low).cast("decimal(38,0)")


def money_from_cents(total_cents: str | Column) -> Column:
    """Whole cents back to DECIMAL(38,2), once per group (exact)."""
    return (col(total_cents).cast("decimal(38,0)") / 100).cast(MONEY_SUM)


def mean_from_cents(total_cents: str | Column, count: str | Column) -> Column:
    """Mean price as DOUBLE: the exact sum as the nearest double, divided by the count."""
    return col(total_cents).cast("double") / 100.0 / col(count)


def units_sum(c: str | Column) -> Column:
    return F.sum(col(c)).cast(COUNT_SUM)


def year_month(date: str | Column) -> Column:
    """'yyyy-MM' text of a date (FORMAT(d,'yyyy-MM') / DATE_FORMAT(d,'%Y-%m'))."""
    return F.date_format(col(date), "yyyy-MM")


def month_start(date: str | Column) -> Column:
    """First day of the month: a cheap grouping key, formatted after aggregation."""
    return F.trunc(col(date), "month")


def contains_pattern(term: str, escape: bool = False) -> str:
    """'%term%' as the page builds it; ``escape`` makes % and _ literal."""
    if escape:
        term = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{term}%"


def not_blank(c: str | Column) -> Column:
    """True when the text has a non-whitespace character (Python ``str.strip``)."""
    return col(c).rlike(r"\S")


def thousands(c: str | Column, decimals: int = 0) -> Column:
    """Presentation text with thousands separators, e.g. 273,900."""
    return F.format_number(col(c), decimals)


def half_up_div(total: Column, count: Column, scale_type: str = "decimal(10,2)") -> Column:
    """Exact division of money by a count, rounded half up once, in whole cents."""
    total_cents = (F.abs(total) * 100).cast("decimal(38,0)")
    n = count.cast("decimal(20,0)")
    rounded = F.call_function("div", total_cents * 2 + n, n * 2)
    return (F.signum(total).cast("int") * rounded / F.lit(100).cast("decimal(3,0)")).cast(scale_type)

"""Money as decimals; text forms of billing exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
MARKS = "$,()"
# Amounts of at most two places whose marks stand where they are expected; and a pair of parentheses around all.
PLAIN = r"\A(-?\$?[0-9][0-9,]{0,15}(\.[0-9]{1,2})?|\(\$?[0-9][0-9,]{0,15}(\.[0-9]{1,2})?\))\z"
AROUND = r"(?s)\A\((.*)\)\z"


def parse_amount(value: Column) -> Column:
    """Amounts such as ``$1,234.56`` or ``(500.00)`` (negative) as decimals; null is 0, other text an error.

    Parentheses count as a pair around the whole amount alone; anywhere else they are an error, as is any other
    text that is no number or has parts of a cent, whatever the session's ANSI setting."""
    written = value.cast("string")
    # most amounts are written plainly: one match and one cast
    common = F.when(written.rlike(PLAIN), F.translate(written, "($,)", "-").try_cast(MONEY))
    # the rest in a function of its own, so that the code for all rows stays small enough to be compiled
    rest = F.element_at(F.transform(F.array(F.trim(written)), _any_amount), 1)
    return F.when(value.isNull(), F.lit(0).cast(MONEY)).otherwise(F.coalesce(common, rest)).cast(MONEY)


def _any_amount(text: Column) -> Column:
    exact = F.translate(F.regexp_replace(text, AROUND, "$1"), "$,", "").try_cast("decimal(38,12)")
    plain = F.when(exact == exact.cast(MONEY), exact.cast(MONEY))  # nothing is rounded
    sound = F.coalesce(plain, F.raise_error(F.concat(F.lit("not an amount: "), text)).cast(MONEY))
    return F.when(text.rlike(AROUND), -sound).otherwise(sound).cast(MONEY)


def needs_parsing(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.translate(text, MARKS, "") != text, F.lit(False))


def total(column: Column | str) -> Column:
    """Sum as money, 0 over no rows."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.sum(column), F.lit(0)).cast("decimal(28,2)")


def total_if(condition: Column, column: Column) -> Column:
    return total(F.when(condition, column))


def ratio(a: Column, b: Column) -> Column:
    """Quotient as a double; null where the divisor is 0 or null."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / b)

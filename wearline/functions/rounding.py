"""Small column helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(value: Column | str, digits: int = 6) -> Column:
    """Rounded DOUBLE without a negative zero, comparable across engines.

    Rounding four digits further first settles exact halves, which sums in another order may miss by one bit.
    """
    column = F.col(value) if isinstance(value, str) else value
    return F.round(F.round(column.cast("double"), digits + 4), digits) + F.lit(0.0)


def settle_halves(sql: str) -> str:
    """The same two-step rounding for every `round(x, n)` of a SQL text."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        body, comma, digits = sql[start + 6 : end - 1].rpartition(",")
        inner = settle_halves(body if comma and digits.strip().isdigit() else sql[start + 6 : end - 1])
        rounded = f"round(round({inner}, {int(digits) + 4}), {int(digits)})" if comma and digits.strip().isdigit() else f"round({inner})"
        out += [sql[at:start], rounded]
        at = end
    return "".join([*out, sql[at:]])

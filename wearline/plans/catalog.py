"""Registry of the queries this package answers on the test tables, each with its SQL twin if one exists."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wearline.functions.rounding import settle_halves
from wearline.session import measured_joins

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Named sub-queries the SQL twins may use; a body may use earlier names.
VIEWS: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        def run(spark: SparkSession, sf: str) -> DataFrame:
            measured_joins(spark)
            return query(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(settle_halves(sql))
        return query

    return keep


def with_views(sql: str) -> str:
    """Put the WITH list of every named sub-query the statement needs in front of it."""
    if re.search(r"\bv_\w+ AS \(", sql):  # already expanded
        return sql.strip()
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"\bv_\w+", text)) & VIEWS.keys() - needed:
            needed.add(word)
            visit(VIEWS[word])

    visit(sql)
    if not needed:
        return sql.strip()
    recursive = any(re.search(rf"\b{name}\b", VIEWS[name]) for name in needed)
    head = "WITH RECURSIVE " if recursive or sql.strip().startswith("WITH RECURSIVE ") else "WITH "
    parts = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in needed)
    body = sql.strip()
    own = re.match(r"WITH (RECURSIVE )?", body)
    return f"{head}{parts},\n{body[own.end():]}" if own else f"{head}{parts}\n{body}"

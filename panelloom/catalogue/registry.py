"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelloom.functions.numbers import TIE_TOLERANCE
from panelloom.functions.text import ident, rounded_text

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
STATEMENTS: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name. ``covers`` lists the inventory items it exercises."""

    def register(function: Query) -> Query:
        name = function.__name__
        QUERIES[name] = function
        COVERS[name] = covers
        if sql is not None:
            STATEMENTS[name] = sql
        return function

    return register


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.selectExpr(
        *[f"{rounded_text(ident(c), places, TIE_TOLERANCE)} AS {ident(c)}" if c in columns else ident(c) for c in df.columns]
    )


def rnd(expression: str, places: int) -> str:
    """SQL counterpart of ``round_places``."""
    return f"(floor(({expression}) * 1e{places} + {0.5 + TIE_TOLERANCE}e0) / 1e{places})"


# Shared table expressions, in dependency order.
TABLES: dict[str, str] = {}


def with_tables(body: str) -> str:
    """Prefix the shared expressions that the statement uses, directly or through one another."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in TABLES.items():
            if sql is not text and name not in needed and re.search(rf"\b{name}\b", text):
                visit(sql)
                needed.append(name)

    visit(body)
    if not needed:
        return body
    shared = ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n]})" for n in needed)
    joined = f",\n{body.lstrip()[5:]}" if body.lstrip().startswith("WITH ") else f"\n{body}"
    return f"WITH {shared}{joined}"

"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def with_views(sql: str) -> str:
    """The SQL preceded by the views that it names, directly or through others; a SQL may begin with views of its own."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(body)
                needed.append(name)

    visit(sql)
    own = sql.strip()
    recursive = "RECURSIVE " if "walk" in needed or re.match(r"WITH RECURSIVE\b", own) else ""
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in needed]
    if re.match(r"WITH\b", own):
        first = re.sub(r"^WITH (RECURSIVE )?", "", own)
        return f"WITH {recursive}{', '.join([*parts, first])}"
    return f"WITH {recursive}{', '.join(parts)} {own}" if parts else own


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return add

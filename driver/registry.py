"""Registry of queries: each key has a Spark callable and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from driver.views import VIEW_SQL

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefix the fixture views a statement uses, as CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEW_SQL:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(VIEW_SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    ctes = [f"{n} AS ({VIEW_SQL[n]})" for n in needed]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join([*ctes, body[5:]]) if ctes else body
    return ("WITH " + ", ".join(ctes) + " " + body) if ctes else body


def query(name: str, sql: str | None = None):
    def wrap(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return wrap

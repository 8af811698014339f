"""All queries of the topic-map engine, with the SQL that checks them."""

from __future__ import annotations

from tessera.plans import book, flows, imports, intake, records, space, trends  # noqa: F401


def queries() -> dict:
    return dict(book.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(book.SQL)

"""Registered queries: a name, the DataFrame query, and SQL over the driver's tables that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.sources.estate import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Functions with file, repository and identity, for oracles.
IDENT = """ident AS (SELECT fn.id, fn.file_id, fn.name, fn.simple_name, fn.start_line, fn.end_line, f.repo_id, f.snapshot_id, f.path AS file_path, f.language, r.name AS repo_name,
  concat(r.name, ':', f.path, ':', fn.name) AS caller_id FROM functions fn JOIN files f ON f.id = fn.file_id JOIN repositories r ON r.id = f.repo_id)"""


def query(name: str, tables: str = "", sql: str | None = None):
    """Register a query. tables: fact tables that sql reads; sql: a SELECT, or WITH and a SELECT."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_tables(tables, sql)
        return f

    return put

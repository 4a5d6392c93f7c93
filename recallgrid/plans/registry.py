"""Where queries over the store and the test tables are registered, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.model import Store, load, oracle_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BASE = 1704067200  # the time that the projected store's times count from
MEAN = "CASE WHEN alpha + beta > 0 THEN alpha / (alpha + beta) ELSE 0.5 END"
ASKED = (("q1", "the heation of thing"), ("q2", "de la eau que"), ("q3", "erst thand the idiot"), ("q4", "die der enpf"), ("q5", "los mente que"))


def on_store(tables: str, sql: str | None):
    """Register a query over the projected store. ``tables``: those that the SQL reads."""

    def add(f: Callable[[Store], DataFrame]) -> Callable[[Store], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(load(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = oracle_tables(*tables.split()) + "\n" + sql if tables else sql
        return f

    return add


def on_tables(sql: str | None):
    """Register a query over the test tables as they are."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def statements(table: str, column: str, values: tuple[str, ...]) -> str:
    """A table of numbered texts for a WITH clause: (``k``, the column)."""
    rows = ", ".join("({}, '{}')".format(k, v.replace("'", "''")) for k, v in enumerate(values))
    return f"{table}(k, {column}) AS (VALUES {rows})"


def asked(store: Store) -> DataFrame:
    return store.beliefs.sparkSession.createDataFrame(list(ASKED), "query_id string, query string")


ASKED_SQL = "(VALUES " + ", ".join(f"('{i}', '{q}')" for i, q in ASKED) + ") AS asked(query_id, query)"


def one_byte(table: str, column: str) -> str:
    """Tables for a WITH clause that end in ``ab`` (``f``, ``t``): the characters beyond ASCII of a column, and for each a character of ASCII that isn't in it.

    DuckDB's edit distance counts bytes; with ``translate(x, f, t)`` it counts characters.
    """
    return f"""used AS (SELECT DISTINCT unnest(string_split({column}, '')) AS c FROM {table}), far AS (SELECT c, row_number() OVER (ORDER BY c) AS k FROM used WHERE ascii(c) > 127),
    spare AS (SELECT x, row_number() OVER (ORDER BY x) AS k FROM (SELECT unnest(range(1, 128))::INTEGER AS x) q WHERE chr(x) NOT IN (SELECT c FROM used)),
    ab AS (SELECT coalesce(string_agg(c, '' ORDER BY k), '') AS f, coalesce(string_agg(chr(x), '' ORDER BY k), '') AS t FROM far JOIN spare USING (k))"""

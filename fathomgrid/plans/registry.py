"""Named queries over a data directory, each with the SQL that gives the same rows (where SQL can)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomgrid.functions import text as tx
from fathomgrid.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Attribute access to the tables of a directory: ``t.chunks``."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.directory, name)


def query(sql: str | None = None) -> Callable:
    """Register ``fn(t: Tables) -> DataFrame`` under its own name."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = lambda spark, directory: fn(Tables(spark, directory))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# ---- pieces of SQL that several queries share ------------------------------------------------


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_case(expr: str, mapping: dict[str, str], default: str) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {default} END"


def sql_terms(col: str) -> str:
    return rf"list_filter(regexp_split_to_array(translate(lower(regexp_replace({col}, '[\x{{0300}}-\x{{036f}}]', '', 'g')), '{tx.ACCENTED}', '{tx.PLAIN}'), '[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda t: t <> '')"


def sql_tokens(col: str) -> str:
    return f"list_distinct({sql_token_list(col)})"


def sql_token_list(col: str) -> str:
    low = rf"regexp_replace(regexp_replace(lower({col}), '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g')"
    low = rf"""replace(regexp_replace({low}, '[-_*"(){{}}\[\]^~:+.#@!\\/<>|&$%?]', ' ', 'g'), chr(1), '.')"""
    fixed = f"list_transform(regexp_split_to_array({low}, '[ \\t\\n\\x0b\\f\\r]+'), lambda t: {sql_case('t', tx.TYPOS, 't')})"
    return f"list_filter({fixed}, lambda t: length(t) > 1 OR regexp_matches(t, '[0-9]') OR regexp_matches(t, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]'))"


SQL_STEM = (
    "CASE WHEN length(t) > 4 AND suffix(t, 'ies') THEN substring(t, 1, length(t) - 3) || 'y' WHEN length(t) > 5 AND suffix(t, 'ing') THEN substring(t, 1, length(t) - 3) "
    "WHEN length(t) > 4 AND suffix(t, 'ed') THEN substring(t, 1, length(t) - 2) WHEN length(t) > 3 AND suffix(t, 's') THEN substring(t, 1, length(t) - 1) ELSE t END"
)


def sql_signals(tokens: str) -> str:
    return f"list_distinct(list_transform(list_filter({tokens}, lambda t: NOT list_contains({sql_list(tx.STOP_WORDS)}, t)), lambda t: {SQL_STEM}))"


def sql_spaced(col: str) -> str:
    return f"regexp_replace({col}, '[./_-]', ' ', 'g')"


SQL_DOT = "list_sum(list_transform(list_zip(a, b), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"

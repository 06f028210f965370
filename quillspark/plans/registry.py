"""Where queries are registered, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import nodes as N
from ..operators.staging import stage
from ..sources.text import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(name: str):
    return lambda spark, sf: read_table(spark, sf, name)


documents, pages = table("documents"), table("pages")


def nodes_once(docs: DataFrame, **options) -> DataFrame:
    """The node table of documents, staged: for what reads it more than once, which else would parse as often."""
    return stage(N.parse_nodes(docs, **options))


def nodes_of(corpus, spark, sf, **options) -> DataFrame:
    return N.parse_nodes(corpus(spark, sf), **options)

"""Table functions for SQL: the parser as a row source in ``LATERAL`` and over partitioned tables.

``register(spark)`` makes them known to the session::

    SELECT d.doc_id, n.* FROM docs d, LATERAL md_nodes(d.text, kinds => 'heading,link', columns => 'kind,level,url') n
    SELECT * FROM md_assembled(TABLE(SELECT conv_id, text FROM turns) PARTITION BY conv_id ORDER BY turn)

Each states its schema when the query is analysed, from the arguments given, so
only the columns asked for leave Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..kernel.tree import FIELDS, rows_of
from ..operators.nodes import tree_of

_NAMES = [n for n, _ in FIELDS]
_KIND = _NAMES.index("kind")
#: All columns of the node table, as Spark types.
_TYPES = {"int": IntegerType(), "string": StringType(), "boolean": BooleanType(), "array<string>": ArrayType(StringType())}
NODE = StructType([StructField(n, _TYPES[t]) for n, t in FIELDS])
CELL = StructType([StructField(n, _TYPES[t]) for n, t in (("table", "int"), ("row", "int"), ("col", "int"), ("header", "boolean"), ("cell", "string"))])


@dataclass
class Plan(AnalyzeResult):
    """What the analysed call asks for, handed on to the tasks."""

    at: list[int] = field(default_factory=list)
    kinds: frozenset[str] = frozenset()
    options: dict[str, Any] = field(default_factory=dict)


def _constant(arg: AnalyzeArgument | None, name: str, default: Any) -> Any:
    if arg is None:
        return default
    if not arg.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    return default if arg.value is None else arg.value


def _names(value: str) -> list[str]:
    return [x.strip() for x in value.split(",") if x.strip()]


def _plan(before: list[StructField], kinds, columns, extended, smart) -> Plan:
    wanted = _names(_constant(columns, "columns", ",".join(_NAMES)))
    unknown = [x for x in wanted if x not in _NAMES]
    if unknown or not wanted:
        raise ValueError(f"unknown columns {unknown}; known: {', '.join(_NAMES)}")
    at = [_NAMES.index(x) for x in wanted]
    options = {"extended": _constant(extended, "extended", False), "smart": _constant(smart, "smart", False)}
    return Plan(schema=StructType(before + [NODE[i] for i in at]), at=at, kinds=frozenset(_names(_constant(kinds, "kinds", ""))), options=options)


def _rows(text: str | None, plan: Plan):
    for row in rows_of(tree_of(text, **plan.options)):
        if not plan.kinds or row[_KIND] in plan.kinds:
            yield tuple(row[i] for i in plan.at)


class MdNodes:
    """md_nodes(text, kinds, columns, extended, smart): the nodes of one text; a null text is an empty document."""

    def __init__(self, plan: Plan):
        self.plan = plan

    @staticmethod
    def analyze(text: AnalyzeArgument, kinds: AnalyzeArgument = None, columns: AnalyzeArgument = None, extended: AnalyzeArgument = None, smart: AnalyzeArgument = None) -> Plan:
        if text.isTable:
            raise ValueError("md_nodes takes a text; md_assembled takes a table")
        return _plan([], kinds, columns, extended, smart)

    def eval(self, text: str, kinds=None, columns=None, extended=None, smart=None):
        yield from _rows(text, self.plan)


class MdAssembled:
    """md_assembled(TABLE(key, text) PARTITION BY key ORDER BY ...): the nodes of the document that a partition's texts make, a blank line between them.

    One partition's texts are held at a time.  Null texts are left out.
    """

    def __init__(self, plan: Plan):
        self.plan, self.key, self.texts = plan, None, []

    @staticmethod
    def analyze(rows: AnalyzeArgument, kinds: AnalyzeArgument = None, columns: AnalyzeArgument = None, extended: AnalyzeArgument = None, smart: AnalyzeArgument = None) -> Plan:
        if not rows.isTable or len(rows.dataType.fields) < 2:
            raise ValueError("md_assembled takes a table of a key and a text")
        return _plan([rows.dataType.fields[0]], kinds, columns, extended, smart)

    def eval(self, row, kinds=None, columns=None, extended=None, smart=None):
        self.key = row[0]
        if row[1] is not None:
            self.texts.append(row[1])

    def terminate(self):
        for row in _rows("\n\n".join(self.texts), self.plan):
            yield (self.key, *row)


class MdCells:
    """md_cells(text): (table, row, col, header, cell) of every cell of every table of a text, the cells' plain text."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(CELL)

    def eval(self, text: str):
        table = row = -1
        for r in rows_of(tree_of(text)):
            kind, at = r[_KIND], dict(zip(_NAMES, r, strict=True))
            if kind == "table":
                table, row = table + 1, -1
            elif kind == "table_row" and not at["header_end"]:
                row += 1
            elif kind == "table_cell":
                yield table, row, at["sibling_ord"], row == 0, at["text_content"]


FUNCTIONS = {"md_nodes": MdNodes, "md_assembled": MdAssembled, "md_cells": MdCells}


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session; again is harmless."""
    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls))

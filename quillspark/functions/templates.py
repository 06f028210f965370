"""Text templates compiled to column expressions on the driver; rendering is generated code.

Syntax: ``${name}``, ``${name:default}``, ``$if(cond)$ .. $else$ .. $endif$``,
``$ifnot(name)$``, ``$for(list)$ .. $sep$ .. $endfor$``, ``$partial(name)$`` and
``$--`` comments to the end of the line.  A condition is a name, or a name and
a value with ``==  !=  >  <``; order compares as numbers and is false where
either side is none.  A value holds when it is not empty, ``false`` or ``0``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\$\{(?P<var>[\w.-]+)(?::(?P<default>[^}]*))?\}|\$(?P<tag>if|ifnot|for|partial)\((?P<arg>[^)]*)\)\$|\$(?P<end>else|endif|endfor|sep)\$|\$--[^\n]*\n?")
_COMPARE = re.compile(r"\s*([\w.-]+)\s*(==|!=|>|<)\s*\"?([^\"]*?)\"?\s*$")


class TemplateError(ValueError):
    """A template that does not parse."""


def parse(source: str) -> list:
    """Parts: text, ("var", name, default), ("if", cond, then, else), ("for", name, body, sep), ("partial", name)."""
    root: list = []
    stack: list[tuple[str, str, list[list]]] = []
    here, at = root, 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            here.append(source[at : m.start()])
        at = m.end()
        tag, end = m["tag"], m["end"]
        if m["var"]:
            here.append(("var", m["var"], m["default"]))
        elif tag == "partial":
            here.append(("partial", m["arg"].strip()))
        elif tag:
            stack.append((tag, m["arg"].strip(), [here, [], []]))
            here = stack[-1][2][1]
        elif end in ("else", "sep"):
            if not stack or (end == "sep") != (stack[-1][0] == "for"):
                raise TemplateError(f"${end}$ out of place")
            here = stack[-1][2][2]
        elif end:
            if not stack or (end == "endfor") != (stack[-1][0] == "for"):
                raise TemplateError(f"${end}$ out of place")
            kind, arg, (outer, body, other) = stack.pop()
            outer.append(("if", arg, other, body) if kind == "ifnot" else (kind, arg, body, other))
            here = outer
    if stack:
        raise TemplateError(f"${stack[-1][0]}$ is not closed")
    if at < len(source):
        here.append(source[at:])
    return root


def holds(c: Column) -> Column:
    return F.coalesce((c != "") & (c != "false") & (c != "0"), F.lit(False))


def render(source: str, values: Mapping[str, Column], lists: Mapping[str, Column] | None = None, partials: Mapping[str, str] | None = None) -> Column:
    """The template over string columns; ``lists`` are arrays of string maps whose keys are names inside ``$for$``."""
    lists, partials = lists or {}, partials or {}

    def condition(text: str, scope) -> Column:
        m = _COMPARE.match(text)
        if not m:
            return holds(scope(text))
        left, op, right = scope(m[1]), m[2], m[3]
        if op in ("==", "!="):
            same = F.coalesce(left, F.lit("")) == right
            return same if op == "==" else ~same
        a, b = left.try_cast("double"), F.lit(right).try_cast("double")
        return F.coalesce(a > b if op == ">" else a < b, F.lit(False))

    def each(body: list, scope, depth: int):
        return lambda item: build(body, lambda n: F.coalesce(item[n], scope(n)), depth)

    def build(parts: list, scope, depth: int = 0) -> Column:
        if depth > 20:
            raise TemplateError("partials nest too deep")
        out = []
        for p in parts:
            if isinstance(p, str):
                out.append(F.lit(p))
            elif p[0] == "var":
                v = scope(p[1])
                out.append(F.coalesce(F.when(v != "", v), F.lit(p[2] or "")))
            elif p[0] == "partial":
                if p[1] not in partials:
                    raise TemplateError(f"unknown partial {p[1]!r}")
                out.append(build(parse(partials[p[1]]), scope, depth + 1))
            elif p[0] == "if":
                out.append(F.when(condition(p[1], scope), build(p[2], scope, depth)).otherwise(build(p[3], scope, depth)))
            else:
                if p[1] not in lists:
                    continue
                out.append(F.array_join(F.transform(lists[p[1]], each(p[2], scope, depth)), "".join(x for x in p[3] if isinstance(x, str))))
        return F.concat(*out) if out else F.lit("")

    return build(parse(source), lambda n: values[n] if n in values else F.lit(None).cast("string"))

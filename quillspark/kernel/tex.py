"""TeX tokens with positions."""

from __future__ import annotations

import re

_TOKENS = re.compile(r"(?P<control>\\(?:[A-Za-z][A-Za-z0-9]*|[\s\S])?)|(?P<comment>%[^\r\n]*)|(?P<newline>[\r\n])|(?P<space> +|\t)|(?P<word>[A-Za-z][A-Za-z'-]*)|(?P<one>[\s\S])")
# Fixed names: what single characters are, and category codes by token type.
SINGLE = {"{": "group start", "}": "group end", "$": "math shift", "&": "alignment tab", "#": "parameter", "^": "superscript", "_": "subscript", "~": "active character"}
CATCODES = {"group start": 1, "group end": 2, "math shift": 3, "alignment tab": 4, "newline": 5, "parameter": 6, "superscript": 7, "subscript": 8, "whitespace": 10, "word": 11, "symbol": 12, "active character": 13, "comment": 14}


_KINDS = {"control": "control sequence", "comment": "comment", "newline": "newline", "space": "whitespace", "word": "word"}


def tokenize(text: str) -> list[tuple[str, str, int, int]]:
    """(type, literal, line, column), lines and columns from 1, an EOF token last."""
    out, line, start = [], 1, 0
    for m in _TOKENS.finditer(text):
        kind, s = m.lastgroup, m[0]
        name = _KINDS.get(kind) or SINGLE.get(s, "symbol")
        literal = s[1:] if kind in ("control", "comment") else "\n" if kind == "newline" else s
        out.append((name, literal, line, m.start() - start + 1))
        if "\n" in s:  # a token holds one line end at most
            line, start = line + 1, m.start() + s.index("\n") + 1
    out.append(("EOF", "", line, len(text) - start + 1))
    return out

"""Rows of pipe tables."""

from __future__ import annotations

import re

_DASHES = re.compile(r":?-{3,}:?$")


def split_row(line: str) -> list[str]:
    """Cells of a line: outer pipes go, every other pipe splits, cells are trimmed."""
    line = line.strip()
    line = line.removeprefix("|")
    line = line.removesuffix("|")
    return [x.strip() for x in line.split("|")]


def is_delimiter_row(line: str) -> bool:
    line = line.strip()
    if "|" not in line or line.strip("|:- \t"):
        return False
    return all(_DASHES.match(x) for x in split_row(line))


def alignment_of(cell: str) -> str:
    cell = cell.strip()
    left, right = cell.startswith(":"), cell.endswith(":")
    return "center" if left and right else "left" if left else "right" if right else "none"


def alignments_of(line: str) -> list[str]:
    return [alignment_of(x) for x in split_row(line)]

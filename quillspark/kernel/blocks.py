"""Block structure: a fold over lines that keeps a path of open containers.

A line first tries to continue the open path from the root, then opens new
blocks at the point where it stopped, and what is left is text.  Columns are
tracked through a cursor that expands tabs to stops of four.
"""

from __future__ import annotations

import re

from .inlines import RefMap, parse_inlines, take_definitions, unescape
from .tables import alignments_of, is_delimiter_row, split_row
from .tree import Node

# Fixed list: names that start an HTML block of the sixth kind.
BLOCK_TAGS = set(
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section source summary table tbody td tfoot th thead title tr track ul".split()
)
_ATTR = r"""\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?"""
_TAG7 = re.compile(rf"(?:<[A-Za-z][A-Za-z0-9-]*(?:{_ATTR})*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$")
_HTML_OPEN = [re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"<!--"), re.compile(r"<\?"), re.compile(r"<![A-Za-z]"), re.compile(r"<!\[CDATA\[")]
_HTML_CLOSE = [re.compile(r"</(?:script|pre|style|textarea)>", re.I), re.compile(r"-->"), re.compile(r"\?>"), re.compile(r">"), re.compile(r"\]\]>")]
_TAG6 = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s|/?>|$)")
_ATX = re.compile(r"(#{1,6})(?:[ \t]+|$)")
_SETEXT = re.compile(r"(?:=+|-+)[ \t]*$")
_BREAK = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_MARKER = re.compile(r"([*+-])|(\d{1,9})([.)])")
_TASK = re.compile(r"[ \t]*\[[ xX]\](?:[ \t\r\n]|$)")


class Cursor:
    """A position in a line, in characters and in columns."""

    __slots__ = ("s", "i", "col", "rest", "ahead")

    def __init__(self, line: str):
        self.s, self.i, self.col, self.rest = line, 0, 0, 0  # rest: columns left of a partly used tab
        self.ahead: tuple[int, int] | None = None  # what peek found, until it is eaten

    def peek(self) -> tuple[int, int]:
        """(index, column) of the next character that is no blank; blanks are walked once, however many blocks look at them."""
        if self.ahead is not None:
            return self.ahead
        i, col = self.i, self.col
        if self.rest:
            i, col = i + 1, col + self.rest
        s = self.s
        while i < len(s):
            if s[i] == " ":
                col += 1
            elif s[i] == "\t":
                col += 4 - col % 4
            else:
                break
            i += 1
        self.ahead = i, col
        return self.ahead

    def indent(self) -> int:
        return self.peek()[1] - self.col

    def blank(self) -> bool:
        return self.peek()[0] >= len(self.s)

    def skip(self, columns: int) -> None:
        """Go on by so many columns of blanks, splitting a tab where needed."""
        while columns > 0 and self.i < len(self.s):
            if self.rest:
                step = min(self.rest, columns)
                self.rest -= step
                self.col += step
                columns -= step
                if not self.rest:
                    self.i += 1
            elif self.s[self.i] == "\t":
                self.rest = 4 - self.col % 4
            elif self.s[self.i] == " ":
                self.i, self.col, columns = self.i + 1, self.col + 1, columns - 1
            else:
                break

    def to_text(self) -> None:
        self.i, self.col = self.peek()
        self.rest = 0

    def eat(self, chars: int) -> None:
        self.i, self.col, self.ahead = self.i + chars, self.col + chars, None

    def eat_space(self) -> None:
        if self.rest or (self.i < len(self.s) and self.s[self.i] in " \t"):
            self.skip(1)

    def tail(self) -> str:
        return " " * self.rest + self.s[self.i + 1 :] if self.rest else self.s[self.i :]


class Document:
    def __init__(self, smart: bool = False, shortcodes: dict[str, str] | None = None):
        self.root = Node("document", at={"open": True}, pos=(1, 0, 1, 0))
        self.refs: RefMap = {}
        self.smart, self.shortcodes = smart, shortcodes or {}
        self.line_no = 0
        self.tip = self.root
        self.last_len = 0

    # -- the fold --------------------------------------------------------

    def feed(self, line: str) -> None:
        self.line_no += 1
        c = Cursor(line)
        at, matched = self.root, True
        while at.children and at.children[-1].at.get("open"):
            child = at.children[-1]
            go = self._continues(child, c)
            if go == "done":
                self.last_len = len(line)
                return
            if not go:
                matched = False
                break
            at = child
        old_tip, lazy = self.tip, self.tip.kind == "paragraph"
        fresh = at
        if at.kind not in ("code_block", "html_block"):
            fresh = self._open_blocks(at, c, matched, lazy)
        if fresh is not None:
            self._text(fresh, at, c, matched, old_tip)
        self.last_len = len(line)

    def _continues(self, node: Node, c: Cursor):
        kind, at = node.kind, node.at
        i, _ = c.peek()
        indent, blank = c.indent(), i >= len(c.s)
        if kind == "block_quote":
            if indent <= 3 and not blank and c.s[i] == ">":
                c.to_text()
                c.eat(1)
                c.eat_space()
                return True
            return False
        if kind == "item":
            if blank:
                if not node.children:
                    return False
                c.to_text()
                return True
            if indent >= at["marker_offset"] + at["padding"]:
                c.skip(at["marker_offset"] + at["padding"])
                return True
            return False
        if kind == "list":
            return True
        if kind == "code_block":
            if at["fenced"]:
                if indent <= 3 and not blank and c.s[i] == at["fence_char"]:
                    m = re.compile(re.escape(at["fence_char"]) + r"{%d,}[ \t]*$" % at["fence_length"]).match(c.s, i)
                    if m:
                        self._close(node, self.line_no, len(c.s))
                        return "done"
                c.skip(min(indent, at["fence_offset"]))
                return True
            if indent >= 4:
                c.skip(4)
                return True
            if blank:
                c.to_text()
                return True
            return False
        if kind == "html_block":
            return not (blank and at["html_type"] >= 6)
        if kind == "paragraph":
            return not blank
        if kind == "table":
            return not blank and "|" in c.s[i:]
        return False

    def _open_blocks(self, at: Node, c: Cursor, matched: bool, lazy: bool) -> Node | None:
        while True:
            i, _ = c.peek()
            indent = c.indent()
            if i >= len(c.s) or at.kind == "table":
                return at
            rest = c.s[i:]
            in_paragraph = at.kind == "paragraph"
            if indent >= 4:
                if not in_paragraph and not (lazy and not matched) and at.kind in ("document", "block_quote", "item"):
                    c.skip(4)
                    return self._new(at, Node("code_block", at={"fenced": False, "info": "", "lines": []}), c)
                if not (at.kind == "list" and _MARKER.match(rest)):
                    return at
                return at
            first = rest[0]
            if first == ">":
                c.to_text()
                at = self._new(at, Node("block_quote"), c)
                c.eat(1)
                c.eat_space()
            elif first == "#" and (m := _ATX.match(rest)):
                c.to_text()
                node = self._new(at, Node("heading", at={"level": len(m[1]), "setext": False}), c)
                content = rest[m.end() :].rstrip(" \t")
                content = re.sub(r"(?:^|[ \t]+)#+$", "", content)
                node.at["lines"] = [content.strip(" \t")]
                self._close(node, self.line_no, len(c.s))
                return None
            elif first in "`~" and (m := _FENCE.match(rest)):
                c.to_text()
                fence, info = m[1] or m[3], m[2] if m[1] else m[4]
                self._new(at, Node("code_block", at={"fenced": True, "fence_char": fence[0], "fence_length": len(fence), "fence_offset": indent, "info": unescape(info.strip()), "lines": []}), c)
                return None
            elif first == "<" and (kind := self._html_kind(rest, in_paragraph or (lazy and not matched))):
                return self._new(at, Node("html_block", at={"html_type": kind, "lines": []}), c)
            elif in_paragraph and matched_here(at) and first in "=-" and _SETEXT.match(rest) and self._setext(at, first, c):
                return None
            elif _BREAK.match(rest):
                c.to_text()
                node = self._new(at, Node("thematic_break", at={"mark": first * 3}), c)
                self._close(node, self.line_no, len(c.s))
                return None
            elif (marker := self._marker(at, c, rest, in_paragraph)) is not None:
                at = marker
            elif in_paragraph and self._table(at, rest):
                return None
            else:
                return at

    def _html_kind(self, rest: str, soft: bool) -> int:
        for k, pattern in enumerate(_HTML_OPEN, 1):
            if pattern.match(rest):
                return k
        m = _TAG6.match(rest)
        if m and m[1].lower() in BLOCK_TAGS:
            return 6
        return 7 if not soft and _TAG7.match(rest) else 0

    def _setext(self, para: Node, mark: str, c: Cursor) -> bool:
        text, left = "\n".join(para.at["lines"]), None
        left = take_definitions(text, self.refs)
        if not left.strip():
            para.at["lines"] = []
            return False
        para.kind = "heading"
        para.at |= {"level": 1 if mark == "=" else 2, "setext": True, "lines": left.split("\n")}
        self._close(para, self.line_no, len(c.s))
        return True

    def _marker(self, at: Node, c: Cursor, rest: str, in_paragraph: bool) -> Node | None:
        m = _MARKER.match(rest)
        if not m:
            return None
        after = rest[m.end() :]
        if after and after[0] not in " \t":
            return None
        if in_paragraph and (not after.strip() or (m[2] and int(m[2]) != 1)):
            return None
        offset = c.indent()
        c.to_text()
        begin = c.col
        c.eat(m.end())
        blank = not after.strip()
        gap = c.indent()
        if blank or gap > 4 or gap < 1:
            padding = m.end() + 1
            if not blank:
                c.skip(1)
        else:
            padding = m.end() + gap
            c.skip(gap)
        data = {"list_type": "bullet" if m[1] else "ordered", "list_start": int(m[2]) if m[2] else 1, "delimiter": "paren" if m[3] == ")" else "period", "bullet": m[1] or "", "marker_offset": offset, "padding": padding}
        same = at.kind == "list" and (at.at["list_type"], at.at["bullet"], at.at["delimiter"]) == (data["list_type"], data["bullet"], data["delimiter"])
        where = c.i - (c.col - begin) if not c.rest else c.i
        if not same:
            at = self._new(at, Node("list", at=data | {"tight": True, "is_task_list": False}), c, max(0, where))
        item = self._new(at, Node("item", at=dict(data)), c, max(0, where))
        if _TASK.match(c.tail()):
            item.at["is_task_list"] = at.at["is_task_list"] = True
        return item

    def _table(self, para: Node, rest: str) -> bool:
        header = "\n".join(para.at["lines"])
        if "|" not in header or not is_delimiter_row(rest):
            return False
        cells = split_row(header)
        align = alignments_of(rest)[: len(cells)]
        align += ["none"] * (len(cells) - len(align))
        para.kind = "table"
        para.at = {"open": True, "alignments": align, "num_columns": len(cells), "header_end": False}
        head = para.add(Node("table_row", at={"header_end": False}, pos=(para.pos[0], para.pos[1], self.line_no - 1, 0)))
        for x in cells:
            self._cell(head, x)
        para.add(Node("table_row", at={"header_end": True}, pos=(self.line_no, 0, self.line_no, len(rest))))
        self.tip = para
        return True

    def _cell(self, row: Node, text: str) -> None:
        cell = row.add(Node("table_cell", pos=row.pos))
        if text:
            cell.add(Node("text", literal=text))

    # -- text ------------------------------------------------------------

    def _text(self, node: Node, matched_to: Node, c: Cursor, matched: bool, old_tip: Node) -> None:
        blank = c.blank()
        if not matched and node is matched_to and old_tip.kind == "paragraph" and old_tip.at.get("open") and not blank:
            c.to_text()
            old_tip.at["lines"].append(c.tail())  # a lazy line
            self.tip = old_tip
            return
        self._close_below(node)
        self.tip = node
        if node.kind == "code_block":
            if node.at["fenced"] or not blank:
                node.at["lines"].append(c.tail())
            else:
                node.at["lines"].append(c.tail() if c.indent() or c.tail() else "")
            return
        if node.kind == "html_block":
            node.at["lines"].append(c.tail())
            k = node.at["html_type"]
            if k <= 5 and _HTML_CLOSE[k - 1].search(c.tail()):
                self._close(node, self.line_no, len(c.s))
            return
        if node.kind == "table":
            row = node.add(Node("table_row", at={"header_end": False}, pos=(self.line_no, 0, self.line_no, len(c.s))))
            for x in split_row(c.s[c.peek()[0] :]):
                self._cell(row, x)
            return
        if blank:
            # a blank line parts the blocks around it
            if node.children:
                node.children[-1].at["blank_after"] = True
            elif node.kind == "item" and node.pos[0] != self.line_no:
                node.at["blank_after"] = True
            return
        c.to_text()
        if node.kind == "paragraph":
            node.at["lines"].append(c.tail())
        else:
            self._new(node, Node("paragraph", at={"lines": [c.tail()]}), c)

    # -- opening and closing ----------------------------------------------

    def _new(self, parent: Node, node: Node, c: Cursor, column: int | None = None) -> Node:
        self._close_below(parent)
        while parent.kind in ("paragraph", "heading", "table", "code_block", "html_block", "thematic_break") or (parent.kind == "list" and node.kind != "item"):
            up = parent.parent
            self._close(parent)
            parent = up
        col = c.peek()[0] if column is None else column
        node.pos = (self.line_no, col, self.line_no, len(c.s))
        node.at["open"] = True
        parent.add(node)
        self.tip = node
        return node

    def _close_below(self, node: Node) -> None:
        path = []
        while node.children and node.children[-1].at.get("open"):
            node = node.children[-1]
            path.append(node)
        for x in reversed(path):
            self._finish_block(x)

    def _close(self, node: Node, line: int | None = None, column: int | None = None) -> None:
        self._close_below(node)
        self._finish_block(node, line, column)

    def _finish_block(self, node: Node, line: int | None = None, column: int | None = None) -> None:
        if not node.at.pop("open", False):
            return
        line = self.line_no - 1 if line is None else line
        column = self.last_len if column is None else column
        node.pos = (*node.pos[:2], max(line, node.pos[0]), column)
        kind = node.kind
        if kind == "paragraph":
            left = take_definitions("\n".join(node.at["lines"]), self.refs)
            if left.strip():
                node.at["lines"] = left.split("\n")
            else:
                self.tip = node.parent
                if node.at.get("blank_after") and len(node.parent.children) > 1:
                    node.parent.children[-2].at["blank_after"] = True
                node.cut()
                return
        elif kind == "code_block":
            lines = node.at.pop("lines")
            if not node.at["fenced"]:
                while lines and not lines[-1].strip(" \t"):
                    lines.pop()
            node.literal = "".join(x + "\n" for x in lines)
        elif kind == "html_block":
            lines = node.at.pop("lines")
            while lines and not lines[-1].strip():
                lines.pop()
            node.literal = "\n".join(lines)
        elif kind == "list":
            node.at["tight"] = _tight(node)
        if self.tip is node:
            self.tip = node.parent or node

    def finish(self) -> Node:
        self.line_no += 1
        self._close(self.root)
        from .tree import INLINE_HOLDERS, walk

        for node in [n for n in walk(self.root) if n.kind in INLINE_HOLDERS]:
            lines = node.at.pop("lines", [])
            parse_inlines(node, "\n".join(lines).strip(), self.refs, self.smart, self.shortcodes)
        return self.root


def matched_here(node: Node) -> bool:
    return bool(node.at.get("open")) and bool(node.at.get("lines"))


def _ends_blank(node: Node) -> bool:
    while not node.at.get("blank_after"):
        if node.kind not in ("list", "item") or not node.children:
            return False
        node = node.children[-1]
    return True


def _tight(lst: Node) -> bool:
    for k, item in enumerate(lst.children):
        last_item = k == len(lst.children) - 1
        if not last_item and _ends_blank(item):
            return False
        if any(_ends_blank(x) for x in item.children[: -1 if last_item else None]):
            return False
    return True


def parse(text: str, *, smart: bool = False, shortcodes: dict[str, str] | None = None) -> Node:
    """The tree of a Markdown text; total on all inputs."""
    doc = Document(smart, shortcodes)
    text = text.removeprefix("﻿").replace("\0", "�")
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    for line in lines:
        doc.feed(line.removesuffix("\r"))
    return doc.finish()

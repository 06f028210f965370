"""The document tree, and its flattening to rows."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field
from typing import Any

# Fixed vocabularies of the node table.
BLOCKS = {"document", "block_quote", "list", "item", "code_block", "html_block", "paragraph", "heading", "thematic_break", "table", "table_row", "table_cell", "task_item", "footnote_definition"}
LEAVES = {"text", "softbreak", "linebreak", "code", "html_inline", "code_block", "html_block", "thematic_break", "math", "shortcode", "footnote_reference"}
#: Kinds that hold inline content.
INLINE_HOLDERS = {"paragraph", "heading"}


@dataclass(eq=False, slots=True)
class Node:
    kind: str
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    literal: str | None = None
    at: dict[str, Any] = field(default_factory=dict)
    pos: tuple[int, int, int, int] = (0, 0, 0, 0)

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def cut(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None


def walk(root: Node):
    """All nodes in document order, without recursion."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(node.children))


def events(root: Node):
    """(entering, node) pairs; leaves enter and leave as well."""
    stack = [(True, root)]
    while stack:
        entering, node = stack.pop()
        yield entering, node
        if entering:
            stack.append((False, node))
            stack.extend((True, c) for c in reversed(node.children))


def text_of(node: Node, breaks: str = "") -> str:
    """Concatenated text literals below a node; ``breaks`` stands for each line break."""
    out = []
    for n in walk(node):
        if n.kind == "text":
            out.append(n.literal or "")
        elif breaks and n.kind in ("softbreak", "linebreak"):
            out.append(breaks)
    return "".join(out)


#: Columns of a node row, in order, with their Spark types.
FIELDS = [
    ("node_id", "int"), ("parent_id", "int"), ("sibling_ord", "int"), ("depth", "int"), ("subtree_end", "int"), ("kind", "string"), ("is_block", "boolean"), ("is_leaf", "boolean"),
    ("literal", "string"), ("text_content", "string"), ("text_alt", "string"), ("level", "int"), ("setext", "boolean"), ("list_type", "string"), ("list_start", "int"), ("delimiter", "string"),
    ("bullet", "string"), ("tight", "boolean"), ("is_task_list", "boolean"), ("marker_offset", "int"), ("padding", "int"), ("info", "string"), ("fenced", "boolean"), ("fence_char", "string"),
    ("fence_length", "int"), ("html_type", "int"), ("url", "string"), ("title", "string"), ("num_backticks", "int"), ("alignments", "array<string>"), ("num_columns", "int"), ("header_end", "boolean"),
    ("display_math", "boolean"), ("code", "string"), ("emoji", "string"), ("footnote_name", "string"), ("checked", "boolean"), ("start_line", "int"), ("start_col", "int"), ("end_line", "int"), ("end_col", "int"),
]
_POS = len(FIELDS) - 4  #: where the places in the source begin
#: Kinds whose text is kept in the row, so that no query has to gather a subtree.
_TITLED = {"heading", "link", "image", "item", "paragraph", "table_cell", "block_quote"}


def rows_of(root: Node, keep: Collection[int] | None = None, kinds: Collection[str] = ()) -> list[tuple]:
    """One tuple of FIELDS for each node, pre-order; [node_id, subtree_end] is the subtree.

    With ``keep`` only the fields of those places, with ``kinds`` only nodes of
    those are made; texts are gathered where they are kept alone.
    """
    keep = range(len(FIELDS)) if keep is None else keep
    plain, titled = 9 in keep, 10 in keep
    own = [FIELDS[i][0] if i < _POS else i - _POS for i in keep if i >= 11]
    head = [i for i in keep if i < 11]
    if [*keep] != sorted(set(keep)):
        raise ValueError("the fields of a row are kept in order")
    gather = plain or titled
    nodes: list[Node] = []
    rows: list[list] = []
    ids: list[int] = []
    texts: list[list[str]] = [[], []]
    marks: list[tuple[int, int]] = []
    ordinal = [0]
    count = 0
    stack: list[tuple[Node, list | None]] = [(root, None)]
    while stack:
        n, row = stack.pop()
        kind = n.kind
        if row is None:
            row = [count, ids[-1] if ids else None, ordinal[-1], len(ids), count, kind, kind in BLOCKS, kind in LEAVES, n.literal, None, None]
            count += 1
            ordinal[-1] += 1
            if not kinds or kind in kinds:
                nodes.append(n)
                rows.append(row)
            if gather and kind == "text":
                texts[0].append(n.literal or "")
                texts[1].append(n.literal or "")
            elif gather and kind in ("softbreak", "linebreak"):
                texts[1].append(" ")
            if n.children:
                ids.append(row[0])
                ordinal.append(0)
                marks.append((len(texts[0]), len(texts[1])))
                stack.append((n, row))
                stack.extend([(c, None) for c in reversed(n.children)])
            elif kind in _TITLED:
                row[9] = row[10] = ""
        else:
            ids.pop()
            ordinal.pop()
            a, b = marks.pop()
            row[4] = count - 1
            if gather and kind in _TITLED and (not kinds or kind in kinds):
                row[9] = "".join(texts[0][a:]) if plain else None
                row[10] = "".join(texts[1][b:]) if titled else None
    return [(*[row[i] for i in head], *[n.at.get(k) if type(k) is str else n.pos[k] for k in own]) for n, row in zip(nodes, rows, strict=True)]

"""The extended profile: task items, strikethrough, bare autolinks and footnotes applied to a parsed tree."""

from __future__ import annotations

import re
from collections.abc import Collection

from .tree import Node, walk

_TASK = re.compile(r"^\[([ xX])\](?:\s+|$)")
_STRUCK = re.compile(r"(?<!~)~~(?!~)(.+?)(?<!~)~~(?!~)")
_BARE = re.compile(r"https?://[^\s<>\[\]()]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_NOTE = re.compile(r"\[\^([^\]\s]+)\](?!:)")
_DEFINITION = re.compile(r"^\[\^([^\]\s]+)\]:\s*")


def _split(node: Node, pattern: re.Pattern, make) -> None:
    """Replace matches inside a text node by what ``make`` returns."""
    text, at, out = node.literal, 0, []
    for m in pattern.finditer(text):
        made = make(m)
        if made is None:
            continue
        new, end = made
        if m.start() > at:
            out.append(Node("text", literal=text[at : m.start()]))
        out.append(new)
        at = end
    if not out:
        return
    if at < len(text):
        out.append(Node("text", literal=text[at:]))
    k = node.parent.children.index(node)
    for n in out:
        n.parent = node.parent
    node.parent.children[k : k + 1] = out


def _link(m: re.Match):
    found = m[0].rstrip(".!?,:;")
    if not found:
        return None
    url = "mailto:" + found if "@" in found and "://" not in found else found
    link = Node("link", at={"url": url, "title": ""})
    link.add(Node("text", literal=found))
    return link, m.start() + len(found)


def _strike(m: re.Match):
    node = Node("strikethrough")
    node.add(Node("text", literal=m[1]))
    return node, m.end()


#: What :func:`extend` can add to a tree, each on its own.
EXTENSIONS = ("tasklist", "footnotes", "strikethrough", "autolink")


def extend(root: Node, extensions: Collection[str] = EXTENSIONS) -> Node:
    """Apply extensions to a parsed tree: task markers, notes and their references, struck text, bare links."""
    unknown = set(extensions) - set(EXTENSIONS)
    if unknown:
        raise ValueError(f"unknown extensions {sorted(unknown)}; known: {', '.join(EXTENSIONS)}")
    notes = "footnotes" in extensions
    for item in [n for n in walk(root) if n.kind == "item" and "tasklist" in extensions]:
        para = item.children[0] if item.children else None
        first = para.children[0] if para is not None and para.kind == "paragraph" and para.children else None
        if first is not None and first.kind == "text" and (m := _TASK.match(first.literal)):
            first.literal = first.literal[m.end() :]
            item.at["checked"] = m[1] != " "
    for para in [n for n in walk(root) if n.kind == "paragraph" and notes]:
        first = para.children[0] if para.children else None
        if first is not None and first.kind == "text" and (m := _DEFINITION.match(first.literal)) and para.parent is not None:
            first.literal = first.literal[m.end() :]
            k = para.parent.children.index(para)
            note = Node("footnote_definition", parent=para.parent, at={"footnote_name": m[1]}, pos=para.pos)
            para.parent.children[k] = note
            note.add(para)
    for name, pattern, make in (("footnotes", _NOTE, lambda m: (Node("footnote_reference", at={"footnote_name": m[1]}), m.end())), ("strikethrough", _STRUCK, _strike), ("autolink", _BARE, _link)):
        if name not in extensions:
            continue
        for node in [n for n in walk(root) if n.kind == "text" and n.parent is not None and n.parent.kind not in ("link", "image")]:
            _split(node, pattern, make)
    return root

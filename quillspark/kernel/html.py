"""Trees as HTML, built from the leaves up.

A first pass over the tree says in which surroundings every node stands; a
second one, in reverse, makes the text of a node from the texts of its
children.  What parts two blocks follows from their place alone.
"""

from __future__ import annotations

from ..functions.scalars import escape_href, escape_html, filter_html
from .tree import Node, text_of, walk

#: Inline kinds that put plain tags around their content.
_TAGS = {"emph": "em", "strong": "strong", "strikethrough": "del"}
#: Blocks that stand on a line of their own.
_OWN_LINE = {"block_quote", "code_block", "html_block", "thematic_break"}


def _has_text(block: Node) -> bool:
    """Whether text is visible in the block; the description of an image is not."""
    todo = [block]
    while todo:
        n = todo.pop()
        if n.kind == "text":
            return True
        todo += () if n.kind == "image" else n.children
    return False


def _fills(block: Node) -> bool:
    """Whether a block of a tight item makes the next one start a line lower."""
    return block.kind in _OWN_LINE or block.kind == "heading" or (block.kind in ("paragraph", "table") and _has_text(block))


class Html:
    """Writer of one tree; ``unsafe`` passes HTML blocks unfiltered, ``sourcepos`` marks block positions."""

    def __init__(self, unsafe: bool = False, sourcepos: bool = False):
        self.unsafe, self.sourcepos = unsafe, sourcepos
        self.notes: dict[str, Node] = {}
        self.used: list[str] = []

    def render(self, root: Node) -> str:
        self.notes = {n.at["footnote_name"]: n for n in walk(root) if n.kind == "footnote_definition"}
        body = self.blocks(root.children, "")
        notes, done = [], 0
        while done < len(self.used):  # a note can refer to another
            name = escape_html(self.used[done])
            back = f' <a href="#fnref-{name}" class="footnote-backref">↩</a></li>\n'
            notes.append(self.blocks(self.notes[self.used[done]].children, f'<li id="fn-{name}">\n') + back)
            done += 1
        if notes:
            line = "" if body.endswith("\n") or not body else "\n"
            body += line + '<section class="footnotes">\n<ol>\n' + "".join(notes) + "</ol>\n</section>\n"
        return body.rstrip("\n")

    def blocks(self, nodes: list[Node], opening: str) -> str:
        """The texts of sibling blocks behind ``opening``."""
        tight: dict[Node, bool] = {}
        in_item: dict[Node, bool] = {}
        order: list[Node] = []
        todo = [(n, False, False) for n in reversed(nodes)]
        while todo:
            n, is_tight, inside = todo.pop()
            if n.kind == "footnote_definition":
                continue
            order.append(n)
            tight[n], in_item[n] = is_tight, inside
            if n.kind == "footnote_reference" and n.at["footnote_name"] in self.notes and n.at["footnote_name"] not in self.used:
                self.used.append(n.at["footnote_name"])
            if n.kind in ("list", "block_quote"):
                is_tight = n.kind == "list" and n.at["tight"]
            inside = inside or n.kind == "item"
            todo += [] if n.kind == "image" else [(c, is_tight, inside) for c in reversed(n.children)]
        made: dict[Node, str] = {}
        for n in reversed(order):
            made[n] = self.one(n, tight, in_item, made)
        return self.joined(nodes, opening, tight, in_item, made)

    def joined(self, nodes: list[Node], opening: str, tight: dict, in_item: dict, made: dict) -> str:
        """Sibling blocks behind ``opening``, each where its kind and place put it."""
        out, filled = [opening], False
        ends_line = opening.endswith("\n") or not opening
        for n in nodes:
            if n not in made:
                continue
            lead = ""
            if n.kind == "heading":
                lead = "\n" if in_item[n] else ""
            elif n.kind in _OWN_LINE and tight[n] and filled:
                lead = "\n"
            elif n.kind in _OWN_LINE or n.kind == "list":
                lead = "" if ends_line else "\n"
            text = lead + made[n]
            out.append(text)
            ends_line = text.endswith("\n") if text else ends_line
            filled = filled or _fills(n)
        return "".join(out)

    def one(self, n: Node, tight: dict, in_item: dict, made: dict) -> str:
        """The text of a node whose children are made."""
        kind, at = n.kind, n.at
        pos = ' data-sourcepos="%d:%d-%d:%d"' % n.pos if self.sourcepos and n.pos[0] else ""
        if kind == "text":
            return escape_html(n.literal)
        if kind in ("block_quote", "list", "item"):
            if kind == "block_quote":
                start, end = f"<blockquote{pos}>\n", "</blockquote>\n"
            elif kind == "item":
                mark = "" if at.get("checked") is None else '<input type="checkbox" disabled="disabled"' + (' checked="checked"' if at["checked"] else "") + " /> "
                start, end = f"<li{pos}>" + ("\n" if n.children and not tight[n] else "") + mark, "</li>\n"
            else:
                tag = "ul" if at["list_type"] == "bullet" else "ol"
                first = f' start="{at["list_start"]}"' if tag == "ol" and at["list_start"] != 1 else ""
                start, end = f"<{tag}{pos}{first}>\n", f"</{tag}>\n"
            return self.joined(n.children, start, tight, in_item, made) + end
        inner = "".join(made[c] for c in n.children if c in made)
        if kind == "paragraph":
            return inner if tight[n] else f"<p{pos}>{inner}</p>\n"
        if kind == "heading":
            return f"<h{at['level']}{pos}>{inner}</h{at['level']}>\n"
        if kind in _TAGS:
            return f"<{_TAGS[kind]}>{inner}</{_TAGS[kind]}>"
        if kind == "table_cell":
            return inner
        if kind == "table_row":
            cell = "th" if self._in_head(n) else "td"
            return "".join(f"<{cell}>{made[c]}</{cell}>\n" for c in n.children)
        if kind == "table":
            return "<table>\n<thead>\n" + "".join("</thead>\n<tbody>\n" if r.at["header_end"] else f"<tr>\n{made[r]}</tr>\n" for r in n.children) + "</table>\n"
        if kind in ("link", "image"):
            title = f' title="{escape_html(at["title"])}"' if at["title"] else ""
            if kind == "link":
                return f'<a href="{escape_href(at["url"])}"{title}>{inner}</a>'
            return f'<img src="{escape_href(at["url"])}" alt="{escape_html(text_of(n, " "))}"{title} />'
        if kind == "code_block":
            lang = (at["info"].split() or [""])[0]
            name = f' class="language-{escape_html(lang)}"' if lang else ""
            return f"<pre><code{pos}{name}>{escape_html(n.literal)}</code></pre>\n"
        if kind == "footnote_reference":
            name = escape_html(at["footnote_name"])
            return f'<sup class="footnote-ref"><a href="#fn-{name}" id="fnref-{name}">[{name}]</a></sup>'
        if kind == "math":
            mark = "$$" if at["display_math"] else "$"
            return escape_html(mark + n.literal + mark)
        if kind == "html_block":
            return (n.literal if self.unsafe else filter_html(n.literal)) + "\n"
        if kind == "softbreak":
            return " " if tight[n] else "\n"
        simple = {"thematic_break": f"<hr{pos} />\n", "linebreak": "<br />\n", "code": f"<code>{escape_html(n.literal or '')}</code>", "html_inline": filter_html(n.literal or ""), "shortcode": at.get("emoji") or ""}
        return simple.get(kind, inner)

    @staticmethod
    def _in_head(row: Node) -> bool:
        for r in row.parent.children:
            if r is row or r.at["header_end"]:
                return r is row
        return True


def to_html(root: Node, unsafe: bool = False, sourcepos: bool = False) -> str:
    return Html(unsafe, sourcepos).render(root)

"""Trees as XML, LaTeX, Beamer, Reveal.js pages and BibTeX."""

from __future__ import annotations

from ..functions.scalars import escape_html, escape_latex, escape_xml
from .html import Html, to_html
from .tree import LEAVES, Node, text_of, walk


def to_xml(root: Node, sourcepos: bool = False) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE document SYSTEM "CommonMark.dtd">\n']
    stack: list[tuple[bool, Node]] = [(True, root)]
    while stack:
        entering, n = stack.pop()
        if not entering:
            out.append(f"</{n.kind}>\n")
            continue
        at = n.at
        attrs = ' sourcepos="%d:%d-%d:%d"' % n.pos if sourcepos and n.pos[0] else ""
        if n.kind == "list":
            if at["list_type"] == "bullet":
                attrs += ' type="bullet"'
            else:
                attrs += ' type="ordered"' + (f' start="{at["list_start"]}"' if at["list_start"] != 1 else "") + f' delim="{at["delimiter"]}"'
            attrs += ' tight="true"' if at["tight"] else ""
        elif n.kind == "heading":
            attrs += f' level="{at["level"]}"'
        elif n.kind == "code_block" and at["info"]:
            attrs += f' info="{escape_xml(at["info"])}"'
        elif n.kind in ("link", "image"):
            attrs += f' destination="{escape_xml(at["url"])}"' + (f' title="{escape_xml(at["title"])}"' if at["title"] else "")
        elif n.kind == "shortcode":
            attrs += f' code="{escape_xml(at["code"])}"'
        if n.kind in LEAVES:
            body = n.at.get("emoji") if n.kind == "shortcode" else n.literal
            out.append(f"<{n.kind}{attrs}>{escape_xml(body)}</{n.kind}>" if body else f"<{n.kind}{attrs} />")
        else:
            out.append(f"<{n.kind}{attrs}>\n")
            stack.append((False, n))
            stack.extend((True, c) for c in reversed(n.children))
    return "".join(out)


_SECTIONS = {False: ["section*", "subsection*", "subsubsection*", "paragraph*", "subparagraph*", "paragraph*"], True: ["section", "subsection", "subsubsection", "paragraph", "paragraph", "paragraph"]}
_COLUMN = {"right": "r", "center": "c"}
#: Text before and after the content, by kind.
_AROUND = {"block_quote": ("\\begin{quote}\n", "\\end{quote}\n"), "item": ("\\item ", "\n"), "paragraph": ("", "\n\n"), "emph": ("\\emph{", "}"), "strong": ("\\textbf{", "}"), "strikethrough": ("\\sout{", "}")}
_CONSTANT = {"thematic_break": "\\hrule\n", "softbreak": " ", "linebreak": "\\\\\n"}
#: Blocks after which a block that starts a line of its own is set off by a blank one.
_SETS_OFF = {"block_quote", "list", "heading", "code_block", "thematic_break", "table"}
_IS_SET_OFF = _SETS_OFF - {"list"} | {"paragraph", "html_block"}


def _set_off(nodes: list[Node]) -> set[Node]:
    """The blocks below ``nodes`` that a blank line sets off from what ends before them.

    What ends before a block is its elder sibling; before the first block of an
    item or list it is what ends before the item or list.
    """
    out: set[Node] = set()
    todo = [(nodes, False)]
    while todo:
        siblings, after = todo.pop()
        for n in siblings:
            if after and n.kind in _IS_SET_OFF:
                out.add(n)
            if n.children and n.kind != "table":
                todo.append((n.children, after and n.kind not in _IS_SET_OFF))
            last = n
            while last.kind in ("item", "footnote_definition") and last.children:
                last = last.children[-1]
            after = last.kind in _SETS_OFF or (after and last.kind in ("item", "footnote_definition"))
    return out


def latex_body(nodes: list[Node], beamer: bool = False) -> str:
    """Blocks as LaTeX: the text of a node is made from the texts of its children."""
    order, todo = [], list(reversed(nodes))
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [] if n.kind in ("table", "image") else reversed(n.children)
    set_off, made = _set_off(nodes), {}
    for n in reversed(order):
        text = _latex_of(n, "".join(made[c] for c in n.children if c in made), beamer)
        made[n] = "\n" + text if n in set_off else text
    return "".join(made[n] for n in nodes)


def _latex_of(n: Node, inner: str, beamer: bool) -> str:
    kind, at = n.kind, n.at
    if kind in _CONSTANT:
        return _CONSTANT[kind]
    if kind in _AROUND:
        return inner.join(_AROUND[kind])
    if kind == "text":
        return escape_latex(n.literal)
    if kind == "code":
        return f"\\texttt{{{escape_latex(n.literal)}}}"
    if kind == "heading":
        return f"\\{_SECTIONS[beamer][at['level'] - 1]}{{{inner}}}"
    if kind == "list":
        name = "itemize" if at["list_type"] == "bullet" else "enumerate"
        return f"\\begin{{{name}}}\n{inner}\\end{{{name}}}\n"
    if kind == "code_block":
        lang = (at["info"].split() or [""])[0]
        name, option = ("lstlisting", f"[language={escape_latex(lang)}]") if lang else ("verbatim", "")
        return f"\\begin{{{name}}}{option}\n{n.literal}\\end{{{name}}}\n"
    if kind == "table":
        rows = ("\\hline\n" if r.at["header_end"] else " & ".join(escape_latex(text_of(c)) for c in r.children) + " \\\\\n" for r in n.children)
        return f"\\begin{{tabular}}{{{''.join(_COLUMN.get(a, 'l') for a in at['alignments'])}}}\n{''.join(rows)}\\end{{tabular}}\n"
    if kind == "link":
        return f"\\href{{{escape_latex(at['url'])}}}{{{inner}}}"
    if kind == "image":
        return f"\\includegraphics{{{escape_latex(at['url'])}}}"
    if kind == "math":
        return f"\\[{n.literal}\\]" if at["display_math"] else f"${n.literal}$"
    return at["emoji"] if kind == "shortcode" else inner


#: What a document of each class loads, in order.
_PACKAGES = {"article": ("[utf8]{inputenc}", "[T1]{fontenc}", "{hyperref}", "{listings}", "{graphicx}"), "beamer": ("[utf8]{inputenc}", "[T1]{fontenc}", "{hyperref}", "{ulem}", "{listings}")}
_THEME = "\\usetheme{Madrid}\n\\usecolortheme{default}\n"


def preamble(document_class: str = "article", packages: tuple[str, ...] = ()) -> str:
    """The head of a document; packages that the class loads already are not loaded twice."""
    loads = dict.fromkeys(_PACKAGES.get(document_class, _PACKAGES["article"]) + tuple(f"{{{p}}}" for p in packages))
    lines = "".join(f"\\usepackage{p}\n" for p in loads)
    if document_class == "beamer":
        lines = lines.replace("\\usepackage{ulem}\n", _THEME + "\\usepackage{ulem}\n")
    return f"\\documentclass{{{document_class}}}\n\n{lines}\n"


def to_latex(root: Node, standalone: bool = False) -> str:
    body = latex_body(root.children)
    return preamble() + "\\begin{document}\n\n" + body + "\n\\end{document}\n" if standalone else body


def split_slides(root: Node, slide_level: int = 2) -> list[tuple[Node | None, list[Node]]]:
    """(heading or None, blocks) of each slide; a heading at or above the level starts one."""
    out: list[tuple[Node | None, list[Node]]] = []
    for n in root.children:
        if n.kind == "heading" and n.at["level"] <= slide_level:
            out.append((n, []))
        elif out:
            out[-1][1].append(n)
        else:
            out.append((None, [n]))
    return out


def document_title(root: Node) -> str:
    return next((text_of(n) for n in root.children if n.kind == "heading" and n.at["level"] == 1), "")


def to_beamer(root: Node, slide_level: int = 2) -> str:
    """Level-1 headings are sections, others frames; every block is in one frame only."""
    out = [preamble("beamer")]
    if title := document_title(root):
        out.append(f"\\title{{{escape_latex(title)}}}\n\\date{{\\today}}\n\n")
    out.append("\\begin{document}\n\n" + ("\\frame{\\titlepage}\n\n" if title else ""))
    for head, blocks in split_slides(root, slide_level):
        name = escape_latex(text_of(head)) if head is not None else ""
        if head is not None and head.at["level"] == 1:
            out.append(f"\\section{{{name}}}\n\n")
            if not blocks:
                continue
        out.append(f"\\begin{{frame}}[fragile]{{{name}}}\n{latex_body(blocks, True).rstrip()}\n\\end{{frame}}\n\n")
    return "".join(out) + "\\end{document}\n"


def _fragment(nodes: list[Node]) -> str:
    box = Node("document")
    box.children = nodes
    return to_html(box)


def to_revealjs(root: Node, slide_level: int = 2) -> str:
    sections = []
    for head, blocks in split_slides(root, slide_level):
        title = f"<h2>{escape_html(text_of(head))}</h2>\n" if head is not None else ""
        sections.append(f"<section>\n{title}{_fragment(blocks)}\n</section>\n")
    return (
        f'<!doctype html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>{escape_html(document_title(root))}</title>\n<link rel="stylesheet" href="dist/reveal.css">\n<link rel="stylesheet" href="dist/theme/white.css">\n</head>\n<body>\n<div class="reveal">\n<div class="slides">\n'
        + "".join(sections) + '</div>\n</div>\n<script src="dist/reveal.js"></script>\n<script>Reveal.initialize();</script>\n</body>\n</html>\n'
    )


def to_page(root: Node) -> str:
    return f'<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>{escape_html(document_title(root))}</title>\n</head>\n<body>\n{to_html(root)}\n</body>\n</html>\n'


def to_bibtex(root: Node) -> str:
    """Code blocks verbatim; all other text as comments."""
    out = []
    for n in walk(root):
        if n.kind == "code_block":
            out.append(n.literal.rstrip("\n") + "\n\n")
        elif n.kind in ("heading", "paragraph", "table_cell"):
            text = text_of(n, " ").strip()
            if text:
                out.append(f"% {text}\n")
    return "".join(out)


__all__ = ["Html", "document_title", "split_slides", "to_beamer", "to_bibtex", "to_latex", "to_page", "to_revealjs", "to_xml"]

"""Trees as canonical Markdown, optionally wrapped by least raggedness."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import Any, NamedTuple

from .cells import display_width, is_cjk
from .tree import Node, text_of, walk

_SPECIAL = re.compile(r"([\\`*_\[\]<])")
_LINE_START = re.compile(r"^(\s*)(#{1,6}(?=\s|$)|[-+](?=\s|$)|>|~{3,}|=+\s*$)")
_NUMBERED = re.compile(r"^(\s*\d{1,9})([.)])(?=\s|$)")
_ENTITY_LIKE = re.compile(r"&(?=#?[A-Za-z0-9]+;)")


def escape_text(s: str, start: bool) -> str:
    """Escape what would be read as markup; underscores inside words and lone brackets stay."""
    s = _SPECIAL.sub(r"\\\1", s)
    s = re.sub(r"(?<=\w)\\_(?=\w)", "_", s)
    s = re.sub(r"\\<(?![A-Za-z/!?])", "<", s)
    s = re.sub(r"(?<=\s)\\([*_])(?=\s)", r"\1", s)
    s = _ENTITY_LIKE.sub(r"\&", s)
    if start:
        s = _LINE_START.sub(lambda m: m[1] + "\\" + m[2], s)
        s = _NUMBERED.sub(r"\1\\\2", s)
    return s


def code_span(s: str) -> str:
    n = 1
    runs = {len(x) for x in re.findall("`+", s)}
    while n in runs:
        n += 1
    pad = " " if s[:1] == "`" or s[-1:] == "`" or (s.strip(" ") and s[:1] == " " and s[-1:] == " ") else ""
    return "`" * n + pad + s + pad + "`" * n


def fence_for(content: str, char: str = "`", least: int = 3) -> str:
    return char * max([least, *(len(x) + 1 for x in re.findall(re.escape(char) + "{3,}", content))])


def target(url: str, title: str) -> str:
    if not url or re.search(r"[\s()<>]", url):
        url = "<" + re.sub(r"([<>])", r"\\\1", url) + ">" if url else ""
    if title:
        mark = '"' if '"' not in title else "'" if "'" not in title else '"'
        title = f" {mark}" + title.replace("\\", "\\\\").replace(mark, "\\" + mark) + mark
    return url + title


def inline(node: Node, start: bool = True, edge: str = "", o: Options | None = None) -> str:
    """The inline content of a node, iteratively; ``edge`` stands at both sides of emphasis.

    A handler of the options writes its kind from what was written for the content.
    """
    out: list[str] = []
    handlers = o.handlers if o is not None else {}
    stack: list = [(c, False) for c in reversed(node.children)]

    def at_start() -> bool:
        return (start and not "".join(out[-1:])) if not out else out[-1].endswith("\n")

    while stack:
        n, closing = stack.pop()
        kind = n.kind
        if kind in handlers and closing is False:
            stack.append((n, len(out)))
            stack.extend((c, False) for c in reversed(n.children))
        elif kind in handlers:
            content = "".join(out[closing:]) if n.children else n.literal or ""
            out[closing:] = [handlers[kind](n, content, o)]
        elif closing:
            mark = {"emph": "*", "strong": "**", "strikethrough": "~~"}.get(kind)
            out.append(mark + edge if mark else f"]({target(n.at['url'], n.at['title'])})")
        elif kind == "text":
            out.append(escape_text(n.literal, at_start()))
        elif kind == "softbreak":
            out.append("\n")
        elif kind == "linebreak":
            out.append("\\\n")
        elif kind == "code":
            out.append(code_span(n.literal))
        elif kind == "html_inline":
            out.append(n.literal)
        elif kind == "math":
            mark = "$$" if n.at["display_math"] else "$"
            out.append(mark + n.literal + mark)
        elif kind == "shortcode":
            out.append(f":{n.at['code']}:")
        elif kind == "footnote_reference":
            out.append(f"[^{n.at['footnote_name']}]")
        elif kind in ("emph", "strong", "strikethrough"):
            out.append(edge + {"emph": "*", "strong": "**", "strikethrough": "~~"}[kind])
            stack.append((n, True))
            stack.extend((c, False) for c in reversed(n.children))
        elif kind in ("link", "image"):
            text, url = text_of(n), n.at["url"]
            if kind == "link" and not n.at["title"] and len(n.children) == 1 and n.children[0].kind == "text" and (url == text or url == "mailto:" + text) and re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", url):
                out.append(f"<{text}>")
                continue
            out.append("![" if kind == "image" else "[")
            stack.append((n, True))
            stack.extend((c, False) for c in reversed(n.children))
    return "".join(out)


# --- wrapping ------------------------------------------------------------------


def width_of(s: str) -> int:
    return len(s) if s.isascii() else display_width(s)


_UNIT = re.compile(r"(!?\[(?:[^\[\]]|\[[^\]]*\])*\]\([^()\s]*(?:\s+\"[^\"]*\")?\)|`+[^`]+`+)")
#: Stands where emphasis begins or ends, for the time of wrapping only; no text may hold this code point.
EDGE = "\ufdd0"
# Where Chinese and Japanese text may part without a space, and what the breaks of a paragraph cost.
NO_START = set("，。、；：）」』”")  # pulled back to the line before
NO_END = set("([{（［｛「『〈《【〔")
ASIDE = set(",.;:)]}([{")
BRACKETS = set("()[]{}")
CLOSING = set("，。、；：？！．」』）］｝》】〉〕”’…")
_BEYOND_LATIN = re.compile("[\u1100-\U0010ffff]")  # nothing below it parts a word
STICKING = {"", *NO_START, *CLOSING, *",.;:!?)]}"}
TRAILERS = ",.:;"
PULLED, BRACKET, MARKER, OVER, TRAILING, LAST = 10_000.0, 5_000.0, 1_000_000.0, 100.0, 80.0, 0.1


class Unit(NamedTuple):
    """What no line break may split: its text, whether a space comes before, and whether it is a link, an image, or a code span."""

    text: str
    space: bool
    atom: bool = False


def _clauses(word: str) -> list[str]:
    """Parts of a word between which a line may end without a space: behind closing marks, before opening ones, at the edges of emphasis, all beside CJK characters."""
    if not _BEYOND_LATIN.search(word):
        return [word]
    out, begin, last, solid = [], 0, "", ""
    for i, here in enumerate(word):
        if here == EDGE:
            ahead = word[i + 1 : i + 2]
            may = (is_cjk(solid) or is_cjk(ahead)) and ahead not in STICKING
        else:
            closed = last in CLOSING or (last in ",!?;:)]}" and is_cjk(here)) or (here in NO_END and not here.isascii() and last not in ")]}")
            may = last not in ("", EDGE) and closed and here not in NO_START and here not in CLOSING
        if i and may and last not in NO_END:
            out.append(word[begin:i])
            begin = i
        last, solid = here, solid if here in "*~" + EDGE else here
    return [*out, word[begin:]]


def units(text: str) -> list[Unit]:
    """The units of a paragraph: links, code spans and words; a word that sticks to the unit before is part of it, unless CJK rules let a line end between."""
    out: list[Unit] = []
    space = False
    for k, part in enumerate(_UNIT.split(text)):
        if not k % 2 and part and (space or not out or part[0].isspace()) and EDGE not in part and not _BEYOND_LATIN.search(part):  # plain words behind a space
            plain = part.split()
            if plain:
                out.append(Unit(plain[0], bool(out)))
                out += [Unit(x, True) for x in plain[1:]]
            space = (space and not plain) or part[-1].isspace()
            continue
        for x in [part] if k % 2 else re.findall(r"\s+|[^\s]+", part):
            if not k % 2 and x.isspace():
                space = True
                continue
            for j, y in enumerate([x] if k % 2 else _clauses(x)):
                bare = y.replace(EDGE, "")
                if not bare:
                    continue
                if out and not space and (bare[0] in NO_START or (j == 0 and not _parts(out[-1].text[-1], y, k % 2 == 1))):
                    out[-1] = Unit(out[-1].text + bare, out[-1].space, out[-1].atom)
                else:
                    out.append(Unit(bare, space and bool(out), k % 2 == 1))
                space = False
    return out


def _parts(last: str, word: str, atom: bool) -> bool:
    """Whether a line may end between a character and a word or an atom that follows without a space."""
    first = word.replace(EDGE, "")[0]
    if last in CLOSING:
        return first not in CLOSING and (atom or is_cjk(first) or word[0] == EDGE)
    return atom and is_cjk(last)


def break_cost(before: Unit, after: Unit | None) -> float:
    """What it costs to end a line between two units, however long the lines are."""
    last, cost = before.text[-1], 0.0
    if after is not None:
        first = after.text[0]
        if first in NO_START:
            cost += PULLED
        elif first in ASIDE and not (first in "([{" and after.atom) and (first in BRACKETS or last in BRACKETS):
            cost += BRACKET
    return cost + (BRACKET if last in NO_END else 0.0)


_BLOCK = re.compile(r"([-+*>]|#{1,6}|\d{1,9}[.)])$|>")


def starts_block(unit: Unit) -> bool:
    """Whether a line that begins with the unit would be read as another block."""
    return not unit.text[0].isalpha() and _BLOCK.match(unit.text) is not None


def line_cost(length: int, width: int, before: Unit, after: Unit | None) -> float:
    """The cost of a line of ``length`` columns, the space at its end included, that ends between two units.

    A short line costs the square of what it lacks, the last one a tenth of it; a
    long one a hundred times the square of what it has over, and more where it
    is mere punctuation that sticks out.
    """
    slack = width - length
    fits, over = _fixed_costs(before, after)
    if slack < 0:
        sticks_out = slack >= -5 and before.text[-1] in TRAILERS
        return OVER * slack * slack + (TRAILING * (5 - slack) ** 2 if sticks_out else 0.0) + over
    return (LAST * slack if after is None else slack * slack) + fits


def _fixed_costs(before: Unit, after: Unit | None) -> tuple[float, float]:
    """What a line that fits and one that is too long cost between two units, beside their length."""
    risk = MARKER if after is not None and starts_block(after) else 0.0
    return break_cost(before, after) + risk, risk


def wrap(text: str, width: int) -> list[str]:
    """The lines of least total cost (:func:`line_cost`).

    Dynamic programming over the units.  A line is tried longer and longer until
    what it has over alone costs more than the best way found, so for a fixed
    width the work is linear in the text, and the result is still the best of all.
    """
    words = units(text)
    if not words:
        return []
    n = len(words)
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    begins, end = [], 0  # columns from the paragraph's begin to each unit, all on one line
    for j, (word, space, _) in enumerate(words, 1):
        begins.append(end + space)
        end += space + width_of(word)
        after = words[j] if j < n else None
        fits, over = _fixed_costs(words[j - 1], after)
        trails, last_line = word[-1] in TRAILERS, after is None
        least, at, reach = float("inf"), 0, width - end - int(after is not None and after.space)
        i = j - 1
        while i >= 0:
            slack = reach + begins[i]
            if slack < 0:
                break
            cost = best[i] + (LAST * slack if last_line else slack * slack) + fits
            if cost < least:
                least, at = cost, i
            i -= 1
        while i >= 0:
            slack = reach + begins[i]
            cost = OVER * slack * slack
            if cost >= least:
                break
            cost += best[i] + over + (TRAILING * (5 - slack) ** 2 if trails and slack >= -5 else 0.0)
            if cost < least:
                least, at = cost, i
            i -= 1
        best[j], back[j] = least, at
    lines, j = [], n
    while j:
        i = back[j]
        lines.append("".join((" " if w.space and k else "") + w.text for k, w in enumerate(words[i:j])))
        j = i
    return lines[::-1]


def wrap_inline(text: str, width: int) -> str:
    return "\\\n".join("\n".join(wrap(part.replace("\n", " "), width)) for part in text.split("\\\n"))


# --- blocks -----------------------------------------------------------------------


class Options:
    """What a caller may choose.

    ``heading``: "as_is", "atx", or "setext" (levels 1 and 2).  ``bullet``: - * or +.
    ``delimiter``: "as_is", "." or ")" behind the numbers of ordered lists.
    ``handlers``: by kind of node, functions that write it instead of the built-in
    one: of a block ``(node, texts of its children, options, width)``, of an
    inline node ``(node, text of its content, options)``.  A handler may call
    :data:`BLOCKS` for what the built-in one would write.
    """

    def __init__(self, width: int = 0, bullet: str = "-", cjk_spacing: bool = False, heading: str = "as_is", delimiter: str = "as_is", handlers: Mapping[str, Callable] | None = None):
        for what, value, known in (("bullet", bullet, "-*+"), ("heading", heading, ("as_is", "atx", "setext")), ("delimiter", delimiter, ("as_is", ".", ")"))):
            if value not in known:
                raise ValueError(f"unknown {what} {value!r}; known: {', '.join(known)}")
        self.width, self.bullet, self.cjk_spacing, self.heading, self.delimiter = width, bullet, cjk_spacing, heading, delimiter
        self.handlers = dict(handlers or {})


def _loose(lst: Node) -> bool:
    return not lst.at["tight"]


def _content(item: Node) -> int:
    """Columns from an item's marker to its content."""
    if item.parent is None or item.parent.at.get("list_type") != "ordered":
        return 2
    return len(str(item.parent.at["list_start"] + item.parent.children.index(item))) + 2


def _table(node: Node) -> str:
    rows = [[" ".join(text_of(c).split()).replace("|", "\\|") for c in r.children] for r in node.children if not r.at["header_end"]]
    n = max(len(r) for r in rows)
    align = (node.at["alignments"] + ["none"] * n)[:n]
    rows = [r + [""] * (n - len(r)) for r in rows]
    size = [max(3, *(width_of(r[i]) for r in rows)) for i in range(n)]

    def cell(s: str, i: int) -> str:
        gap = size[i] - width_of(s)
        if align[i] == "right":
            return " " * gap + s
        if align[i] == "center":
            return " " * (gap // 2) + s + " " * (gap - gap // 2)
        return s + " " * gap

    rule = [{"left": ":" + "-" * (w + 1), "right": "-" * (w + 1) + ":", "center": ":" + "-" * w + ":"}.get(a, "-" * (w + 2)) for a, w in zip(align, size, strict=True)]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line([cell(s, i) for i, s in enumerate(rows[0])]), "|" + "|".join(rule) + "|", *(line([cell(s, i) for i, s in enumerate(r)]) for r in rows[1:])])


def _words(n: Node, start: bool, o: Options) -> str:
    text = inline(n, start, EDGE, o)
    return add_cjk_spacing(text) if o.cjk_spacing else text


def _paragraph(n: Node, parts: list[str], o: Options, width: int) -> str:
    text = _words(n, True, o)
    return wrap_inline(text, max(width, 20)) if o.width else text.replace(EDGE, "")


def _heading(n: Node, parts: list[str], o: Options, width: int) -> str:
    text = _words(n, False, o).replace("\\\n", " ").replace("\n", " ").replace(EDGE, "")
    level = n.at["level"]
    if (n.at["setext"] and o.heading == "as_is") or (o.heading == "setext" and level < 3 and text):
        return text + "\n" + ("=" if level == 1 else "-") * max(3, width_of(text))
    text = re.sub(r"(^|\s)(#+)$", r"\1\\\2", text)
    return ("#" * level + " " + text).rstrip()


def _thematic_break(n: Node, parts: list[str], o: Options, width: int) -> str:
    return n.at.get("mark", "---")


def _html_block(n: Node, parts: list[str], o: Options, width: int) -> str:
    return n.literal


def _code_block(n: Node, parts: list[str], o: Options, width: int) -> str:
    if not n.at["fenced"] and n.literal.strip():
        return "\n".join("    " + x if x else "" for x in n.literal.removesuffix("\n").split("\n"))
    char = "~" if n.at.get("fence_char") == "~" or "`" in n.at["info"] else "`"
    fence = fence_for(n.literal, char, 3)
    return f"{fence}{n.at['info']}\n{n.literal}{fence}"


def _table_block(n: Node, parts: list[str], o: Options, width: int) -> str:
    return _table(n)


def _stacked(n: Node, parts: list[str], o: Options, width: int) -> str:
    """The blocks of a container below each other, with a blank line or, in tight items, none between; lists that would merge are parted by a comment."""
    tight = n.kind == "item" and n.parent is not None and n.parent.kind == "list" and not _loose(n.parent)
    out, before = [], None
    for c, body in zip(n.children, parts, strict=True):
        if before is not None:
            sep = "\n" if tight else "\n\n"
            if c.kind == before.kind == "list" or (before.kind == "list" and c.kind == "code_block" and not c.at["fenced"]):
                sep = "\n\n<!-- -->\n\n" if c.at.get("bullet") == before.at.get("bullet") or c.kind == "code_block" else "\n\n"
            out.append(sep)
        if n.kind == "item" and c.kind == "list":  # nested lists stand four columns in, whatever the marker's width
            more = max(0, 4 - _content(n))
            body = "\n".join(" " * more + x if x else "" for x in body.split("\n"))
        out.append(body)
        before = c
    return "".join(out)


def _block_quote(n: Node, parts: list[str], o: Options, width: int) -> str:
    return "\n".join((">" + (" " + x if x else "")) for x in _stacked(n, parts, o, width).split("\n"))


def _footnote_definition(n: Node, parts: list[str], o: Options, width: int) -> str:
    return f"[^{n.at['footnote_name']}]: " + _stacked(n, parts, o, width).replace("\n", "\n    ")


def _list(n: Node, parts: list[str], o: Options, width: int) -> str:
    dot = {"as_is": "." if n.at["delimiter"] == "period" else ")"}.get(o.delimiter, o.delimiter)
    items = []
    for k, (item, body) in enumerate(zip(n.children, parts, strict=True)):
        mark = o.bullet if n.at["list_type"] == "bullet" else f"{n.at['list_start'] + k}{dot}"
        if item.at.get("checked") is not None:
            body = ("[x] " if item.at["checked"] else "[ ] ") + body
        pad = " " * (len(mark) + 1)
        lines = body.split("\n")
        if item.at.get("is_task_list"):
            lines[0] = re.sub(r"^\\\[([ xX])\\\]", lambda m: f"[{m[1].lower()}]", lines[0])
        items.append("\n".join([(mark + " " + lines[0]).rstrip(), *(pad + x if x else "" for x in lines[1:])]))
    return ("\n\n" if _loose(n) else "\n").join(items)


#: The built-in writer of each kind of block.
BLOCKS: dict[str, Callable[[Node, list[str], Options, int], str]] = {
    "document": _stacked, "item": _stacked, "block_quote": _block_quote, "footnote_definition": _footnote_definition, "list": _list, "paragraph": _paragraph,
    "heading": _heading, "thematic_break": _thematic_break, "html_block": _html_block, "code_block": _code_block, "table": _table_block,
}


def to_markdown(root: Node, width: int = 0, cjk_spacing: bool = False, bullet: str = "-", **options: Any) -> str:
    """Bottom-up over the tree without recursion: every block's text from the texts of its children, by the handler of its kind."""
    o = Options(width, bullet, cjk_spacing, **options)
    depth: dict[int, int] = {id(root): 0}
    order = [n for n in walk(root)]
    for n in order:
        step = 2 if n.kind in ("block_quote",) else n.at.get("padding", 2) if n.kind == "item" else 0
        for c in n.children:
            depth[id(c)] = depth[id(n)] + step
    text: dict[int, str] = {}
    write = BLOCKS | {k: f for k, f in o.handlers.items() if k in BLOCKS}
    for n in reversed(order):
        if n.kind in BLOCKS:
            text[id(n)] = write[n.kind](n, [text.pop(id(c), "") for c in n.children], o, width - depth[id(n)])
    return text[id(root)]


_HAN = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"


def add_cjk_spacing(text: str) -> str:
    """A space between CJK characters and Latin letters or digits, and none between CJK characters and emphasis."""
    text = re.sub(rf"(?<=[{_HAN}]) +(?={EDGE}[*~])|(?<=[*~]{EDGE}) +(?=[{_HAN}])", "", text)
    text = re.sub(rf"([{_HAN}]\]\([^()\s]*\))(?=[A-Za-z0-9])", r"\1 ", text)
    return re.sub(rf"(?<=[{_HAN}])(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])(?=[{_HAN}])", " ", text)


# --- contents ---------------------------------------------------------------------

_MARKER = re.compile(r"^\[TOC\s*([^\]]*)\]\s*:\s*#(?:\s+.*)?$")


def slug(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum() or c == " ").replace(" ", "-")


def contents(root: Node, low: int = 1, high: int = 6, numbered: bool = False, linked: bool = True) -> str:
    """The headings of a level range as an indented list."""
    heads = [(n.at["level"], text_of(n)) for n in walk(root) if n.kind == "heading" and low <= n.at["level"] <= high]
    if not heads:
        return ""
    top, counters, out = min(level for level, _ in heads), [0] * 7, []
    for level, text in heads:
        d = level - top
        counters[d] += 1
        counters[d + 1 :] = [0] * (6 - d)
        label = (".".join(map(str, counters[: d + 1])) + " " if numbered else "") + text
        out.append("  " * d + "- " + (f"[{label}](#{slug(text)})" if linked else label))
    return "\n".join(out)


def format_text(text: str, width: int = 0, cjk_spacing: bool = False, **options: Any) -> str:
    """Format a document, with the choices of :class:`Options`; a ``[TOC levels=a-b numbered no-links]: #`` line stays and the list after it is made anew."""
    from .blocks import parse

    lines = text.split("\n")
    at = next((i for i, x in enumerate(lines) if _MARKER.match(x.strip())), None)
    if at is None:
        return to_markdown(parse(text), width, cjk_spacing, **options)
    end = at + 1
    while end < len(lines) and not lines[end].strip():
        end += 1
    while end < len(lines) and re.match(r"\s*(-|\d)", lines[end]):
        end += 1
    args = _MARKER.match(lines[at].strip())[1]
    m = re.search(r"levels=(\d)(?:-(\d))?", args)
    low, high = (min(max(int(m[1]), 1), 6), min(max(int(m[2] or m[1]), 1), 6)) if m else (1, 6)
    head, tail = "\n".join(lines[:at]), "\n".join(lines[end:])
    toc = contents(parse(head + "\n\n" + tail), low, high, "numbered" in args, "no-links" not in args)
    parts = [to_markdown(parse(head), width, cjk_spacing, **options), lines[at].strip(), toc, to_markdown(parse(tail), width, cjk_spacing, **options)]
    return "\n\n".join(p for p in parts if p)

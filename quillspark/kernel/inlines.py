"""Inline structure: one scan that appends nodes, a bracket stack for links and a delimiter list for emphasis and quotes.

Emphasis is resolved with a lower bound per kind of closer, so the work is
linear in the number of delimiters; nothing recurses.
"""

from __future__ import annotations

import re
import unicodedata
from html.entities import html5

from ..functions.scalars import normalize_uri
from .tree import Node

RefMap = dict[str, tuple[str, str]]
_PUNCT = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_ENTITY = re.compile(r"&(?:#([0-9]{1,7});|#[xX]([0-9a-fA-F]{1,6});|([A-Za-z][A-Za-z0-9]*);)")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])|" + _ENTITY.pattern)
_PLAIN = re.compile(r"[^\n`\\&<*_\[\]!]+")
_PLAIN_SMART = re.compile(r"[^\n`\\&<*_\[\]!'\"]+")
_TICKS = re.compile(r"`+")
_EMAIL = re.compile(r"<([a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*)>")
_URI = re.compile(r"<([A-Za-z][A-Za-z0-9.+-]{1,31}:[^\x00-\x20<>]*)>")
_TAG = re.compile(
    r"""<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"""
    r"|<!-->|<!--->|<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[[\s\S]*?\]\]>",
    re.A,
)
#: Openers of raw HTML that run to a closer, however far it is.
_RUNS_TO = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", "?>"))
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,1000})\]", re.S)
_MATH = re.compile(r"\\.|[{}]|\$+", re.S)
_SHORTCODE = re.compile(r":([A-Za-z0-9_+-]{2,}):")
_WS = re.compile(r"[ \t]*\n?[ \t]*")
_TITLE = re.compile(r'"((?:[^"\\]|\\.)*)"|\'((?:[^\'\\]|\\.)*)\'|\(((?:[^()\\]|\\.)*)\)', re.S)


def _decode(m: re.Match, dec: str | None, hexa: str | None, name: str | None) -> str:
    if dec or hexa:
        code = int(dec) if dec else int(hexa, 16)
        return "�" if code == 0 or code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)
    return html5.get(name + ";", m[0])


def unescape(text: str) -> str:
    """Backslash escapes and entities resolved."""
    if "\\" not in text and "&" not in text:
        return text
    return _ESCAPED.sub(lambda m: m[1] if m[1] else _decode(m, m[2], m[3], m[4]), text)


def normalize_label(label: str) -> str:
    return " ".join(label.split()).lower().upper()


def link_destination(s: str, i: int) -> tuple[str, int] | None:
    if i < len(s) and s[i] == "<":
        j = i + 1
        while j < len(s):
            if s[j] == "\\" and j + 1 < len(s):
                j += 2
                continue
            if s[j] == ">":
                return normalize_uri(unescape(s[i + 1 : j])), j + 1
            if s[j] in "<\n":
                return None
            j += 1
        return None
    depth, j = 0, i
    while j < len(s):
        ch = s[j]
        if ch == "\\" and j + 1 < len(s) and s[j + 1] in _PUNCT:
            j += 2
            continue
        if ch == "(":
            depth += 1
            if depth > 32:
                return None
        elif ch == ")":
            if not depth:
                break
            depth -= 1
        elif ch <= " " or ch == "\x7f":
            break
        j += 1
    return None if depth else (normalize_uri(unescape(s[i:j])), j)


def take_definitions(text: str, refs: RefMap) -> str:
    """Strip link reference definitions from the start of a paragraph; the first of a label wins."""
    while text.lstrip(" ").startswith("["):
        start = len(text) - len(text.lstrip(" "))
        m = _LABEL.match(text, start)
        if not m or not m[1].strip() or m.end() >= len(text) or text[m.end()] != ":":
            break
        i = _WS.match(text, m.end() + 1).end()
        dest = link_destination(text, i)
        if dest is None or (dest[1] == i):
            break
        url, j = dest
        title, end = "", None
        gap = _WS.match(text, j)
        if gap.end() > j and (t := _TITLE.match(text, gap.end())):
            rest = re.compile(r"[ \t]*(?:\n|$)").match(text, t.end())
            if rest:
                title, end = unescape(next(g for g in t.groups() if g is not None)), rest.end()
        if end is None:
            rest = re.compile(r"[ \t]*(?:\n|$)").match(text, j)
            if not rest:
                break
            end = rest.end()
        refs.setdefault(normalize_label(m[1]), (url, title))
        text = text[end:]
    return text


class Delimiter:
    __slots__ = ("node", "ch", "count", "original", "opens", "closes", "prev", "next", "live")

    def __init__(self, node, ch, count, opens, closes, prev):
        self.node, self.ch, self.count, self.original, self.opens, self.closes = node, ch, count, count, opens, closes
        self.prev, self.next, self.live = prev, None, True
        if prev is not None:
            prev.next = self


def _is_space(ch: str) -> bool:
    return ch.isspace()


def _is_punct(ch: str) -> bool:
    return ch in _PUNCT or (ch > "\x7f" and unicodedata.category(ch)[0] in "PS")


class Inline:
    def __init__(self, holder: Node, text: str, refs: RefMap, smart: bool, shortcodes: dict[str, str]):
        self.holder, self.s, self.refs, self.smart, self.codes = holder, text, refs, smart, shortcodes
        self.i, self.last, self.brackets = 0, None, []
        self.no_ticks: dict[int, int] = {}
        self.last_closer: dict[str, int] = {}
        self.plain = _PLAIN_SMART if smart else _PLAIN

    def text(self, literal: str) -> Node:
        return self.holder.add(Node("text", literal=literal))

    def run(self) -> None:
        s = self.s
        handlers = {"\n": self.newline, "`": self.ticks, "\\": self.backslash, "&": self.entity, "<": self.angle, "*": self.delims, "_": self.delims, "[": self.open, "]": self.close, "!": self.bang, "$": self.math, ":": self.shortcode}
        if self.smart:
            handlers |= {"'": self.delims, '"': self.delims}
        while self.i < len(s):
            before = self.i
            handler = handlers.get(s[before])
            if handler is None or not handler():
                self.i = before
                m = self.plain.match(s, before)
                run = m[0] if m else s[before]
                self.i = before + len(run)
                if self.i < len(s) and s[self.i] == "\n" and run.endswith(" "):
                    run, spaces = run.rstrip(" "), len(run) - len(run.rstrip(" "))
                    self.pending_break = spaces >= 2
                    if run:
                        self.text(_dashes(run) if self.smart else run)
                    continue
                self.text(_dashes(run) if self.smart else run)
        resolve(self.last, None)
        _merge(self.holder)

    pending_break = False

    def newline(self) -> bool:
        hard, self.pending_break = self.pending_break, False
        self.holder.add(Node("linebreak" if hard else "softbreak"))
        self.i += 1
        while self.i < len(self.s) and self.s[self.i] in " \t":
            self.i += 1
        return True

    def ticks(self) -> bool:
        s = self.s
        m = _TICKS.match(s, self.i)
        n, start = len(m[0]), m.end()
        if self.no_ticks.get(n, -1) < start and n not in self.no_ticks:
            for close in _TICKS.finditer(s, start):
                if len(close[0]) == n:
                    body = s[start : close.start()].replace("\n", " ")
                    if body.strip(" ") and body[0] == " " and body[-1] == " ":
                        body = body[1:-1]
                    self.holder.add(Node("code", literal=body, at={"num_backticks": n}))
                    self.i = close.end()
                    return True
            self.no_ticks[n] = start  # no closer of this length lies ahead
        self.text(m[0])
        self.i = start
        return True

    def backslash(self) -> bool:
        nxt = self.s[self.i + 1 : self.i + 2]
        if nxt == "\n":
            self.holder.add(Node("linebreak"))
            self.i += 2
            while self.i < len(self.s) and self.s[self.i] in " \t":
                self.i += 1
        elif nxt and nxt in _PUNCT:
            self.text(nxt)
            self.i += 2
        else:
            self.text("\\")
            self.i += 1
        return True

    def entity(self) -> bool:
        m = _ENTITY.match(self.s, self.i)
        if m and (got := _decode(m, m[1], m[2], m[3])) != m[0]:
            self.text(got)
            self.i = m.end()
        else:
            self.text("&")
            self.i += 1
        return True

    def closes(self) -> bool:
        """Whether raw HTML that starts here can end at all; each kind of closer is looked for once."""
        for opener, closer in _RUNS_TO:
            if self.s.startswith(opener, self.i):
                if closer not in self.last_closer:
                    self.last_closer[closer] = self.s.rfind(closer)
                return self.last_closer[closer] > self.i
        return True

    def angle(self) -> bool:
        s = self.s
        if m := _EMAIL.match(s, self.i):
            link = self.holder.add(Node("link", at={"url": "mailto:" + m[1], "title": ""}))
            link.add(Node("text", literal=m[1]))
        elif m := _URI.match(s, self.i):
            link = self.holder.add(Node("link", at={"url": normalize_uri(m[1]), "title": ""}))
            link.add(Node("text", literal=m[1]))
        elif self.closes() and (m := _TAG.match(s, self.i)):
            self.holder.add(Node("html_inline", literal=m[0]))
        else:
            self.text("<")
            self.i += 1
            return True
        self.i = m.end()
        return True

    def delims(self) -> bool:
        s, ch = self.s, self.s[self.i]
        j = self.i + 1
        if ch in "*_":
            while j < len(s) and s[j] == ch:
                j += 1
        before, after = s[self.i - 1] if self.i else "\n", s[j] if j < len(s) else "\n"
        wb, wa, pb, pa = _is_space(before), _is_space(after), _is_punct(before), _is_punct(after)
        left = not wa and (not pa or wb or pb)
        right = not wb and (not pb or wa or pa)
        if ch == "_":
            opens, closes = left and (not right or pb), right and (not left or pa)
        elif ch in "'\"":
            opens, closes = left and (not right or before in "[("), right
        else:
            opens, closes = left, right
        literal = s[self.i : j]
        if ch in "'\"":
            literal = "’" if ch == "'" else "“" if opens and not closes else "”"
        node = self.text(literal)
        if opens or closes:
            self.last = Delimiter(node, ch, j - self.i, opens, closes, self.last)
        self.i = j
        return True

    def open(self) -> bool:
        self.brackets.append([self.text("["), self.last, False, True, self.i + 1])
        self.i += 1
        return True

    def bang(self) -> bool:
        if self.s[self.i + 1 : self.i + 2] == "[":
            self.brackets.append([self.text("!["), self.last, True, True, self.i + 2])
            self.i += 2
        else:
            self.text("!")
            self.i += 1
        return True

    def close(self) -> bool:
        s = self.s
        self.i += 1
        if not self.brackets:
            self.text("]")
            return True
        node, bottom, image, active, start = self.brackets[-1]
        if not active:
            self.brackets.pop()
            self.text("]")
            return True
        got = self._inline_target() or self._reference(start)
        if got is None:
            self.brackets.pop()
            self.text("]")
            return True
        url, title, self.i = got
        link = Node("image" if image else "link", at={"url": url, "title": title})
        siblings = self.holder.children
        k = len(siblings) - 1
        while siblings[k] is not node:
            k -= 1
        inner = siblings[k + 1 :]
        del siblings[k:]
        self.holder.add(link)
        for x in inner:
            link.add(x)
        self.last = resolve(self.last, bottom)
        _merge(link)
        self.brackets.pop()
        if not image:
            for b in self.brackets:
                if not b[2]:
                    b[3] = False
        return True

    def _inline_target(self):
        s = self.s
        if not s.startswith("(", self.i):
            return None
        i = re.compile(r"\s*").match(s, self.i + 1).end()
        dest = link_destination(s, i)
        if dest is None:
            return None
        url, j = dest
        gap = re.compile(r"\s*").match(s, j).end()
        title = ""
        if gap > j and (t := _TITLE.match(s, gap)):
            title = unescape(next(g for g in t.groups() if g is not None))
            gap = re.compile(r"\s*").match(s, t.end()).end()
        return (url, title, gap + 1) if s.startswith(")", gap) else None

    def _reference(self, start: int):
        s, end = self.s, self.i - 1
        m = _LABEL.match(s, self.i)
        if m and m[1].strip():
            ref = self.refs.get(normalize_label(m[1]))
            return (*ref, m.end()) if ref else None
        if end - start > 999 or "[" in re.sub(r"\\.", "", s[start:end]):
            return None
        ref = self.refs.get(normalize_label(s[start:end]))
        return (*ref, m.end() if m else self.i) if ref else None

    def math(self) -> bool:
        """``$x$`` or ``$$x$$``, where a token begins; longer runs of dollars are text."""
        s, i = self.s, self.i
        n = len(s[i:]) - len(s[i:].lstrip("$"))
        if n > 2:
            self.text("$" * n)
            self.i += n
            return True
        depth = 0
        for m in _MATH.finditer(s, i + n):
            if m[0] in "{}":
                depth = max(depth + (1 if m[0] == "{" else -1), 0)
            elif m[0][0] == "$" and depth == 0 and len(m[0]) == n:
                self.holder.add(Node("math", literal=s[i + n : m.start()], at={"display_math": n == 2}))
                self.i = m.end()
                return True
        return False

    def shortcode(self) -> bool:
        m = _SHORTCODE.match(self.s, self.i)
        if m and m[1] in self.codes:
            self.holder.add(Node("shortcode", at={"code": m[1], "emoji": self.codes[m[1]]}))
            self.i = m.end()
            return True
        return False


def _dashes(text: str) -> str:
    """Ellipses, and runs of hyphens as em and en dashes."""

    def run(m: re.Match) -> str:
        n = len(m[0])
        if n % 3 == 0:
            return "—" * (n // 3)
        if n % 2 == 0:
            return "–" * (n // 2)
        return "—" * ((n - 2) // 3) + "–" if n % 3 == 2 else "—" * ((n - 4) // 3) + "––"

    return re.sub(r"-{2,}", run, text.replace("...", "…"))


def resolve(last: Delimiter | None, bottom: Delimiter | None) -> Delimiter | None:
    """Match closers to openers above ``bottom``; returns the new end of the list."""
    if last is bottom:
        return bottom
    first = last
    while first is not None and first.prev is not bottom:
        first = first.prev
    floor: dict[tuple, Delimiter | None] = {}
    closer = first
    while closer is not None:
        if not closer.closes:
            closer = closer.next
            continue
        kind = (closer.ch, closer.opens, closer.original % 3) if closer.ch in "*_" else (closer.ch,)
        limit, opener = floor.get(kind, bottom), closer.prev
        while opener is not None and opener is not bottom and opener is not limit:
            if opener.ch == closer.ch and opener.opens and not ((opener.closes or closer.opens) and (opener.original + closer.original) % 3 == 0 and (opener.original % 3 or closer.original % 3) and closer.ch in "*_"):
                break
            opener = opener.prev
        else:
            opener = None
        nxt = closer.next
        if opener is None:
            floor[kind] = closer.prev
            if not closer.opens:
                _drop(closer)
            closer = nxt
            continue
        if closer.ch in "'\"":
            opener.node.literal, closer.node.literal = ("‘", "’") if closer.ch == "'" else ("“", "”")
            between = closer.prev
            _drop(opener)
            _drop(closer)
            closer = nxt
            del between
            continue
        use = 2 if opener.count >= 2 and closer.count >= 2 else 1
        siblings = opener.node.parent.children
        a, b = _index(siblings, opener.node), _index(siblings, closer.node)
        wrap = Node("strong" if use == 2 else "emph")
        inner = siblings[a + 1 : b]
        del siblings[a + 1 : b]
        wrap.parent = opener.node.parent
        siblings.insert(a + 1, wrap)
        for x in inner:
            wrap.add(x)
        d = closer.prev
        while d is not opener:
            p = d.prev
            _drop(d)
            d = p
        for d in (opener, closer):
            d.count -= use
            d.node.literal = d.ch * d.count
            if not d.count:
                d.node.cut()
                _drop(d)
        if not closer.live:
            closer = nxt
    end = bottom
    if bottom is not None:
        bottom.next = None
    return end


def _index(siblings: list[Node], node: Node) -> int:
    for k in range(len(siblings) - 1, -1, -1):
        if siblings[k] is node:
            return k
    raise ValueError


def _drop(d: Delimiter) -> None:
    d.live = False
    if d.prev is not None:
        d.prev.next = d.next
    if d.next is not None:
        d.next.prev = d.prev


def _merge(holder: Node) -> None:
    """Join neighbouring text nodes, below ``holder`` too."""
    stack = [holder]
    while stack:
        node = stack.pop()
        kids: list[Node] = []
        for c in node.children:
            if c.kind == "text" and kids and kids[-1].kind == "text":
                kids[-1].literal += c.literal
            elif c.kind != "text" or c.literal:
                kids.append(c)
        node.children = kids
        stack.extend(c for c in kids if c.children)


def parse_inlines(holder: Node, text: str, refs: RefMap, smart: bool = False, shortcodes: dict[str, str] | None = None) -> None:
    Inline(holder, text, refs, smart, shortcodes or {}).run()

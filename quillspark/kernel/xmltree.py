"""A small XML builder and element tree."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.scalars import escape_xml


def escape_attr(s: str) -> str:
    return escape_xml(s).replace("\n", "&#10;").replace("\r", "&#13;").replace("\t", "&#9;")


class XmlBuilder:
    """Streaming: start and end elements, attributes, text, CDATA and comments; open elements close at the end."""

    def __init__(self, declaration: bool = False):
        self.out = ['<?xml version="1.0" encoding="UTF-8"?>\n'] if declaration else []
        self.stack: list[str] = []
        self.in_tag = False

    def _close_tag(self, empty: bool = False) -> None:
        if self.in_tag:
            self.out.append(" />" if empty else ">")
            self.in_tag = False

    def start(self, name: str, **attrs: str) -> XmlBuilder:
        self._close_tag()
        self.out.append("<" + name)
        self.stack.append(name)
        self.in_tag = True
        for k, v in attrs.items():
            self.attr(k, v)
        return self

    def attr(self, name: str, value: str) -> XmlBuilder:
        if not self.in_tag:
            raise ValueError("an attribute needs an open tag")
        self.out.append(f' {name}="{escape_attr(value)}"')
        return self

    def _content(self, s: str) -> XmlBuilder:
        self._close_tag()
        self.out.append(s)
        return self

    def text(self, s: str) -> XmlBuilder:
        return self._content(escape_xml(s))

    def cdata(self, s: str) -> XmlBuilder:
        return self._content("<![CDATA[" + s.replace("]]>", "]]]]><![CDATA[>") + "]]>")

    def comment(self, s: str) -> XmlBuilder:
        return self._content("<!--" + s.replace("--", "- -") + "-->")

    def end(self) -> XmlBuilder:
        name = self.stack.pop()
        if self.in_tag:
            self._close_tag(empty=True)
        else:
            self.out.append(f"</{name}>")
        return self

    def finish(self) -> str:
        while self.stack:
            self.end()
        return "".join(self.out)


@dataclass
class XmlElement:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[XmlElement | str] = field(default_factory=list)

    def find_child(self, name: str) -> XmlElement | None:
        return next(iter(self.find_children(name)), None)

    def find_children(self, name: str) -> list[XmlElement]:
        return [c for c in self.children if isinstance(c, XmlElement) and c.name == name]

    def text(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def to_xml(self) -> str:
        b = XmlBuilder()
        stack: list[tuple[bool, XmlElement | str]] = [(True, self)]
        while stack:
            entering, x = stack.pop()
            if not entering:
                b.end()
            elif isinstance(x, str):
                b.text(x)
            else:
                b.start(x.name, **x.attrs)
                stack.append((False, x))
                stack.extend((True, c) for c in reversed(x.children))
        return b.finish()

"""Plain Python scalar functions used inside kernels."""

from __future__ import annotations

import re

# Schemes that a link may not have, and image types that a data URL may have.
BLOCKED_SCHEMES = "javascript vbscript file ftp sftp ssh telnet ldap ldaps smb nfs rtsp rtmp jar icap afs tftp dict gopher news nntp feed imap pop smtp ws wss blob filesystem".split()
DATA_IMAGES = ("image/png", "image/gif", "image/jpeg", "image/jpg", "image/webp")
FILTERED_TAGS = "title textarea style xmp iframe noembed noframes script plaintext".split()

_KEEP = re.compile(r"[^A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]")


def normalize_uri(uri: str) -> str:
    """Percent-encode everything but reserved and unreserved characters and the percent sign."""
    return _KEEP.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), uri)


def escape_html(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def escape_xml(text: str) -> str:
    return escape_html(text).replace("'", "&apos;")


def is_safe_url(url: str) -> bool:
    """No blocked scheme, no encoded scheme, no control characters, at most 8192 bytes."""
    if len(url.encode("utf-8", "replace")) > 8192 or any(ord(c) < 32 or c == "\x7f" for c in url):
        return False
    low = url.strip().lower()
    if low.startswith("data:"):
        return low.startswith(tuple(f"data:{t}{end}" for t in DATA_IMAGES for end in (",", ";base64,")))
    return not low.startswith(("&#", "&x", *(s + ":" for s in BLOCKED_SCHEMES)))


def escape_href(url: str) -> str:
    if not is_safe_url(url):
        return "#"
    return escape_html(url).replace("'", "&#x27;").replace("`", "&#x60;") if url.strip() else ""


_FILTER = re.compile(r"<(/?(?:" + "|".join(FILTERED_TAGS) + r")(?=[\s/>])[^>]*)>", re.I)


def filter_html(html: str) -> str:
    """Escape the brackets of tags that may not pass; all else stays."""
    return _FILTER.sub(lambda m: f"&lt;{m[1]}&gt;", html)


LATEX = {"\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "#": r"\#", "^": r"\textasciicircum{}", "_": r"\_", "~": r"\textasciitilde{}", "%": r"\%", "<": r"\textless{}", ">": r"\textgreater{}", "|": r"\textbar{}", '"': r"\textquotedbl{}", "'": r"\textquotesingle{}", "`": r"\textasciigrave{}"}


def escape_latex(text: str) -> str:
    return "".join(LATEX.get(c, c) for c in text)

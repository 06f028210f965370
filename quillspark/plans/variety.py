"""Queries over documents in every form of the markup, around each document's own words.

A form is Markdown with places for the document's number ``{k}``, its language
``{l}`` and all words of its text ``{t}``; what must come out is written beside
it with the same places, so that its SQL only fills them in.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import extract as X
from ..operators import nodes as N
from ..operators.render import format_documents, render
from .registry import ORACLE, QUERIES, documents, nodes_once, query

WORDS = "(SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, coalesce(lang, '') AS l, rtrim('w ' || trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'))) AS t FROM documents)"


def _parts(form: str) -> list[str]:
    return [p for p in re.split(r"(\{[klt]\})", form) if p]


def filled(form: str) -> Column:
    return F.concat(*(F.col(p[1]) if p in ("{k}", "{l}", "{t}") else F.lit(p) for p in _parts(form)))


def filled_sql(form: str) -> str:
    return " || ".join(p[1] if p in ("{k}", "{l}", "{t}") else "'" + p.replace("'", "''") + "'" for p in _parts(form))


def corpus(spark, sf, form: str) -> DataFrame:
    """(doc_id, text, k, l, t): the form around every document."""
    words = F.rtrim(F.concat(F.lit("w "), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "))))
    d = documents(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("k"), F.coalesce("lang", F.lit("")).alias("l"), words.alias("t"))
    return d.withColumn("text", filled(form))


def rendered(name: str, fmt: str, form: str, want: str, **options) -> None:
    """Register the query that renders the form; its SQL is the whole expected body."""
    QUERIES[name] = lambda spark, sf: render(corpus(spark, sf, form), fmt, **options)
    ORACLE[name] = f"SELECT doc_id, {filled_sql(want)} AS body FROM {WORDS}"


def formatted(name: str, form: str, want: str, **options) -> None:
    QUERIES[name] = lambda spark, sf: format_documents(corpus(spark, sf, form), **options)
    ORACLE[name] = f"SELECT doc_id, {filled_sql(want)} AS body FROM {WORDS}"


# --- blocks and inlines as HTML ------------------------------------------------------------------

rendered(
    "html_leaf_blocks", "html",
    "{t} *a*\n===\n\nSub {k}\n---\n    code <{k}>\n\n\ttab\n\n~~~ x{l} y\n``` & {k}\n~~~\n* * *\n### H {k} ###\ntail\n",
    "<h1>{t} <em>a</em></h1>\n<h2>Sub {k}</h2>\n<pre><code>code &lt;{k}&gt;\n\ntab\n</code></pre>\n<pre><code class=\"language-x{l}\">``` &amp; {k}\n</code></pre>\n<hr />\n<h3>H {k}</h3>\n<p>tail</p>",
)
rendered(
    "html_containers", "html",
    "> {t}\nlazy {k}\n>\n> - a\nlazy\n\n- one\n\n- two {k}\n\n  more\n1) x\n2) y\n\n- p\n  - q {k}\n    - r\n- s\n\n7. seven\n",
    "<blockquote>\n<p>{t}\nlazy {k}</p>\n<ul>\n<li>a lazy</li>\n</ul>\n</blockquote>\n<ul>\n<li>\n<p>one</p>\n</li>\n<li>\n<p>two {k}</p>\n<p>more</p>\n</li>\n</ul>\n<ol>\n<li>x</li>\n<li>y</li>\n</ol>\n<ul>\n<li>p\n<ul>\n<li>q {k}\n<ul>\n<li>r</li>\n</ul>\n</li>\n</ul>\n</li>\n<li>s</li>\n</ul>\n<ol start=\"7\">\n<li>seven</li>\n</ol>",
)
rendered(
    "html_raw_blocks", "html",
    "<div>\n*{k}*\n</div>\n\nafter *x*\n\n<!-- c\n\n{k} -->\n{t}\n\n<pre>\n\n*p*</pre>\n\n<?php\n\n?>\n\n<a>\n*inline*\n",
    "<div>\n*{k}*\n</div>\n<p>after <em>x</em></p>\n<!-- c\n\n{k} -->\n<p>{t}</p>\n<pre>\n\n*p*</pre>\n<?php\n\n?>\n<a>\n*inline*",
)
rendered(
    "html_inlines", "html",
    "\\*{k}\\* &amp; &copy; &#65; {t}  \nb\\\nc\nd <b>{k}</b> <a@b.co> ``x ` y`` ***a** b* <!-- n --> &nosuch; ![i *e*](/u \"t\") [r][] <br/>\n\n[R]: <u v> 't'\n",
    "<p>*{k}* &amp; © A {t}<br />\nb<br />\nc\nd <b>{k}</b> <a href=\"mailto:a@b.co\">a@b.co</a> <code>x ` y</code> <em><strong>a</strong> b</em> <!-- n --> &amp;nosuch; <img src=\"/u\" alt=\"i e\" title=\"t\" /> <a href=\"u%20v\" title=\"t\">r</a> <br/></p>",
)
rendered(
    "html_emphasis", "html",
    "*{t}* _a_b c_ **d*e*f** *g**h**i* foo*bar*{k} foo_bar_ *m**n* *open ***j*** *k**\n",
    "<p><em>{t}</em> <em>a_b c</em> <strong>d<em>e</em>f</strong> <em>g<strong>h</strong>i</em> foo<em>bar</em>{k} foo_bar_ <em>m**n</em> <em>open <em><strong>j</strong></em> <em>k</em></em></p>",
)
rendered("html_smart", "html", "{t} \"a {k}\" 'b' it's -- c --- d ... e ---- f\n", "<p>{t} “a {k}” ‘b’ it’s – c — d … e –– f</p>", smart=True)
rendered("html_shortcodes", "html", ":ok: {t}\n:ok:\n:none:\n", "<p>✓ {t}\n✓\n:none:</p>", shortcodes={"ok": "✓"})
rendered("html_strikethrough", "html", "~~gone {k}~~ {t} ~single~\n", "<p><del>gone {k}</del> {t} ~single~</p>", extended=True)
rendered("html_links_bare", "html", "https://a.b/{k} x@y.zz {t}\n", "<p><a href=\"https://a.b/{k}\">https://a.b/{k}</a> <a href=\"mailto:x@y.zz\">x@y.zz</a> {t}</p>", extended=True)
rendered(
    "html_footnotes", "html",
    "{t}[^n]\n\n[^n]: about *it* {k}\n",
    "<p>{t}<sup class=\"footnote-ref\"><a href=\"#fn-n\" id=\"fnref-n\">[n]</a></sup></p>\n<section class=\"footnotes\">\n<ol>\n<li id=\"fn-n\">\n<p>about <em>it</em> {k}</p>\n <a href=\"#fnref-n\" class=\"footnote-backref\">↩</a></li>\n</ol>\n</section>",
    extended=True,
)

# --- other writers, whole bodies -------------------------------------------------------------------

_FORM = "# T & {k}\n\nA *b* **c** `d_e` [link](http://x.y/?a=1&b={k}) ![i](p.png)\nsoft {t}\n\n> q {k}\n\n```py\nif a < b:\n```\n\n***\n\n## S 100%\n\nend\n"
_HTML = "<p>A <em>b</em> <strong>c</strong> <code>d_e</code> <a href=\"http://x.y/?a=1&amp;b={k}\">link</a> <img src=\"p.png\" alt=\"i\" />\nsoft {t}</p>\n<blockquote>\n<p>q {k}</p>\n</blockquote>\n<pre><code class=\"language-py\">if a &lt; b:\n</code></pre>\n<hr />\n"
_TEX = "A \\emph{b} \\textbf{c} \\texttt{d\\_e} \\href{http://x.y/?a=1\\&b={k}}{link} \\includegraphics{p.png} soft {t}\n\n\\begin{quote}\nq {k}\n\n\\end{quote}\n\n\\begin{lstlisting}[language=py]\nif a < b:\n\\end{lstlisting}\n\n\\hrule\n"
_LOADS = "\\usepackage[utf8]{inputenc}\n\\usepackage[T1]{fontenc}\n\\usepackage{hyperref}\n"
rendered(
    "xml_whole", "xml", "## T *{k}*\n\n- a\n\n  {t}\n\n3) x  \n   [y](/z 'q')\n\n```{l} i\n<&\n```\n",
    '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE document SYSTEM "CommonMark.dtd">\n<document>\n<heading level="2">\n<text>T </text><emph>\n<text>{k}</text></emph>\n</heading>\n<list type="bullet">\n<item>\n<paragraph>\n<text>a</text></paragraph>\n<paragraph>\n<text>{t}</text></paragraph>\n</item>\n</list>\n<list type="ordered" start="3" delim="paren" tight="true">\n<item>\n<paragraph>\n<text>x</text><linebreak /><link destination="/z" title="q">\n<text>y</text></link>\n</paragraph>\n</item>\n</list>\n<code_block info="{l} i">&lt;&amp;\n</code_block></document>\n',
)
rendered("latex_whole", "latex", _FORM, "\\section*{T \\& {k}}\n" + _TEX + "\n\\subsection*{S 100\\%}\nend\n\n")
rendered(
    "latex_document", "latex", "{t}\n\n- a\n- b {k}\n",
    "\\documentclass{article}\n\n" + _LOADS + "\\usepackage{listings}\n\\usepackage{graphicx}\n\n\\begin{document}\n\n{t}\n\n\\begin{itemize}\n\\item a\n\n\n\\item b {k}\n\n\n\\end{itemize}\n\n\\end{document}\n", standalone=True,
)
rendered(
    "beamer_whole", "beamer", _FORM,
    "\\documentclass{beamer}\n\n" + _LOADS + "\\usetheme{Madrid}\n\\usecolortheme{default}\n\\usepackage{ulem}\n\\usepackage{listings}\n\n\\title{T \\& {k}}\n\\date{\\today}\n\n\\begin{document}\n\n\\frame{\\titlepage}\n\n\\section{T \\& {k}}\n\n\\begin{frame}[fragile]{T \\& {k}}\n"
    + _TEX + "\\end{frame}\n\n\\begin{frame}[fragile]{S 100\\%}\nend\n\\end{frame}\n\n\\end{document}\n",
)
rendered(
    "revealjs_whole", "revealjs", _FORM,
    '<!doctype html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>T &amp; {k}</title>\n<link rel="stylesheet" href="dist/reveal.css">\n<link rel="stylesheet" href="dist/theme/white.css">\n</head>\n<body>\n<div class="reveal">\n<div class="slides">\n<section>\n<h2>T &amp; {k}</h2>\n'
    + _HTML + '</section>\n<section>\n<h2>S 100%</h2>\n<p>end</p>\n</section>\n</div>\n</div>\n<script src="dist/reveal.js"></script>\n<script>Reveal.initialize();</script>\n</body>\n</html>\n',
)
rendered("page_whole", "page", _FORM, '<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>T &amp; {k}</title>\n</head>\n<body>\n<h1>T &amp; {k}</h1>\n' + _HTML + "<h2>S 100%</h2>\n<p>end</p>\n</body>\n</html>\n")
rendered("bibtex_whole", "bibtex", "# T {k}\n\n{t}\nx\n\n```bib\n@book{a{k},\n}\n```\n", "% T {k}\n% {t} x\n@book{a{k},\n}\n\n")

# --- the formatter ---------------------------------------------------------------------------------

formatted(
    "fmt_blocks",
    "Title\n===\n{t}\n* a\n* b\n\npar {k}\n+ c\n\n+ d\n\n3. x\n4. y\n\n````\n```\n````\n\n    ind {k}\n\n- - -\n\n***\n",
    "Title\n=====\n\n{t}\n\n- a\n- b\n\npar {k}\n\n- c\n\n- d\n\n3. x\n4. y\n\n````\n```\n````\n\n    ind {k}\n\n---\n\n***",
)
formatted("fmt_inlines", "__s__ _e_ ` `` ` <b>{k}</b>  \nx \\*y\\* [l](</a b> 'q') ![i](j) <http://z.y> {t}\n", "**s** *e* ` `` ` <b>{k}</b>\\\nx \\*y\\* [l](/a%20b \"q\") ![i](j) <http://z.y> {t}")
formatted("fmt_quotes", "> {t}\n> > inner {k}\nlazy\n>\n> - x\n>   y\n", "> {t}\n>\n> > inner {k}\n> > lazy\n>\n> - x\n>   y")
formatted("fmt_tables", "{t}\n\n|a|long|c|\n|:---|---:|:---:|\n|one|y|\n||2|three\n", "{t}\n\n| a   | long |   c   |\n|:----|-----:|:-----:|\n| one |    y |       |\n|     |    2 | three |")

# --- rows of nodes ---------------------------------------------------------------------------------


def from_words(select: str) -> str:
    return f"SELECT {select} FROM {WORDS}"


@query(from_words("doc_id, unnest([1, 2, 3, 4]) AS ord, unnest(['a^k ' || k, 'x$$y', 'd{$}', chr(10) || t || chr(10)]) AS literal, unnest([false, false, true, true]) AS display"))
def math_spans(spark, sf):
    docs = corpus(spark, sf, "$a^k {k}$ *$x$$y$*\n$$d{$}$$\n$$$ and $\n\n$$\n{t}\n$$\n\n$open\n")
    n = N.parse_nodes(docs, kinds=("math",))
    return X._ordered(n, "math").select("doc_id", "ord", "literal", F.col("display_math").alias("display"))


_NEST = "# H {k}\n\n- a {k}\n  - b\n    1. {t}\n  - c\n- d\n\n> - q\n\nend *x* `y` z\n"


@query(from_words("doc_id, unnest(['a ' || k, 'b', t, 'c', 'd', 'q']) AS text, unnest([1, 2, 3, 2, 1, 1]) AS list_depth"))
def list_depths(spark, sf):
    n = N.with_list_depth(nodes_once(corpus(spark, sf, _NEST), columns=("node_id", "parent_id", "subtree_end", "kind", "text_content")))
    items = n.where("kind = 'item'").select("doc_id", F.col("node_id").alias("parent_id"), "list_depth")
    texts = n.where("kind = 'paragraph'").select("doc_id", "parent_id", F.col("text_content").alias("text"))
    return items.join(texts, ["doc_id", "parent_id"]).select("doc_id", "text", "list_depth")


@query(from_words("doc_id, 'list' AS of_kind, unnest(['before', 'after', 'after']) AS side, unnest(['heading', 'block_quote', 'paragraph']) AS kind"))
def sibling_rows(spark, sf):
    n = nodes_once(corpus(spark, sf, _NEST))
    of = n.where("kind = 'list' and depth = 1")
    both = N.preceding_siblings(n, of).withColumn("side", F.lit("before")).unionByName(N.following_siblings(n, of).withColumn("side", F.lit("after")))
    return both.select("doc_id", F.lit("list").alias("of_kind"), "side", "kind")


@query(from_words("doc_id, 'H ' || k AS first_heading, 1 AS level, 'end   z' AS direct, 'end x  z' AS whole"))
def direct_texts(spark, sf):
    """The first heading, and the last paragraph's own text beside its whole text."""
    n = nodes_once(corpus(spark, sf, _NEST), kinds=("heading", "paragraph", "text"), columns=("node_id", "parent_id", "sibling_ord", "depth", "kind", "literal", "text_content", "level"))
    last = n.where("kind = 'paragraph' and depth = 1").select("doc_id", "node_id", F.col("text_content").alias("whole"))
    own = last.join(N.direct_text(n), ["doc_id", "node_id"]).select("doc_id", F.col("text").alias("direct"), "whole")
    return N.first_headings(n).select("doc_id", F.col("text").alias("first_heading"), "level").join(own, "doc_id")


@query(from_words("doc_id, unnest(['heading', 'list', 'block_quote', 'paragraph']) AS kind, unnest([true, true, true, true]) AS has_children, unnest([1, 11, 4, 5]) AS below"))
def subtree_sizes(spark, sf):
    """Top-level blocks: whether they have children, and how many nodes lie below them."""
    n = N.with_has_children(N.parse_nodes(corpus(spark, sf, "# H {k}\n\n- {t}\n  - b\n    - c\n\n> - q\n\nend *x* `y`\n")))
    return n.where("depth = 1").select("doc_id", "kind", "has_children", (F.col("subtree_end") - F.col("node_id")).alias("below"))


@query(from_words("doc_id, CAST(unnest(range(1, 10)) AS INTEGER) AS node_id, unnest(['heading', 'text', 'text', 'text', 'thematic_break', 'paragraph', 'text', 'text', 'thematic_break']) AS kind, unnest([0, 1, 1, 1, 0, 0, 6, 6, 0]) AS parent_id, unnest([4, 2, 3, 4, 5, 8, 7, 8, 9]) AS subtree_end, unnest([0, 0, 1, 2, 1, 2, 0, 1, 3]) AS sibling_ord, unnest([NULL, 'H', 'behind ' || k, 'last', NULL, NULL, t, 'more', NULL]) AS literal"))
def leaves_added(spark, sf):
    """Leaves appended to and put behind nodes; ids and intervals are numbered anew."""
    n = nodes_once(corpus(spark, sf, "# H\n\n{t}\n"), columns=("node_id", "parent_id", "sibling_ord", "depth", "subtree_end", "kind", "is_block", "is_leaf", "literal"))
    leaf = lambda kind, literal: F.struct(F.lit(kind).alias("kind"), F.lit(literal).cast("string").alias("literal"))
    put = [(1, "child", 0, leaf("text", "last")), (1, "after", 0, leaf("thematic_break", None)), (3, "child", 0, leaf("text", "more")), (0, "child", 0, leaf("thematic_break", None))]
    added = documents(spark, sf).select("doc_id", F.explode(F.array(
        F.struct(F.lit(2).alias("anchor_id"), F.lit("after").alias("place"), F.lit(0).alias("ord"), F.struct(F.lit("text").alias("kind"), F.concat(F.lit("behind "), F.col("doc_id").cast("string")).alias("literal")).alias("leaf")),
        *(F.struct(F.lit(a).alias("anchor_id"), F.lit(p).alias("place"), F.lit(o).alias("ord"), x.alias("leaf")) for a, p, o, x in put),
    )).alias("x")).select("doc_id", "x.anchor_id", "x.place", "x.ord", "x.leaf.*")
    return N.with_leaves(n, added).where("node_id > 0").select("doc_id", "node_id", "kind", "parent_id", "subtree_end", "sibling_ord", "literal")


# --- whole statistics, JSON and CSV -----------------------------------------------------------------


@query(from_words("doc_id, 13::BIGINT AS lines, 19 + len(string_split(t, ' ')) AS words, 49 + length(k) + length(replace(t, ' ', '')) AS characters, 1::BIGINT AS headings, 1::BIGINT AS h2, 1::BIGINT AS links, 1::BIGINT AS lists, 3::BIGINT AS list_items, 3::BIGINT AS task_items, 2::BIGINT AS checked, 1::BIGINT AS unchecked, 2::BIGINT AS code_blocks, '(none)=1 py=1' AS languages"))
def document_stats(spark, sf):
    docs = corpus(spark, sf, "## H {k}\n\n{t} [a](b)\n\n- [x] one\n- [ ] two\n- [X] three\n\n```py x\n1\n```\n\n    indented\n")
    x = X.document_stats(docs)
    names = F.array_join(F.transform("languages", lambda e: F.concat(e["language"], F.lit("="), e["n"].cast("string"))), " ")
    return x.select("doc_id", "lines", "words", "characters", "headings", "h2", "links", "lists", "list_items", "task_items", "checked", "unchecked", "code_blocks", names.alias("languages"))


@query(from_words("doc_id, '[{\"text\":\"' || t || '\",\"url\":\"/u/' || k || '\"},{\"text\":\"b\",\"url\":\"c%22\"}]' AS json"))
def links_json(spark, sf):
    return X.as_json(X.links(N.parse_nodes(corpus(spark, sf, "[{t}](/u/{k}) and [b](c\")\n"), kinds=("link",))), "text", "url")


@query(from_words("doc_id, 'a,\"b, c\"' || chr(10) || k || ',\"x \"\"y\"\"\"' || chr(10) || chr(10) || chr(10) || 'h' || chr(10) || t || chr(10) AS csv"))
def tables_csv(spark, sf):
    return X.tables_csv(X.tables(N.parse_nodes(corpus(spark, sf, "| a | b, c |\n|---|---|\n| {k} | x \"y\" |\n\n| h |\n|---|\n| {t} |\n"))))


# --- small column functions --------------------------------------------------------------------------


@query(from_words("doc_id, ' id=\"i' || k || '\" class=\"c1 c2\" a=\"x &lt; &quot;y\" z=\"1\"' AS html, 'i' || k AS id, 2 AS classes, '' AS bare"))
def attributes(spark, sf):
    a = C.attributes(F.concat("t", F.lit(" {#i"), "k", F.lit(" .c1 .c2 z=1 a='x < \"y'}")))
    d = corpus(spark, sf, "{t}")
    return d.select("doc_id", C.attributes_html(a).alias("html"), a["id"].alias("id"), F.size(a["classes"]).alias("classes"), C.attributes_html(C.attributes(F.concat("t", F.lit(" {}")))).alias("bare"))


@query(from_words("doc_id, 'a ' || k || chr(10) || chr(10) || '  ' || t || chr(10) || ' b' AS text, chr(10) AS blank"))
def minimize_indent(spark, sf):
    d = corpus(spark, sf, "  a {k}\n\n    {t}\n   b\n")
    return d.select("doc_id", C.minimize_indent(F.col("text")).alias("text"), C.minimize_indent(F.lit("\n")).alias("blank"))


@query(from_words("doc_id, ext, mime, split_part(mime, '/', 1) = 'image' AS image, split_part(mime, '/', 1) = 'text' AS text, split_part(mime, '/', 1) = 'font' AS font, CASE WHEN mime = 'image/jpeg' THEN 'jpg' WHEN mime = 'text/x-c++' THEN 'cpp' ELSE lower(ext) END AS back").replace("FROM (", "FROM (VALUES ('JPEG', 'image/jpeg'), ('js', 'text/javascript'), ('tex', 'text/x-tex'), ('woff2', 'font/woff2'), ('hpp', 'text/x-c++'), ('7z', 'application/x-7z-compressed'), ('mkv', 'video/x-matroska')) AS e(ext, mime), (", 1))
def mime_kinds(spark, sf):
    x = corpus(spark, sf, "{t}").select("doc_id", "k", F.explode(F.array(*(F.lit(e) for e in ("JPEG", "js", "tex", "woff2", "hpp", "7z", "mkv")))).alias("ext"))
    m = C.mime_type(F.concat(F.lit("dir.d/file"), "k", F.lit("."), "ext"))
    return x.select("doc_id", "ext", m.alias("mime"), C.is_image(m).alias("image"), C.is_text(m).alias("text"), C.is_font(m).alias("font"), C.extension_of_mime(F.concat(m, F.lit("; charset=utf-8"))).alias("back"))


@query(from_words("doc_id, true AS struck, false AS plain, 'color: red; size: ' || k AS style, true AS blank_is_null"))
def strike_and_style(spark, sf):
    d = corpus(spark, sf, "a ~~{t}~~")
    style = C.inline_style(F.concat(F.lit(" color: red; size: "), "k", F.lit(" ")))
    return d.select("doc_id", C.has_strikethrough(F.col("text")).alias("struck"), C.has_strikethrough(F.col("t")).alias("plain"), C.css_text(style).alias("style"), C.inline_style(F.lit("  ")).isNull().alias("blank_is_null"))


@query(from_words("doc_id, 'ab ' || k || ' 你 好' AS spaced, 5 AS width, '<1>' AS row, true AS is_row, true AS is_delimiter, 'n' || k AS note, true AS toc").replace("'ab ' || k || ' 你 好'", "'ab' || k || ' 你好'").replace("'<1>'", "'x|y'"))
def line_tests(spark, sf):
    """Predicates and small functions of a line: wide text, table rows, note labels, contents markers."""
    d = corpus(spark, sf, "{t}")
    row = F.concat(F.lit("| x | y |"))
    return d.select(
        "doc_id", C.cjk_spacing(F.concat(F.lit("ab"), "k", F.lit("你好"))).alias("spaced"), C.display_width(F.lit("a你好")).alias("width"), F.array_join(C.row_cells(row), "|").alias("row"), C.is_table_row(row).alias("is_row"),
        C.is_delimiter_row(F.lit("|---|:---:|")).alias("is_delimiter"), C.footnote_label(F.concat(F.lit("[^n"), "k", F.lit("]: x"))).alias("note"), C.is_toc_marker(F.lit("[TOC]")).alias("toc"),
    )

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.kernel import writers
from quillspark.kernel.blocks import parse
from quillspark.kernel.extended import extend
from quillspark.kernel.html import to_html
from quillspark.kernel.inlines import normalize_label, unescape
from quillspark.kernel.markdown import to_markdown, wrap
from quillspark.kernel.tree import FIELDS, rows_of, walk

CASES = [
    ("## A #", "<h2>A</h2>"),
    ("Title\n===", "<h1>Title</h1>"),
    ("Two\nlines\n---", "<h2>Two\nlines</h2>"),
    ("#nope", "<p>#nope</p>"),
    ("~~~ Py x\na < b\n~~~", '<pre><code class="language-Py">a &lt; b\n</code></pre>'),
    ("    code\n\n      more", "<pre><code>code\n\n  more\n</code></pre>"),
    ("\tcode", "<pre><code>code\n</code></pre>"),
    ("> a\nlazy\n\nb", "<blockquote>\n<p>a\nlazy</p>\n</blockquote>\n<p>b</p>"),
    ("- a\n- b", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>"),
    ("- a\n\n- b", "<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ul>"),
    ("- a\n  - b\n\n- c", "<ul>\n<li>\n<p>a</p>\n<ul>\n<li>b</li>\n</ul>\n</li>\n<li>\n<p>c</p>\n</li>\n</ul>"),
    ("3) x\n4) y", '<ol start="3">\n<li>x</li>\n<li>y</li>\n</ol>'),
    ("- a\n+ b", "<ul>\n<li>a</li>\n</ul>\n<ul>\n<li>b</li>\n</ul>"),
    ("- a\n b", "<ul>\n<li>a b</li>\n</ul>"),
    ("***\n---\n_ _ _", "<hr />\n<hr />\n<hr />"),
    ("a | b\n---|:---:\n1 | 2", "<table>\n<thead>\n<tr>\n<th>a</th>\n<th>b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1</td>\n<td>2</td>\n</tr>\n</table>"),
    ("*a* **b** ***c***", "<p><em>a</em> <strong>b</strong> <em><strong>c</strong></em></p>"),
    ("snake_case_word and 2*3*4", "<p>snake_case_word and 2<em>3</em>4</p>"),
    ("*a _b* c_", "<p><em>a _b</em> c_</p>"),
    ("`` a`b `` and `x", "<p><code>a`b</code> and `x</p>"),
    ("\\*a\\* &amp; &copy; &#65; &nope;", "<p>*a* &amp; © A &amp;nope;</p>"),
    ("a  \nb\\\nc\nd", "<p>a<br />\nb<br />\nc\nd</p>"),
    ("[t](/u \"q\") ![i *m*](/p.png)", '<p><a href="/u" title="q">t</a> <img src="/p.png" alt="i m" /></p>'),
    ("[t][K]\n\n[k]: /u 'x'\n[k]: /other", '<p><a href="/u" title="x">t</a></p>'),
    ("[a [b](c)](d)", '<p>[a <a href="c">b</a>](d)</p>'),
    ("<https://e.org/a b> <https://e.org> <me@e.org>", '<p>&lt;https://e.org/a b&gt; <a href="https://e.org">https://e.org</a> <a href="mailto:me@e.org">me@e.org</a></p>'),
    ("[x](javascript:alert)", '<p><a href="#">x</a></p>'),
    ("[x](/é ö)", "<p>[x](/é ö)</p>"),
    ("[x](</é ö>)", '<p><a href="/%C3%A9%20%C3%B6">x</a></p>'),
    ("<div>\n*a*\n</div>\n\nb", "<div>\n*a*\n</div>\n<p>b</p>"),
    ("<xp>\nb", "<xp>\nb"),
    ("a <b class=\"x\">c</b> <script>d</script>", '<p>a <b class="x">c</b> &lt;script&gt;d&lt;/script&gt;</p>'),
    ("$x^2$ then $$$", "<p>$x^2$ then $$$</p>"),
    ("", ""),
]


@pytest.mark.parametrize("text,html", CASES)
def test_html(text, html):
    assert to_html(parse(text)) == html


@pytest.mark.parametrize("text", ["$$$", "<é", "&#", "&#x", "&#xé", "[" * 5000, ">" * 2000, "*a " * 5000, "`" * 3000, "![" * 3000 + "]" * 3000, "- " * 500 + "x", "|\n" * 50 + "---|", "\0a", "﻿# x", "[a]: <\n[b]: x 'y", "\t- \t> x", "* *\n*\t*"])
def test_total_and_fast(text):
    began = time.time()
    root = parse(text)
    rows_of(root), to_html(root), to_markdown(root), writers.to_xml(root), writers.to_latex(root)
    assert time.time() - began < 5


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab *_`[]()<>!#-+=|\\&$:\n\t1.>~é字", max_size=80))
def test_any_text(text):
    root = parse(text)
    rows = rows_of(extend(root))
    names = [n for n, _ in FIELDS]
    ids, parents, ends = (names.index(x) for x in ("node_id", "parent_id", "subtree_end"))
    for i, r in enumerate(rows):
        assert r[ids] == i <= r[ends] < len(rows)
        if r[parents] is not None:
            p = rows[r[parents]]
            assert p[ids] < i <= r[ends] <= p[ends]
    to_html(root), to_markdown(root, 20), writers.to_xml(root), writers.to_beamer(root), writers.to_bibtex(root)


def test_smart():
    assert to_html(parse("\"a\" 'b' it's -- --- ... ----", smart=True)) == "<p>“a” ‘b’ it’s – — … ––</p>"


def test_shortcodes_at_token_start():
    assert to_html(parse(":ok: a :ok:", shortcodes={"ok": "✓"})) == "<p>✓ a :ok:</p>"


def test_task_flag_core_and_extended():
    root = parse("- [X] done\n- [ ] open\n- plain")
    assert [bool(n.at.get("is_task_list")) for n in walk(root) if n.kind == "item"] == [True, True, False]
    assert "[X] done" in to_html(root)
    assert to_html(extend(root)).count("checkbox") == 2


def test_extended_spans():
    html = to_html(extend(parse("~~a~~ b~~c see https://e.org/x. and me@e.org")))
    assert html == '<p><del>a</del> b~~c see <a href="https://e.org/x">https://e.org/x</a>. and <a href="mailto:me@e.org">me@e.org</a></p>'


@pytest.mark.parametrize(
    "text,out",
    [
        ("* a\n* b", "- a\n- b"),
        ("Title\n==", "Title\n====="),
        ("a | b\n---|:---:\n1 | 22", "| a   |  b  |\n|-----|:---:|\n| 1   | 22  |"),
        ("1. a\n1. b", "1. a\n2. b"),
        ("- a\n  - b", "- a\n    - b"),
        ("~~~\nx\n~~~", "~~~\nx\n~~~"),
        ("````\n```\n````", "````\n```\n````"),
        ("a\\*b 1\\. c", "a\\*b 1. c"),
        ("[a](b 'c')", '[a](b "c")'),
        ("> a\n\n> b", "> a\n\n> b"),
    ],
)
def test_format(text, out):
    assert to_markdown(parse(text)) == out


SAFE = st.lists(st.sampled_from(["word", "*em*", "**strong**", "`code`", "[l](/u)", "![i](/p)", "a\\*b", "&lt;", "x_y", "1 + 2", "end."]), min_size=1, max_size=12).map(" ".join)
BLOCK = st.one_of(SAFE, SAFE.map(lambda s: "# " + s), SAFE.map(lambda s: "> " + s), st.lists(SAFE, min_size=1, max_size=3).map(lambda x: "\n".join("- " + i for i in x)), st.just("```py\nx = 1\n```"), st.just("***"), st.just("a | b\n---|---\n1 | 2"))


@settings(max_examples=120, deadline=None)
@given(st.lists(BLOCK, min_size=1, max_size=5).map("\n\n".join))
def test_format_round_trip(text):
    """Formatting keeps the rendering, and is idempotent."""
    once = to_markdown(parse(text))
    assert to_markdown(parse(once)) == once
    same = lambda t: to_html(parse(t)).replace("\n", "")
    assert same(once) == same(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=9), st.integers(8, 30))
def test_wrap_is_optimal(words, width):
    def cost(lines):
        total = 0
        for i, x in enumerate(lines):
            last = i == len(lines) - 1
            slack = width - len(" ".join(x)) - (not last)  # the space at a line's end counts
            total += 100 * slack * slack if slack < 0 else 0.1 * slack if last else slack * slack
        return total

    best = float("inf")
    for mask in range(2 ** (len(words) - 1)):
        lines, line = [], [words[0]]
        for i, w in enumerate(words[1:]):
            if mask >> i & 1:
                lines.append(line)
                line = []
            line.append(w)
        best = min(best, cost([*lines, line]))
    got = [x.split() for x in wrap(" ".join(words), width)]
    assert sum(got, []) == words and abs(cost(got) - best) < 1e-6


def test_writers():
    root = parse("# T & U\n\n## F\n\n*a* `b`\n\n1. x\n\n## G\n\n```tex\ny\n```")
    assert writers.to_latex(root).startswith("\\section*{T \\& U}")
    beamer = writers.to_beamer(root)
    assert beamer.count("\\begin{frame}") == 2 and beamer.count("\\texttt{b}") == 1
    assert writers.to_revealjs(root).count("<section>") == 3
    xml = writers.to_xml(root)
    assert '<heading level="1">' in xml and '<list type="ordered" delim="period" tight="true">' in xml
    assert writers.to_bibtex(root).startswith("% T & U")
    assert "<title>T &amp; U</title>" in writers.to_page(root)


def test_unescape_and_labels():
    assert unescape("a\\_b &amp; &#x41; \\q") == "a_b & A \\q"
    assert normalize_label(" Foo\n  bar ") == "FOO BAR" and normalize_label("ẞ") == normalize_label("SS")


def test_footnotes_html():
    html = to_html(extend(parse("a[^x] b[^y]\n\n[^x]: note *one*\n\n[^z]: unused")))
    assert html.startswith('<p>a<sup class="footnote-ref"><a href="#fn-x" id="fnref-x">[x]</a></sup>')
    assert html.count('<li id="fn-') == 1 and '<p>note <em>one</em></p>\n <a href="#fnref-x" class="footnote-backref">↩</a></li>' in html


def test_format_text_with_contents():
    from quillspark.kernel.markdown import format_text

    assert format_text("# A\n[TOC]: #\n- old\n1. old\n\ntext\n\n## B C") == "# A\n\n[TOC]: #\n\n- [A](#a)\n  - [B C](#b-c)\n\ntext\n\n## B C"
    assert format_text("* a") == "- a"
    assert to_markdown(parse("- a"), bullet="+") == "+ a"


@pytest.mark.parametrize("opener", ["a <!-- ", "a <? ", "a <![CDATA[ ", "a <!X "])
def test_unclosed_html_is_linear(opener):
    import time

    began = time.time()
    parse(opener * 8000)
    assert time.time() - began < 3


def test_nested_lists_grow_with_the_text():
    """Blanks before a line are walked once, not once for every open list: four times the text, about four times the time."""

    def took(levels):
        text = "\n".join("  " * i + "- x" for i in range(levels))
        began = time.process_time()
        root = parse(text)
        return time.process_time() - began, len(rows_of(root))

    took(100)
    (short, a), (long, b) = took(300), took(600)
    assert (a, b) == (1201, 2401) and long < 3 and long < 12 * short + 0.2

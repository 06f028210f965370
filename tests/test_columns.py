"""Column functions on small inputs, and plans that stay in generated code."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions import scalars as P
from quillspark.operators import extract as X
from quillspark.operators import nodes as N
from quillspark.operators.render import render
from quillspark.sources import text as T
from quillspark.streaming import streams as S


def one(spark, make, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(make(F.col("t"))).collect()]


@pytest.mark.parametrize(
    "make,given,want",
    [
        (C.anchor_ascii, ["A  b_c!", "1 x", "é", "-a-"], ["a-b-c", "h-1-x", "heading", "-a"]),
        (C.slug_cli, ["Ab C_d É!"], ["ab-cd-é"]),
        (C.escape_latex, ["\\{a}_%'"], ["\\textbackslash{}\\{a\\}\\_\\%\\textquotesingle{}"]),
        (C.escape_man, ["a-b.c\\'"], ["a\\-b\\&.c\\e\\&'"]),
        (C.unescape_xml, ["&amp;lt;&lt;"], ["&lt;<"]),
        (C.escape_xml_attr, ["a\n\"'"], ["a&#10;&quot;&apos;"]),
        (C.xml_to_bool, ["Yes", "0", "x"], [True, False, None]),
        (C.is_safe_url, ["JavaScript:x", "data:image/png;base64,", "data:text/html,", "ftp://x", "/a", "a\nb", "x" * 8193, "&#106;"], [False, True, False, False, True, False, False, False]),
        (C.is_valid_url, ["http://a b", "mailto:x", "mailto:x@y"], [False, False, True]),
        (C.escape_href, ["javascript:x", " ", "/a?b&c'"], ["#", "", "/a?b&amp;c&#x27;"]),
        (C.data_uri_mime, ["data:,x", "data:image/gif;base64,AA", "x"], ["text/plain", "image/gif", None]),
        (C.bare_urls, ["see https://e.org/a. ok http://x"], [["https://e.org/a", "http://x"]]),
        (C.bare_emails, ["me@e.org, x@y"], [["me@e.org"]]),
        (C.mime_type, ["a/b.PNG", "x.tar.gz", "none"], ["image/png", "application/gzip", None]),
        (C.extension_of_mime, ["text/html; charset=utf-8", "a/b"], ["html", None]),
        (C.mime_charset, ['text/html; charset="UTF-8"', "text/html"], ["UTF-8", None]),
        (C.cell_alignment, [":-:", ":-", "-:", "-"], ["center", "left", "right", "none"]),
        (C.is_delimiter_row, ["| --- |:---:|", "---", "--|--", "a|---"], [True, False, False, False]),
        (C.row_cells, ["| a | b|c |"], [["a", "b", "c"]]),
        (C.task_marker, ["[x] a", "[ ] b", "[y]"], [True, False, None]),
        (C.is_task_line, ["- [x] a", "  2. [ ] b", "[x] c"], [True, True, False]),
        (C.struck, ["~~a~~ ~b~ ~~~c~~~ ~~d e~~"], [["a", "d e"]]),
        (C.is_toc_marker, [" [TOC] ", "[[toc]]", "<!-- TOC -->", "toc"], [True, True, True, False]),
        (C.filter_html, ["<SCRIPT x>é</script> <b> <scripts>"], ["&lt;SCRIPT x&gt;é&lt;/script&gt; <b> <scripts>"]),
        (C.abbreviation_term, ["*[HTML]: Hyper", "x"], ["HTML", None]),
        (C.abbreviation_text, ["*[HTML]:  Hyper Text"], ["Hyper Text"]),
        (C.attribute_id, ["# A {#x .c k=v}", "none"], ["x", None]),
        (C.attribute_classes, ["# A {.a .b}"], [["a", "b"]]),
        (C.definition_text, [": def", "x"], ["def", None]),
        (C.footnote_label, ["[^a]: note", "[^a] x"], ["a", None]),
        (C.footnote_refs, ["x[^a] y[^b]\n[^a]: d"], [["a", "b"]]),
        (C.smart_dashes, ["a--b---c..."], ["a–b—c…"]),
        (C.cjk_spacing, ["中文abc中1"], ["中文 abc 中 1"]),
        (C.display_width, ["a中", "é", "한"], [3, 1, 2]),
        (C.count_syllables, ["The coffee made tsk! 1 apple", ""], [5, 0]),
        (C.count_lines, ["", "a", "a\n", "a\nb"], [0, 1, 1, 2]),
        (lambda t: C.wrap_text(t, 5), ["aa bb cc dddddd e"], ["aa bb\ncc\ndddddd\ne"]),
        (lambda t: C.truncate(t, 5), ["abcde", "abcdef"], ["abcde", "ab..."]),
        (lambda t: C.get_lines(t, 2, 1), ["a\nb\nc"], [["b"]]),
        (C.front_matter_raw, ["---\na: 1\n---\nbody", "x", "---\na: --- b\nc"], ["a: 1\n", None, None]),
        (C.strip_front_matter, ["---\na: 1\n---\n\nbody"], ["body"]),
    ],
)
def test_function(spark, make, given, want):
    assert one(spark, make, *given) == want


def test_nulls_give_nulls(spark):
    for f in (C.anchor_ascii, C.escape_latex, C.is_safe_url, C.bare_urls, C.task_marker, C.parse_css, C.count_syllables, C.display_width):
        assert one(spark, f, None) in ([None], ["heading"]) or f is C.parse_css


def test_maps(spark):
    raw = "a: 1\n# no\nb: 'q'\n- x: y\na: 2"
    assert one(spark, lambda t: C.front_matter_map(t), raw) == [{"a": "2", "b": "q"}]
    assert one(spark, lambda t: C.css_text(C.parse_css(t)), "B: 1; a:2;b:3;;x") == ["a: 2; b: 3"]
    assert one(spark, lambda t: C.attribute_map(t), "x {k=v w='a b'}") == [{"k": "v", "w": "a b"}]


def test_scalars_agree(spark):
    urls = ["javascript:x", "data:image/png;base64,", "ftp:x", "/a'b`", "", "http://e.org?a=1&b"]
    assert one(spark, C.escape_href, *urls) == [P.escape_href(u) for u in urls]
    texts = ["a_b\\{~^", "\"'`|<>"]
    assert one(spark, C.escape_latex, *texts) == [P.escape_latex(t) for t in texts]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_nodes_and_limits(spark):
    d = docs(spark, "# A\n\nx", None, "", "y" * 50)
    n = N.parse_nodes(d)
    assert n.where("kind = 'document'").count() == 4
    assert n.where("kind = 'heading'").select("text_content").first()[0] == "A"
    assert [r[0] for r in d.where(~N.within_limits(F.col("text"), max_line=40)).select("doc_id").collect()] == [3]
    plan = n.where("kind = 'heading'").select("doc_id", "level")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_navigation(spark):
    n = N.parse_nodes(docs(spark, "# H\n\n- a\n- b\n\ntext"))
    lists = n.where("kind = 'list'")
    assert N.children(n, lists).count() == 2
    assert N.governed_by_heading(n).where("kind = 'paragraph' and heading_id is null").count() == 0
    assert N.without_subtrees(n, lists).where("kind = 'item'").count() == 0


def test_toc_and_anchors(spark):
    n = N.parse_nodes(docs(spark, "# A\n\n## B\n\n## C\n\n# A\n\n## B\n\n# A-1"))
    assert [r["number"] for r in X.toc(n).orderBy("ord").collect()] == ["1", "1.1", "1.2", "2", "2.1", "3"]
    assert [r["anchor"] for r in X.unique_anchors(n).orderBy("ord").collect()] == ["a", "b", "c", "a-1", "b-1", "a-1-1"]


def test_toc_options(spark):
    o = spark.range(1).select(*(c.alias(k) for k, c in X.toc_options(F.lit("[TOC levels=2-9 numbered no-links]:")).items())).first()
    assert (o["low"], o["high"], o["numbered"], o["links"]) == (2, 6, True, False)


def test_render_formats(spark):
    d = docs(spark, "# T\n\n*x*", None)
    for fmt in ("html", "xml", "latex", "beamer", "revealjs", "page", "bibtex", "commonmark"):
        assert render(d, fmt).count() == 2
    with pytest.raises(ValueError):
        render(d, "docx")
    T.register_format("shout", lambda root: "X")
    assert render(d, "shout").first()["body"] == "X"


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("﻿# A\n")
    (tmp_path / "b.md").write_text("b")
    got = {r["name"]: r["text"] for r in T.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "# A\n", "b.md": "b"}
    s = T.concat_sources(T.sources(spark, [("string", "1", "a\nb"), ("string", "2", "c")])).first()
    assert (s["text"], s["n_lines"], s["n_chars"]) == ("a\nb\nc", 3, 4)
    bag = spark.createDataFrame([("x.png", bytearray(b"1")), ("y.png", bytearray(b"1"))], "path string, content binary")
    assert T.media_bag(bag).count() == 1
    T.write_rendered(docs(spark, "a"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first()["body"] == "<p>a</p>"


def test_late_events_and_sessions(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:05:00")]
    e = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.to_timestamp("ts")).withColumn("event_type", F.lit("a")).withColumn("value", F.lit(1.0))
    assert S.event_counts(e).count() == 2
    assert S.event_counts(e, slide="30 minutes").count() > 2
    assert sorted(r["n"] for r in S.session_counts(e).collect()) == [1, 1, 2]


def test_smart_dashes_of_every_run(spark):
    """The column and the parser agree on runs of hyphens of every length."""
    from quillspark.kernel.inlines import _dashes

    texts = ["a" + "-" * n + "b" for n in range(30)] + ["-" * 4 + " x--y " + "-" * 9 + "-z"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert {r["k"]: r["s"] for r in df.select("k", C.smart_dashes(F.col("t")).alias("s")).collect()} == {i: _dashes(t) for i, t in enumerate(texts)}


def test_data_urls_need_an_end_of_type(spark):
    from quillspark.functions.scalars import is_safe_url

    urls = ["data:image/png,x", "data:image/png;base64,x", "data:image/pngx;text/html,x", "data:image/svg+xml,x", "data:image/png;text/html,x"]
    df = spark.createDataFrame(list(enumerate(urls)), "k int, u string")
    assert [r[0] for r in df.orderBy("k").select(C.is_safe_url(F.col("u"))).collect()] == [is_safe_url(u) for u in urls] == [True, True, False, False, False]


def test_validate_parses_once(spark):
    from quillspark.plans import catalog

    plan = catalog.QUERIES["validate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1

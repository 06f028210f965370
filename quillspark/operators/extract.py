"""Extracts, statistics, contents, checks and slides, as queries over the node table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .nodes import parse_nodes
from .staging import stage


def _ordered(nodes: DataFrame, kind: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("node_id")
    return nodes.where(F.col("kind") == kind).withColumn("ord", F.row_number().over(w))


def headings(nodes: DataFrame, level: int | None = None) -> DataFrame:
    n = nodes if level is None else nodes.where(F.col("level") == level)
    return _ordered(n, "heading").select("doc_id", "ord", "level", F.col("text_content").alias("text"))


def links(nodes: DataFrame) -> DataFrame:
    return _ordered(nodes, "link").select("doc_id", "ord", F.col("text_content").alias("text"), "url", "title")


def images(nodes: DataFrame) -> DataFrame:
    return _ordered(nodes, "image").select("doc_id", "ord", "url", F.col("text_alt").alias("alt"))


def language(info: Column) -> Column:
    return F.lower(F.regexp_extract(info, r"^\s*(\S*)", 1))


def code_blocks(nodes: DataFrame, lang: str | None = None) -> DataFrame:
    out = _ordered(nodes, "code_block").select("doc_id", "ord", F.col("info").alias("language"), F.col("literal").alias("code"))
    return out if lang is None else out.where(language(F.col("language")) == lang.lower())


def tables(nodes: DataFrame) -> DataFrame:
    """(doc_id, table_id, row_ord, is_header, cells) of every table row; marker rows are dropped."""
    cell = nodes.where("kind = 'table_cell'").groupBy("doc_id", F.col("parent_id").alias("row_id")).agg(F.array_sort(F.collect_list(F.struct("sibling_ord", "text_content"))).alias("c"))
    rows = nodes.where("kind = 'table_row' and not header_end").select("doc_id", F.col("parent_id").alias("table_id"), F.col("node_id").alias("row_id"), "sibling_ord")
    out = rows.join(cell, ["doc_id", "row_id"], "left")
    return out.select("doc_id", "table_id", F.when(F.col("sibling_ord") == 0, 0).otherwise(F.col("sibling_ord") - 1).alias("row_ord"), (F.col("sibling_ord") == 0).alias("is_header"), F.coalesce(F.transform("c", lambda x: x["text_content"]), F.array().cast("array<string>")).alias("cells"))


def list_items(nodes: DataFrame) -> DataFrame:
    """(doc_id, list_id, item_ord, list_type, tight, text, is_task_list, checked) of every item."""
    lists = nodes.where("kind = 'list'").select("doc_id", F.col("node_id").alias("list_id"), F.col("tight").alias("list_tight"))
    items = nodes.where("kind = 'item'").select("doc_id", F.col("parent_id").alias("list_id"), (F.col("sibling_ord") + 1).alias("item_ord"), "list_type", "list_start", F.col("text_content").alias("text"), "is_task_list", "checked")
    return items.join(lists, ["doc_id", "list_id"])


def task_items(nodes: DataFrame, checked: bool | None = None) -> DataFrame:
    """(doc_id, ord, checked, text), from the marker of items in task lists."""
    t = _ordered(nodes, "item").where("is_task_list").select("doc_id", "ord", F.coalesce("checked", C.task_marker(F.col("text_content"))).alias("checked"), C.task_text(F.col("text_content")).alias("text"))
    t = t.where("checked is not null")
    return t if checked is None else t.where(F.col("checked") == checked)


def stats(nodes: DataFrame) -> DataFrame:
    """One row of element counts for each document: a single aggregation with map-side combining."""
    kind = F.col("kind")
    n = lambda c: F.count(F.when(c, 1))
    return nodes.groupBy("doc_id").agg(
        n(kind == "heading").alias("headings"), *(n((kind == "heading") & (F.col("level") == i)).alias(f"h{i}") for i in range(1, 7)),
        n(kind == "link").alias("links"), n(kind == "image").alias("images"), n(kind == "code_block").alias("code_blocks"), n(kind == "code").alias("inline_code"),
        n(kind == "list").alias("lists"), n(kind == "item").alias("list_items"), n(kind == "block_quote").alias("blockquotes"), n(kind == "thematic_break").alias("thematic_breaks"), n(kind == "table").alias("tables"),
        n((kind == "item") & F.col("is_task_list")).alias("task_items"),
    )


def document_stats(docs: DataFrame, **options: Any) -> DataFrame:
    """One row for each document: text metrics, element counts, tasks by state, code languages and reading time.

    The metrics are columns of the text, the counts one aggregation of its
    nodes, which are parsed once and staged; a document without nodes of a kind has 0 there.
    """
    kinds = ("document", "heading", "link", "image", "code_block", "code", "list", "item", "block_quote", "thematic_break", "table")
    n = stage(parse_nodes(docs, kinds=kinds, columns=("kind", "level", "text_content", "is_task_list", "checked", "info"), **options))
    counts = stats(n)
    mark = F.coalesce("checked", C.task_marker(F.col("text_content")))
    tasks = n.where("kind = 'item' and is_task_list").groupBy("doc_id").agg(F.count(F.when(mark, 1)).alias("checked"), F.count(F.when(~mark, 1)).alias("unchecked"))
    lang = language(F.col("info"))
    langs = n.where("kind = 'code_block'").groupBy("doc_id", F.when(lang == "", "(none)").otherwise(lang).alias("language")).agg(F.count("*").alias("n"))
    langs = langs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("language", "n"))).alias("languages"))
    t = F.col("text")
    text = docs.select("doc_id", C.count_lines(t).alias("lines"), C.count_words(t).alias("words"), C.count_chars(t).alias("characters"), F.octet_length(t).alias("bytes"), C.reading_time_secs(t).alias("reading_secs"))
    out = text.join(counts, "doc_id", "left").join(tasks, "doc_id", "left").join(langs, "doc_id", "left")
    out = out.withColumn("languages", F.coalesce("languages", F.array().cast(langs.schema["languages"].dataType)))
    return out.fillna(0, [c for c in counts.columns if c != "doc_id"] + ["checked", "unchecked"])


def as_json(rows: DataFrame, *fields: str) -> DataFrame:
    """(doc_id, json): the named fields of a document's extracted rows as a JSON list, by their ord."""
    g = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("x")))).alias("x"))
    return g.select("doc_id", F.to_json(F.transform("x", lambda r: r["x"])).alias("json"))


def tables_csv(rows: DataFrame) -> DataFrame:
    """(doc_id, csv) of :func:`tables`: cells with quotes, commas or line breaks are quoted; an empty line between tables."""
    quoted = lambda c: F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.concat(F.array_join(F.transform("cells", quoted), ","), F.lit("\n"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda r: r["line"]), "")
    each = rows.groupBy("doc_id", "table_id").agg(text(F.struct("row_ord", F.expr("not is_header").alias("body"), line.alias("line"))).alias("csv"))
    g = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("table_id", "csv"))).alias("x"))
    return g.select("doc_id", F.array_join(F.transform("x", lambda r: r["csv"]), "\n\n").alias("csv"))


def code_languages(nodes: DataFrame) -> DataFrame:
    lang = language(F.col("info"))
    return nodes.where("kind = 'code_block'").groupBy(F.when(lang == "", "(none)").otherwise(lang).alias("language")).agg(F.count("*").alias("n"))


def toc(nodes: DataFrame, low: int = 1, high: int = 6) -> DataFrame:
    """(doc_id, ord, level, indent, number, text, slug): numbers come from a fold over the ordered levels."""
    h = nodes.where((F.col("kind") == "heading") & F.col("level").between(low, high)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "level", "text_content"))).alias("h"))
    h = h.withColumn("low", F.array_min(F.transform("h", lambda x: x["level"])))
    zero = F.struct(F.array_repeat(F.lit(0), 6).alias("c"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        d = x["level"] - F.col("low")
        c = F.transform(s["c"], lambda v, i: F.when(i == d, v + 1).when(i > d, 0).otherwise(v))
        return F.struct(c.alias("c"), F.concat(s["out"], F.array(F.array_join(F.slice(c, F.lit(1), d + 1), "."))).alias("out"))

    h = h.withColumn("numbers", F.aggregate("h", zero, step)["out"])
    out = h.select("doc_id", "low", "numbers", F.posexplode("h").alias("p", "x"))
    return out.select("doc_id", (F.col("p") + 1).alias("ord"), F.col("x.level").alias("level"), (F.col("x.level") - F.col("low")).alias("indent"), F.get("numbers", F.col("p")).alias("number"), F.col("x.text_content").alias("text"), C.slug_cli(F.col("x.text_content")).alias("slug"))


def toc_text(nodes: DataFrame, low: int = 1, high: int = 6, numbered: bool = False, linked: bool = True) -> DataFrame:
    """(doc_id, toc): the contents as an indented Markdown list."""
    t = toc(nodes, low, high)
    label = F.concat(F.col("number"), F.lit(" "), F.col("text")) if numbered else F.col("text")
    entry = F.concat(F.lit("["), label, F.lit("](#"), F.col("slug"), F.lit(")")) if linked else label
    t = t.withColumn("line", F.concat(F.repeat(F.lit("  "), F.col("indent")), F.lit("- "), entry))
    return t.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("toc"))


def toc_options(marker: Column) -> dict[str, Column]:
    """Level range and flags of a ``[TOC levels=a-b numbered no-links]`` marker."""
    a = F.regexp_extract(marker, r"levels=(\d)", 1)
    b = F.regexp_extract(marker, r"levels=\d-(\d)", 1)
    return {"low": F.when(a != "", F.least(F.greatest(a.cast("int"), F.lit(1)), F.lit(6))).otherwise(1), "high": F.when(b != "", F.least(F.greatest(b.cast("int"), F.lit(1)), F.lit(6))).when(a != "", F.least(F.greatest(a.cast("int"), F.lit(1)), F.lit(6))).otherwise(6), "numbered": marker.contains("numbered"), "links": ~marker.contains("no-links")}


def slides(nodes: DataFrame, slide_level: int = 2) -> DataFrame:
    """(doc_id, slide, title, level, n_blocks): a heading at or above the level starts a slide; slide 0 is what comes before."""
    w = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    top = nodes.where("depth = 1").withColumn("starts", (F.col("kind") == "heading") & (F.col("level") <= slide_level))
    top = top.withColumn("slide", F.sum(F.col("starts").cast("int")).over(w))
    return top.groupBy("doc_id", "slide").agg(F.min(F.when(F.col("starts"), F.col("text_content"))).alias("title"), F.min(F.when(F.col("starts"), F.col("level"))).alias("level"), F.count("*").alias("n_blocks"))


def unique_anchors(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, text, anchor): a fold per document, as a suffixed name can collide with a later plain one."""
    h = headings(nodes).select("doc_id", F.struct("ord", "text", C.anchor_ascii(F.col("text")).alias("base")).alias("h"))
    h = h.groupBy("doc_id").agg(F.array_sort(F.collect_list("h")).alias("h"))
    zero = F.array().cast("array<string>")

    def step(used: Column, x: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(0), F.size(used)), lambda i: F.when(i == 0, x["base"]).otherwise(F.concat(x["base"], F.lit("-"), i.cast("string"))))
        return F.concat(used, F.array(F.get(F.filter(tries, lambda t: ~F.array_contains(used, t)), F.lit(0))))

    h = h.withColumn("a", F.aggregate("h", zero, step))
    return h.select("doc_id", "a", F.posexplode("h").alias("p", "x")).select("doc_id", F.col("x.ord").alias("ord"), F.col("x.text").alias("text"), F.get("a", F.col("p")).alias("anchor"))


#: Kinds that the rules of :func:`validate` read.
CHECKED = ("link", "image", "heading", "footnote_reference", "footnote_definition")


def validate(nodes: DataFrame, *, check_urls: bool = True, check_anchors: bool = True, assets: DataFrame | None = None) -> DataFrame:
    """(doc_id, severity, category, message): every rule in one pass over the documents' links, images, headings and notes.

    Rules that compare nodes look at all of a key within its document: a window
    over (doc_id, class, key) puts a heading beside the links to it, and a
    footnote's references beside its definitions.
    """
    n = nodes.where(F.col("kind").isin(*CHECKED)).select("doc_id", "node_id", "kind", "url", "text_content", "text_alt", "footnote_name")
    slug = F.when(F.col("kind") == "heading", C.slug_cli(F.col("text_content"))).when((F.col("kind") == "link") & F.col("url").startswith("#"), F.substr(F.col("url"), F.lit(2)))
    group = F.when(F.col("kind").startswith("footnote"), "note").when((F.col("kind") == "heading") | (slug != ""), "anchor")
    n = n.withColumn("key", F.coalesce("footnote_name", slug)).withColumn("group", F.coalesce(group, F.lit("alone")))
    n = n.withColumn("key", F.when(F.col("group") != "alone", F.col("key")).otherwise(F.col("node_id").cast("string")))
    peers = Window.partitionBy("doc_id", "group", "key")
    has = lambda kind: F.max((F.col("kind") == kind).cast("int")).over(peers) == 1
    rank = F.row_number().over(Window.partitionBy("doc_id", "group", "key", "kind").orderBy("node_id"))
    n = n.select("*", rank.alias("k"), has("heading").alias("headed"), has("footnote_reference").alias("used"), has("footnote_definition").alias("defined"))
    is_ = lambda kind: F.col("kind") == kind
    issue = lambda when, severity, category, message: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), message.alias("message")))
    blank = F.trim("url") == ""
    rules = [
        issue(is_("link") & blank, "error", "link", F.concat(F.lit("Empty link URL for text: "), "text_content")),
        issue(is_("image") & blank, "error", "image", F.concat(F.lit("Empty image URL for alt: "), "text_alt")),
        issue(is_("heading") & (F.col("k") > 1), "warning", "heading", F.concat(F.lit("Duplicate heading id: "), "key")),
        issue(is_("footnote_definition") & (F.col("k") == 1) & ~F.col("used"), "info", "footnote", F.concat(F.lit("Unused footnote: "), "key")),
        issue(is_("footnote_reference") & (F.col("k") == 1) & ~F.col("defined"), "error", "footnote", F.concat(F.lit("Undefined footnote: "), "key")),
    ]
    if check_urls:
        rules.append(issue(is_("link") & C.is_external_url(F.col("url")) & ~C.is_valid_url(F.col("url")), "warning", "link", F.concat(F.lit("Malformed URL: "), "url")))
    if check_anchors:
        rules.append(issue(is_("link") & (F.col("group") == "anchor") & ~F.col("headed"), "error", "anchor", F.concat(F.lit("Broken anchor: #"), "key")))
    if assets is not None:
        known = assets.select(F.col("path").alias("url"), F.lit(True).alias("there")).distinct()
        n = n.join(known, "url", "left")
        rules.append(issue(is_("image") & ~C.is_external_url(F.col("url")) & (F.col("url") != "") & F.col("there").isNull(), "warning", "image", F.concat(F.lit("Missing image: "), "url")))
    return n.select("doc_id", F.explode(F.array_compact(F.array(*rules))).alias("issue")).select("doc_id", "issue.severity", "issue.category", "issue.message")


def validation_report(issues: DataFrame) -> DataFrame:
    """(doc_id, errors, warnings, infos, valid) of documents that have issues."""
    n = lambda s: F.count(F.when(F.col("severity") == s, 1))
    return issues.groupBy("doc_id").agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"), (n("error") == 0).alias("valid"))


def toc_html(nodes: DataFrame) -> DataFrame:
    """(doc_id, html): a nested list by level differences, with unique anchors."""
    t = toc(nodes).join(unique_anchors(nodes).select("doc_id", "ord", "anchor"), ["doc_id", "ord"])
    w = Window.partitionBy("doc_id").orderBy("ord")
    step = F.col("level") - F.coalesce(F.lag("level").over(w), F.lit(1))
    t = t.withColumn("step", step)
    line = F.concat(F.repeat(F.lit("<ul>\n"), F.greatest("step", F.lit(0))), F.repeat(F.lit("</ul>\n"), F.greatest(-F.col("step"), F.lit(0))), F.lit('<li><a href="#'), "anchor", F.lit('">'), C.escape_html(F.col("text")), F.lit("</a></li>\n"))
    g = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("x"), F.max_by("level", "ord").alias("last"))
    return g.select("doc_id", F.concat(F.lit('<nav class="toc">\n<ul>\n'), F.array_join(F.transform("x", lambda x: x["line"]), ""), F.repeat(F.lit("</ul>\n"), F.col("last") - 1), F.lit("</ul>\n</nav>")).alias("html"))


def footnotes(nodes: DataFrame) -> DataFrame:
    """(doc_id, name, content, n_refs) of footnote definitions (extended profile): the text of the first paragraph, and how often each is referred to."""
    d = nodes.where("kind = 'footnote_definition'").select("doc_id", "footnote_name", F.col("node_id").alias("note_id"), F.col("subtree_end").alias("note_end"))
    p = nodes.where("kind = 'paragraph'").select("doc_id", "node_id", "text_content")
    text = d.join(p, "doc_id").where("node_id between note_id and note_end").groupBy("doc_id", "note_id").agg(F.min_by("text_content", "node_id").alias("content"))
    refs = nodes.where("kind = 'footnote_reference'").groupBy("doc_id", "footnote_name").agg(F.count("*").alias("n_refs"))
    out = d.join(text, ["doc_id", "note_id"], "left").join(refs, ["doc_id", "footnote_name"], "left")
    return out.select("doc_id", F.col("footnote_name").alias("name"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("n_refs", F.lit(0)).alias("n_refs"))


def with_toc_slide(s: DataFrame) -> DataFrame:
    """Slides with a contents slide before them; the others move up by one."""
    toc_slide = s.select("doc_id").distinct().select("doc_id", F.lit(0).cast("long").alias("slide"), F.lit("Contents").alias("title"), F.lit(None).cast("int").alias("level"), F.lit(0).cast("long").alias("n_blocks"))
    return s.withColumn("slide", F.row_number().over(Window.partitionBy("doc_id").orderBy("slide")).cast("long")).unionByName(toc_slide)

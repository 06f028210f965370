"""Queries of single functions over whole tables: definitions, options, positions, XML, types, links, tasks, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.vectors import unescape
from ..operators import extract as X
from ..operators import lines as L
from ..operators import nodes as N
from ..operators.render import render
from ..sources.text import read_table
from . import corpora as D
from .registry import documents, nodes_of, nodes_once, pages, query


@query("""SELECT n_regionkey AS doc_id, '<dl>' || chr(10) || string_agg('<dt>' || n_name || '</dt>' || chr(10) || '<dd>key &lt;' || n_nationkey || '&gt;</dd>' || chr(10) || '<dd>' || n_name || ' &amp; more</dd>' || chr(10), '' ORDER BY n_nationkey) || '</dl>' AS html,
string_agg(n_name || chr(10) || ': key <' || n_nationkey || '>' || chr(10) || ': ' || n_name || ' & more', '|' ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey""")
def definitions_written(spark, sf):
    """Definition lists as HTML and as Markdown again."""
    n = read_table(spark, sf, "nation")
    entry = F.concat("n_name", F.lit("\n: key <"), F.col("n_nationkey").cast("string"), F.lit(">\n: "), "n_name", F.lit(" & more\n"))
    docs = n.groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", entry.alias("e")))), lambda x: x["e"]), "\n").alias("text"))
    d = L.definition_lists(docs)
    md = d.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term_line", L.definition_markdown(F.col("term"), F.col("definitions")).alias("m")))), lambda x: x["m"]), "|").alias("markdown"))
    return L.definition_html(d).join(md, "doc_id")


@query("SELECT doc_id, CAST(1 + doc_id % 6 AS INTEGER) AS low, CAST(least(1 + doc_id % 7, 6) AS INTEGER) AS high, doc_id % 2 = 0 AS numbered, doc_id % 3 <> 0 AS links FROM documents")
def toc_options(spark, sf):
    """Level range and flags of a contents marker in every document; a level above six is six."""
    k = F.col("doc_id")
    mark = F.concat(F.lit("[TOC levels="), (1 + k % 6).cast("string"), F.lit("-"), (1 + k % 7).cast("string"), F.when(k % 2 == 0, " numbered").otherwise(""), F.when(k % 3 == 0, " no-links").otherwise(""), F.lit("]: #"))
    return documents(spark, sf).select("doc_id", *(c.alias(n) for n, c in X.toc_options(mark).items()))


_LINE = r"rtrim(concat('w ', trim(regexp_replace(coalesce(text, ''), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'))))"


@query(f"""SELECT doc_id, '<h2 data-sourcepos="1:0-1:' || (3 + length(source)) || '">' || source || '</h2>' || chr(10) || '<p data-sourcepos="3:0-3:' || length(line) || '">' || line || '</p>' AS body FROM (SELECT doc_id, source, {_LINE} AS line FROM documents)""")
def html_positions(spark, sf):
    """Blocks as HTML with where they stand in the source; lines count from 1, first columns from 0."""
    line = F.rtrim(F.concat(F.lit("w "), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{M}\p{N}]+", " "))))
    d = documents(spark, sf).select("doc_id", F.concat(F.lit("## "), "source", F.lit("\n\n"), line, F.lit("\n")).alias("text"))
    return render(d, "html", sourcepos=True)


@query("""SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS slide, role AS title FROM conversations UNION ALL SELECT DISTINCT conv_id, 0::BIGINT, 'Contents' FROM conversations""")
def slides_with_contents(spark, sf):
    """Slides behind a contents slide."""
    s = X.slides(nodes_of(D.md_chat, spark, sf)).where("slide > 0")
    return X.with_toc_slide(s).select("doc_id", "slide", "title")


@query(r"""SELECT page_id, md5(html) AS back, md5(replace(replace(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;'), chr(10), '&#10;'), chr(13), '&#13;'), chr(9), '&#9;')) AS attribute, page_id % 3 = 0 AS yes FROM pages""")
def xml_texts(spark, sf):
    """Escaped pages come back whole; as attributes their white space is written out; words for true and false."""
    h, k = F.col("html"), F.col("page_id")
    word = F.when(k % 3 == 0, F.when(k % 2 == 0, "TRUE ").otherwise("1")).otherwise(F.when(k % 2 == 0, "no").otherwise(" false"))
    return pages(spark, sf).select("page_id", F.md5(C.unescape_xml(C.escape_xml(h))).alias("back"), F.md5(C.escape_xml_attr(h)).alias("attribute"), C.xml_to_bool(word).alias("yes"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE 'x-' || lang END AS charset, 'text/html' AS mime FROM documents")
def charsets(spark, sf):
    m = F.concat(F.lit("text/html"), F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit('; Charset="x-'), "lang", F.lit('"'))))
    return documents(spark, sf).select("doc_id", C.mime_charset(m).alias("charset"), C.normalize_mime(m).alias("mime"))


@query(r"SELECT doc_id, md5('# ' || source || chr(10) || regexp_replace(coalesce(text, ''), '---+', '', 'g')) AS rest FROM documents")
def front_matter_stripped(spark, sf):
    """Whole texts behind their front matter."""
    body = F.concat(F.lit("# "), "source", F.lit("\n"), F.regexp_replace(F.coalesce("text", F.lit("")), "---+", ""))
    return documents(spark, sf).select("doc_id", F.md5(C.strip_front_matter(F.concat(F.lit("---\nsource: "), "source", F.lit("\n---\n\n"), body))).alias("rest"))


@query(r"SELECT doc_id, CAST(len(w) AS INTEGER) AS n, md5(array_to_string(w, ' ')) AS words FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[^\p{L}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents)")
def struck_spans(spark, sf):
    """Every word of a text struck out, and found again."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]+", " ")
    spans = C.struck(F.regexp_replace(t, r"(\p{L}+)", "~~$1~~"))
    return documents(spark, sf).select("doc_id", F.size(spans).alias("n"), F.md5(F.array_join(spans, " ")).alias("words"))


_TAGS = "('title', 'textarea', 'style', 'xmp', 'iframe', 'noembed', 'noframes', 'script', 'plaintext')"


@query(rf"SELECT tag, count(*) AS n, lower(tag) IN {_TAGS} AS filtered FROM (SELECT unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag")
def filtered_tags(spark, sf):
    """All tags of the pages, and which of them may not pass."""
    t = pages(spark, sf).select(F.explode(F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9]*)"), 1)).alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("n")).withColumn("filtered", C.is_filtered_tag(F.col("tag")))


@query("SELECT o_custkey AS doc_id, o_orderkey AS item, row_number() OVER w > 1 AS has_prev, row_number() OVER w < count(*) OVER (PARTITION BY o_custkey) AS has_next, 'orders/' || CASE WHEN o_orderstatus = 'F' THEN '[x] ' ELSE '[ ] ' END || o_orderkey AS task FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def neighbours(spark, sf):
    """Items before and after each item, the first and the last of their list; tasks written again."""
    n = N.with_siblings(nodes_once(D.md_orders(spark, sf), kinds=("list", "item"), columns=("node_id", "parent_id", "sibling_ord", "kind", "list_type", "text_content")))
    item = n.where("kind = 'item' and list_type = 'bullet'")
    key = F.regexp_extract("text_content", r"order (\d+)", 1)
    lists = n.where("kind = 'list'").select("doc_id", F.col("node_id").alias("parent_id"), "first_child", "last_child")
    both = item.drop("first_child", "last_child").join(lists, ["doc_id", "parent_id"])
    task = F.concat(F.lit("orders/"), C.task_markdown(C.task_marker(F.col("text_content")), key))
    return both.select("doc_id", key.cast("long").alias("item"), (F.col("prev_id").isNotNull() & (F.col("node_id") != F.col("first_child"))).alias("has_prev"), (F.col("next_id").isNotNull() & (F.col("node_id") != F.col("last_child"))).alias("has_next"), task.alias("task"))


_KEPT = "~:/?#[]@!$&'()+,;="


def _kept_sql(x: str) -> str:
    for c in _KEPT:
        x = f"replace({x}, '%{ord(c):02X}', chr({ord(c)}))"
    return f"replace({x}, '%25', '%')"


@query(f"SELECT page_id, md5({_kept_sql("replace(url_encode(url || '?q=a b&c=<' || page_id || '>'), '+', '%20')")}) AS url FROM pages")
def normalised_uris(spark, sf):
    """Urls with a query of odd characters, percent-encoded."""
    u = F.concat("url", F.lit("?q=a b&c=<"), F.col("page_id").cast("string"), F.lit(">"))
    return pages(spark, sf).select("page_id", F.md5(C.normalize_uri(u)).alias("url"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents")
def unescaped_texts(spark, sf):
    """Whole texts, every mark escaped and ampersands written as entities, read back."""
    t = F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("\x01"))
    t = F.replace(F.regexp_replace(t, r"([!-%'-/:-@\[-`{-~])", r"\\$1"), F.lit("\x01"), F.lit("&#x26;"))
    return N.spread(documents(spark, sf).select("doc_id", "text")).select("doc_id", F.md5(unescape(t)).alias("text"))

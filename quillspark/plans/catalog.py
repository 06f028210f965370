"""Registered queries, each with the DuckDB SQL that computes the same rows from the tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import templates as TPL
from ..functions.scalars import LATEX
from ..operators import extract as X
from ..operators import lines as L
from ..operators import nodes as N
from ..operators.render import format_documents, render
from ..sources.text import read_table
from ..streaming import streams as S
from . import corpora as D
from .registry import ORACLE, QUERIES, documents, nodes_of, nodes_once, pages, query

__all__ = ["ORACLE", "QUERIES"]

# --- text metrics ---------------------------------------------------------------

W = r"list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x <> '')"
WORDS = f"len({W.format(t='text')})"
LINES = "(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END)"
SENTENCES = "greatest(length(text) - length(regexp_replace(text, '[.!?]', '', 'g')), 1)"
LETTERS = r"list_filter(list_transform(" + W.format(t="lower(text)") + r", lambda w: regexp_replace(w, '[^\p{L}]', '', 'g')), lambda w: w <> '')"
GROUPS = "length(regexp_replace(regexp_replace(w, '[aeiouy]+', '0', 'g'), '[^0]', '', 'g'))"
SYLLABLES = f"CAST(coalesce(list_sum(list_transform({LETTERS}, lambda w: greatest({GROUPS} - CASE WHEN right(w, 1) = 'e' AND {GROUPS} > 1 THEN 1 ELSE 0 END, 1))), 0) AS BIGINT)"


@query(f"SELECT doc_id, CAST({LINES} AS BIGINT) AS lines, CAST({WORDS} AS BIGINT) AS words, CAST(length(regexp_replace(text, '\\s+', '', 'g')) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes, CAST(ceil({WORDS} * 60 / 200.0) AS BIGINT) AS reading_secs FROM documents")
def text_metrics(spark, sf):
    t = F.col("text")
    return N.spread(documents(spark, sf).select("doc_id", "text")).select("doc_id", C.count_lines(t).alias("lines"), C.count_words(t).alias("words"), C.count_chars(t).alias("chars"), F.octet_length(t).cast("long").alias("bytes"), C.reading_time_secs(t).alias("reading_secs"))


_READ = f"SELECT doc_id, lang, greatest({WORDS}, 1) AS w, {SENTENCES} AS s, {SYLLABLES} AS y FROM documents"


@query(f"SELECT doc_id, CAST(s AS BIGINT) AS sentences, y AS syllables, round(206.835 - 1.015 * (w / s) - 84.6 * (y / w), 6) AS reading_ease, round(greatest(0.39 * (w / s) + 11.8 * (y / w) - 15.59, 0), 6) AS grade FROM ({_READ})")
def readability(spark, sf):
    r = C.readability(F.col("text"))
    return documents(spark, sf).select("doc_id", r["sentences"].alias("sentences"), r["syllables"].alias("syllables"), F.round(r["reading_ease"], 6).alias("reading_ease"), F.round(r["grade"], 6).alias("grade"))


@query(f"SELECT band, count(*) AS n FROM (SELECT CASE WHEN e >= 90 THEN 'Very Easy' WHEN e >= 80 THEN 'Easy' WHEN e >= 70 THEN 'Fairly Easy' WHEN e >= 60 THEN 'Standard' WHEN e >= 50 THEN 'Fairly Difficult' WHEN e >= 30 THEN 'Difficult' ELSE 'Very Difficult' END AS band FROM (SELECT 206.835 - 1.015 * (w / s) - 84.6 * (y / w) AS e FROM ({_READ}))) GROUP BY band")
def readability_bands(spark, sf):
    ease = N.spread(documents(spark, sf).select("text")).select(C.readability(F.col("text"))["reading_ease"].alias("ease"))
    return ease.groupBy(C.ease_band(F.col("ease")).alias("band")).agg(F.count("*").alias("n"))


@query(f"SELECT lang, CAST(sum({WORDS}) AS BIGINT) AS words, CAST(sum({SYLLABLES}) AS BIGINT) AS syllables, count(*) AS docs FROM documents GROUP BY lang")
def words_by_lang(spark, sf):
    return N.spread(documents(spark, sf).select("lang", "text")).groupBy("lang").agg(F.sum(C.count_words(F.col("text"))).alias("words"), F.sum(C.count_syllables(F.col("text"))).alias("syllables"), F.count("*").alias("docs"))


# --- slugs, escapes, white space ---------------------------------------------------


@query(r"SELECT doc_id, md5(replace(regexp_replace(lower(text), '[^\p{L}\p{N} ]', '', 'g'), ' ', '-')) AS slug FROM documents")
def slug_cli(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(C.slug_cli(F.col("text"))).alias("slug"))


@query(r"SELECT p_partkey, CASE WHEN a = '' THEN 'heading' WHEN regexp_matches(a, '^[0-9]') THEN 'h-' || a ELSE a END AS anchor FROM (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' #' || p_size), '[^a-z0-9 _-]', '', 'g'), '[ _-]+', '-', 'g'), '-$', '') AS a FROM part)")
def anchor_ascii(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", C.anchor_ascii(F.concat("p_name", F.lit(" #"), F.col("p_size").cast("string"))).alias("anchor"))


_ESC = "replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"SELECT page_id, md5({_ESC.format(x='html')}) AS html, md5(replace({_ESC.format(x='html')}, chr(39), '&#x27;')) AS writer, md5(replace({_ESC.format(x='html')}, chr(39), '&apos;')) AS xml, regexp_matches(html, '[&<>\"'']') AS needs FROM pages")
def html_escape(spark, sf):
    h = F.col("html")
    return pages(spark, sf).select("page_id", F.md5(C.escape_html(h)).alias("html"), F.md5(C.escape_html_writer(h)).alias("writer"), F.md5(C.escape_xml(h)).alias("xml"), C.needs_xml_escape(h).alias("needs"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '([\\*_`$#@<>"])', '\\\1', 'g')) AS typst, md5(replace(replace(replace(replace(text, '\', '\e'), '-', '\-'), '.', '\&.'), '''', '\&''')) AS man, md5(replace(replace(replace(replace(text, '\', '\\'), '{', '\{'), '}', '\}'), chr(10), '\line ')) AS rtf FROM documents""")
def format_escapes(spark, sf):
    t = F.col("text")
    return documents(spark, sf).select("doc_id", F.md5(C.escape_typst(t)).alias("typst"), F.md5(C.escape_man(t)).alias("man"), F.md5(C.escape_rtf(t)).alias("rtf"))


def _latex_sql(x: str) -> str:
    """The replacements of ``escape_latex`` as nested SQL, through private-use stand-ins."""
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    for i, c in enumerate(LATEX):
        x = f"replace({x}, {quote(c)}, chr({0xE000 + i}))"
    for i, v in enumerate(LATEX.values()):
        x = f"replace({x}, chr({0xE000 + i}), {quote(v)})"
    return x


@query(f"SELECT doc_id, md5({_latex_sql('text')}) AS latex FROM documents")
def latex_escape(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(C.escape_latex(F.col("text"))).alias("latex"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 77) || '...' END AS short, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed, md5(replace(replace(upper(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss')), 'ẞ', 'SS'), 'ß', 'SS')) AS label FROM documents")
def truncate_and_squeeze(spark, sf):
    t = F.col("text")
    return documents(spark, sf).select("doc_id", C.truncate(t, 80).alias("short"), F.md5(C.normalize_ws(t)).alias("squeezed"), F.md5(C.normalize_label(t)).alias("label"))


_RUNS = "replace(replace(replace(text, '.', '...'), ',', '----'), ';', '-------')"


@query(f"""WITH t AS (SELECT doc_id, regexp_split_to_array({_RUNS}, '-+') AS p, list_transform(regexp_extract_all({_RUNS}, '-+'), lambda r: CASE WHEN length(r) = 1 THEN r WHEN length(r) % 3 = 0 THEN repeat('—', length(r) // 3) WHEN length(r) % 2 = 0 THEN repeat('–', length(r) // 2)
  WHEN length(r) % 3 = 2 THEN repeat('—', (length(r) - 2) // 3) || '–' ELSE repeat('—', (length(r) - 4) // 3) || '––' END) AS d FROM documents)
SELECT doc_id, md5(replace(array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(d[i], '')), ''), '...', '…')) AS smart FROM t""")
def smart_dashes(spark, sf):
    t = F.replace(F.replace(F.replace("text", F.lit("."), F.lit("...")), F.lit(","), F.lit("----")), F.lit(";"), F.lit("-------"))
    return documents(spark, sf).select("doc_id", F.md5(C.smart_dashes(t)).alias("smart"))


# --- URLs and media types --------------------------------------------------------------


@query(
    "SELECT page_id, url LIKE 'http%' AS safe, regexp_matches(url, '^(https?://|ftp://|mailto:)') AS external, url NOT LIKE '% %' AS valid, replace(url, '&', '&amp;') AS href FROM pages"
)
def url_checks(spark, sf):
    u = F.col("url")
    return pages(spark, sf).select("page_id", C.is_safe_url(u).alias("safe"), C.is_external_url(u).alias("external"), C.is_valid_url(u).alias("valid"), C.escape_href(u).alias("href"))


_SCHEMES = "(VALUES (0, 'javascript'), (1, 'https'), (2, 'DATA'), (3, 'ftp'), (4, 'mailto'))"


@query(f"SELECT page_id, k, k IN (1, 4) OR (k = 2 AND page_id % 2 = 0) AS safe, CASE WHEN k = 2 THEN CASE WHEN page_id % 2 = 0 THEN 'image/png' ELSE 'text/html' END END AS mime FROM pages, {_SCHEMES} AS s(k, name)")
def url_schemes(spark, sf):
    names = F.array(*(F.lit(x) for x in ("javascript", "https", "DATA", "ftp", "mailto")))
    p = pages(spark, sf).select("page_id", F.posexplode(names).alias("k", "name"))
    u = F.when(F.col("k") == 2, F.concat(F.lit("data:"), F.when(F.col("page_id") % 2 == 0, "image/png").otherwise("text/html"), F.lit(";base64,AA=="))).otherwise(F.concat("name", F.lit(":x@y")))
    return p.select("page_id", "k", C.is_safe_url(u).alias("safe"), C.data_uri_mime(u).alias("mime"))


@query(r"SELECT page_id, CASE WHEN ext = 'html' THEN 'text/html' ELSE 'application/octet-stream' END AS mime, split_part(CASE WHEN ext = 'html' THEN 'text/html' ELSE 'application/octet-stream' END, '/', 1) AS category, CASE WHEN ext = 'html' THEN 'html' END AS format FROM (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([^./]+)$', 1)) AS ext FROM pages)")
def mime_lookup(spark, sf):
    path = F.regexp_replace("url", "[?#].*$", "")
    m = C.mime_type_or_default(path)
    return pages(spark, sf).select("page_id", m.alias("mime"), C.media_category(m).alias("category"), C.output_format(path).alias("format"))


@query("SELECT page_id, url, '<a href=\"' || replace(url, '&', '&amp;') || '\">' || replace(url, '&', '&amp;') || '</a>' AS link FROM pages")
def autolinks_bare(spark, sf):
    t = F.concat(F.lit("see "), "url", F.lit(", or <"), F.lit("x@y"), F.lit("> not"))
    return pages(spark, sf).select("page_id", F.explode(C.bare_urls(t)).alias("url")).withColumn("link", C.autolink_html(F.col("url")))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(html, '<title>', '&lt;title&gt;'), '</title>', '&lt;/title&gt;'), '<style>', '&lt;style&gt;'), '</style>', '&lt;/style&gt;'), '<script>', '&lt;script&gt;'), '</script>', '&lt;/script&gt;'), '<iframe>', '&lt;iframe&gt;'), '</iframe>', '&lt;/iframe&gt;')) AS filtered FROM pages")
def tagfilter(spark, sf):
    return pages(spark, sf).select("page_id", F.md5(C.filter_html(F.col("html"))).alias("filtered"))


# --- maps and line predicates --------------------------------------------------------------


@query("SELECT p_partkey, 'brand: ' || p_brand || '; color: red; size: ' || p_size AS css, 'brand: ' || p_brand || '; color: blue; size: ' || p_size || '; z: 1' AS merged FROM part")
def css_map(spark, sf):
    css = C.parse_css(F.concat(F.lit("SIZE : "), F.col("p_size").cast("string"), F.lit("; color: green; brand:"), "p_brand", F.lit("; color: red; ; broken")))
    return N.spread(read_table(spark, sf, "part")).select("p_partkey", C.css_text(css).alias("css"), C.css_text(C.merge_css(css, C.parse_css(F.lit("z:1; color:blue")))).alias("merged"))


@query("SELECT page_id AS doc_id, url, 'url: ' || url AS cli, true AS has FROM pages")
def front_matter(spark, sf):
    t = F.col("text")
    return D.md_pages(spark, sf).select("doc_id", F.element_at(C.front_matter_map(C.front_matter_raw(t)), "url").alias("url"), C.front_matter_cli(t).alias("cli"), C.has_front_matter(t).alias("has"))


@query("SELECT o_custkey AS doc_id, count(*) AS tasks, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY o_custkey")
def task_lines(spark, sf):
    x = D.md_orders(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(C.is_task_line(F.col("line")))
    mark = C.task_marker(F.regexp_replace("line", "^- ", ""))
    return x.groupBy("doc_id").agg(F.count("*").alias("tasks"), F.count(F.when(mark, 1)).alias("done"))


@query("SELECT n_regionkey, '| ' || rpad('key', w1, ' ') || ' | ' || rpad('name', w2, ' ') || ' |' || chr(10) || '| ' || repeat('-', w1) || ' | ' || repeat('-', w2) || ' |' || chr(10) || body AS md FROM (SELECT n_regionkey, w1, w2, string_agg('| ' || rpad(CAST(n_nationkey AS VARCHAR), w1, ' ') || ' | ' || rpad(n_name, w2, ' ') || ' |', chr(10) ORDER BY n_nationkey) AS body FROM (SELECT *, greatest(3, max(length(CAST(n_nationkey AS VARCHAR))) OVER (PARTITION BY n_regionkey)) ::INT AS w1, greatest(4, max(length(n_name)) OVER (PARTITION BY n_regionkey))::INT AS w2 FROM nation) GROUP BY n_regionkey, w1, w2)")
def csv_to_table(spark, sf):
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(", "), "n_name")
    csv = read_table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("csv"))
    return csv.select("n_regionkey", C.table_markdown(C.csv_rows(F.concat(F.lit("key,name\n"), "csv"))).alias("md"))


# --- extracts over parsed corpora --------------------------------------------------------------

_BLOCK = "CAST(c_nationkey AS BIGINT) * 1000000000 + c_custkey // 500"
_CUST = f"(SELECT DISTINCT {_BLOCK} AS doc_id, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"SELECT doc_id, 1 AS ord, 1 AS level, r_name AS text FROM {_CUST} UNION ALL SELECT doc_id, 2, 2, n_name FROM {_CUST}")
def headings(spark, sf):
    return X.headings(nodes_of(D.md_customers, spark, sf))


@query(f"SELECT doc_id, 1 AS ord, 2 AS level, n_name AS text FROM {_CUST}")
def headings_level(spark, sf):
    return X.headings(nodes_of(D.md_customers, spark, sf), 2)


@query(f"SELECT level, count(*) AS n FROM (SELECT 1 AS level FROM {_CUST} UNION ALL SELECT 2 FROM {_CUST}) GROUP BY ROLLUP (level)")
def heading_rollup(spark, sf):
    return X.headings(nodes_of(D.md_customers, spark, sf)).rollup("level").agg(F.count("*").alias("n"))


@query(f"SELECT {_BLOCK} AS doc_id, CAST(row_number() OVER (PARTITION BY {_BLOCK} ORDER BY c_custkey) AS INTEGER) AS row_ord, CAST(c_custkey AS VARCHAR) AS custkey, c_name AS name, CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) AS acctbal FROM customer")
def tables_cells(spark, sf):
    t = X.tables(nodes_once(D.md_customers(spark, sf), kinds=("table_row", "table_cell"), columns=("node_id", "parent_id", "sibling_ord", "kind", "text_content", "header_end"))).where("not is_header")
    return t.select("doc_id", "row_ord", *(F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(("custkey", "name", "acctbal"))))


@query("SELECT n_name AS nation, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(15,2))) AS DOUBLE) AS acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def table_sum(spark, sf):
    """Balances recovered from parsed table cells, under the heading that governs the table."""
    n = N.governed_by_heading(nodes_once(D.md_customers(spark, sf), kinds=("heading", "table", "table_row", "table_cell"), columns=("node_id", "parent_id", "sibling_ord", "kind", "text_content", "header_end")))
    tables = n.where("kind = 'table'").select("doc_id", F.col("node_id").alias("table_id"), "heading_id")
    heads = n.where("kind = 'heading'").select("doc_id", F.col("node_id").alias("heading_id"), F.col("text_content").alias("nation"))
    cells = X.tables(n).where("not is_header").select("doc_id", "table_id", F.get("cells", F.lit(2)).cast("decimal(15,2)").alias("v"))
    return cells.join(tables, ["doc_id", "table_id"]).join(heads, ["doc_id", "heading_id"]).groupBy("nation").agg(F.count("*").alias("customers"), F.sum("v").cast("double").alias("acctbal"))


@query("SELECT DISTINCT 'none left right' AS alignments, 3 AS num_columns FROM customer")
def table_alignments(spark, sf):
    return nodes_of(D.md_customers, spark, sf).where("kind = 'table'").select(F.array_join("alignments", " ").alias("alignments"), "num_columns").distinct()


_ENC = "replace(replace(url_encode({u}), '%2F', '/'), '%2C', ',')"
_PAGE_LINKS = "SELECT page_id AS doc_id, CAST(unnest(range(1, len(u) + 1)) AS INTEGER) AS ord, unnest(t) AS text, unnest(u) AS u FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1) AS u, regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2) AS t FROM pages)"


@query(f"SELECT doc_id, ord, text, {_ENC.format(u='u')} AS url, '' AS title FROM ({_PAGE_LINKS})")
def links(spark, sf):
    return X.links(nodes_of(D.md_pages, spark, sf))


@query(f"SELECT {_ENC.format(u='u')} AS url, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_PAGE_LINKS}) GROUP BY u")
def links_by_target(spark, sf):
    return X.links(nodes_of(D.md_pages, spark, sf)).groupBy("url").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("SELECT doc_id, 1 AS ord, '/img/' || doc_id || '.png' AS url, 'pic ' || doc_id AS alt FROM documents")
def images(spark, sf):
    return X.images(nodes_of(D.md_docs, spark, sf))


@query("SELECT doc_id, 1 AS ord, lang || ' sample' AS language, 'chars = ' || n_chars || chr(10) AS code FROM documents")
def code_blocks(spark, sf):
    return X.code_blocks(nodes_of(D.md_docs, spark, sf))


@query("SELECT doc_id, 1 AS ord, lang || ' sample' AS language, 'chars = ' || n_chars || chr(10) AS code FROM documents WHERE lang = 'de'")
def code_filtered(spark, sf):
    return X.code_blocks(nodes_of(D.md_docs, spark, sf), "DE")


@query("SELECT lang AS language, count(*) AS n FROM documents GROUP BY lang")
def code_by_language(spark, sf):
    return X.code_languages(nodes_of(D.md_docs, spark, sf))


@query("SELECT doc_id, 1 AS ord, 'the source' AS text, 'https://' || source || '.example.com/d/' || doc_id AS url, 'Title' AS title FROM documents UNION ALL SELECT doc_id, 2, 'https://example.org/' || lang, 'https://example.org/' || lang, '' FROM documents")
def reference_links(spark, sf):
    return X.links(nodes_of(D.md_docs, spark, sf))


_LISTS = "SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS item_ord, o_orderkey, o_orderstatus, o_orderpriority FROM orders"


@query(f"SELECT doc_id, item_ord, 'bullet' AS list_type, '[' || CASE WHEN o_orderstatus = 'F' THEN 'x' ELSE ' ' END || '] order ' || o_orderkey AS text FROM ({_LISTS}) UNION ALL SELECT doc_id, item_ord, 'ordered', o_orderpriority FROM ({_LISTS})")
def list_items_ranked(spark, sf):
    n = nodes_once(D.md_orders(spark, sf), kinds=("list", "item"), columns=("node_id", "parent_id", "sibling_ord", "kind", "text_content", "list_type", "list_start", "tight", "is_task_list", "checked"))
    return X.list_items(n).select("doc_id", "item_ord", "list_type", "text")


@query(f"SELECT doc_id, item_ord AS ord, o_orderstatus = 'F' AS checked, 'order ' || o_orderkey AS text FROM ({_LISTS})")
def task_items(spark, sf):
    return X.task_items(nodes_of(D.md_orders, spark, sf, kinds=("item",), columns=("node_id", "kind", "text_content", "is_task_list", "checked")))


@query(f"SELECT doc_id, item_ord AS ord, true AS checked, 'order ' || o_orderkey AS text FROM ({_LISTS}) WHERE o_orderstatus = 'F'")
def task_items_extended(spark, sf):
    return X.task_items(nodes_of(D.md_orders, spark, sf, extended=True, kinds=("item",), columns=("node_id", "kind", "text_content", "is_task_list", "checked")), True)


@query("SELECT o_custkey AS doc_id, CAST(0 AS BIGINT) AS headings, CAST(2 AS BIGINT) AS lists, 2 * count(*) AS list_items, count(*) AS task_items, CAST(0 AS BIGINT) AS links FROM orders GROUP BY o_custkey")
def stats_orders(spark, sf):
    kinds = ("document", "heading", "list", "item", "link")
    return X.stats(nodes_of(D.md_orders, spark, sf, kinds=kinds, columns=("kind", "level", "is_task_list"))).select("doc_id", "headings", "lists", "list_items", "task_items", "links")


@query("SELECT doc_id, 1::BIGINT AS headings, 1::BIGINT AS h1, 0::BIGINT AS h2, 0::BIGINT AS h3, 0::BIGINT AS h4, 0::BIGINT AS h5, 0::BIGINT AS h6, 2::BIGINT AS links, 1::BIGINT AS images, 1::BIGINT AS code_blocks, 1::BIGINT AS inline_code, 0::BIGINT AS lists, 0::BIGINT AS list_items, 1::BIGINT AS blockquotes, 1::BIGINT AS thematic_breaks, 0::BIGINT AS tables, 0::BIGINT AS task_items FROM documents")
def stats(spark, sf):
    return X.stats(nodes_of(D.md_docs, spark, sf))


@query("SELECT doc_id, 'Document ' || doc_id AS title FROM documents")
def title_top1(spark, sf):
    return N.titles(nodes_of(D.md_docs, spark, sf))


_TOC = f"SELECT doc_id, 1 AS ord, 1 AS level, 0 AS indent, '1' AS number, r_name AS text FROM {_CUST} UNION ALL SELECT doc_id, 2, 2, 1, '1.1', n_name FROM {_CUST}"


@query(f"SELECT *, replace(replace(lower(text), '_', ''), ' ', '-') AS slug FROM ({_TOC})")
def toc(spark, sf):
    return X.toc(nodes_of(D.md_customers, spark, sf))


@query(f"SELECT doc_id, '- [1 ' || r_name || '](#' || replace(replace(lower(r_name), '_', ''), ' ', '-') || ')' || chr(10) || '  - [1.1 ' || n_name || '](#' || replace(replace(lower(n_name), '_', ''), ' ', '-') || ')' AS toc FROM {_CUST}")
def toc_numbered(spark, sf):
    return X.toc_text(nodes_of(D.md_customers, spark, sf), numbered=True)


@query(f"SELECT doc_id, 1 AS ord, 2 AS level, 0 AS indent, '1' AS number, n_name AS text, replace(replace(lower(n_name), '_', ''), ' ', '-') AS slug FROM {_CUST}")
def toc_range(spark, sf):
    return X.toc(nodes_of(D.md_customers, spark, sf), 2, 3)


@query("SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS slide, role AS title, 2 AS level FROM conversations")
def slides(spark, sf):
    return X.slides(nodes_of(D.md_chat, spark, sf)).where("slide > 0").select("doc_id", "slide", "title", "level")


@query("SELECT conv_id AS doc_id, count(*) AS boundaries, count(*) >= 2 AS is_show FROM conversations GROUP BY conv_id")
def slide_show(spark, sf):
    return X.slides(nodes_of(D.md_chat, spark, sf)).where("slide > 0").groupBy("doc_id").agg(F.count("*").alias("boundaries"), (F.count("*") >= 2).alias("is_show"))


@query("SELECT conv_id AS doc_id, count(*) - 1 AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def thematic_breaks(spark, sf):
    return nodes_of(D.md_chat, spark, sf).where("kind = 'thematic_break'").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'from ' || source || ' in ' || lang AS text FROM documents")
def blockquotes(spark, sf):
    return nodes_of(D.md_docs, spark, sf).where("kind = 'block_quote'").select("doc_id", F.col("text_content").alias("text"))


_ANCH = "SELECT doc_id // 10 AS doc_id, doc_id AS k, 'lang-' || lang AS base, row_number() OVER (PARTITION BY doc_id // 10, lang ORDER BY doc_id) AS r, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS o, lang FROM documents"


@query(f"SELECT doc_id, CAST(o AS INTEGER) AS ord, 'Lang ' || lang AS text, base || CASE WHEN r > 1 THEN '-' || (r - 1) ELSE '' END AS anchor FROM ({_ANCH})")
def unique_anchors(spark, sf):
    return X.unique_anchors(nodes_of(D.md_dup, spark, sf))


_ISSUES = f"""SELECT doc_id, 'warning' AS severity, 'heading' AS category, 'Duplicate heading id: ' || base AS message FROM ({_ANCH}) WHERE r > 1
UNION ALL SELECT DISTINCT doc_id // 10, 'error', 'anchor', 'Broken anchor: #nowhere' FROM documents
UNION ALL SELECT doc_id // 10, 'error', 'anchor', 'Broken anchor: #lang-en' FROM documents GROUP BY doc_id // 10 HAVING count(*) FILTER (lang = 'en') = 0
UNION ALL SELECT DISTINCT doc_id // 10, 'error', 'link', 'Empty link URL for text: none' FROM documents"""


@query(_ISSUES)
def validate(spark, sf):
    return X.validate(nodes_of(D.md_dup, spark, sf, kinds=X.CHECKED))


@query(f"SELECT doc_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (severity = 'error') = 0 AS valid FROM ({_ISSUES}) GROUP BY doc_id")
def validate_report(spark, sf):
    return X.validation_report(X.validate(nodes_of(D.md_dup, spark, sf, kinds=X.CHECKED)))


@query("SELECT doc_id, 'warning' AS severity, 'image' AS category, 'Missing image: /img/' || doc_id || '.png' AS message FROM documents WHERE doc_id % 3 <> 0")
def validate_images(spark, sf):
    assets = documents(spark, sf).where("doc_id % 3 = 0").select(F.concat(F.lit("/img/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    return X.validate(nodes_of(D.md_docs, spark, sf, kinds=X.CHECKED), assets=assets).where("category = 'image'")


@query("SELECT o_custkey AS doc_id, 'a' || o_custkey AS name, CASE WHEN o_custkey % 2 = 0 THEN 'info' ELSE 'error' END AS severity FROM (SELECT DISTINCT o_custkey FROM orders)")
def validate_footnotes(spark, sf):
    k = F.col("doc_id").cast("string")
    docs = D.md_orders(spark, sf).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("[^a"), k, F.lit("]: unused note\n"))).otherwise(F.concat(F.lit("text[^a"), k, F.lit("] without a note\n"))).alias("text"))
    v = X.validate(N.parse_nodes(docs, extended=True)).where("category = 'footnote'")
    return v.select("doc_id", F.regexp_extract("message", r": (\S+)$", 1).alias("name"), "severity")


# --- navigation -----------------------------------------------------------------------------


@query("SELECT o_custkey AS doc_id, count(*) AS n FROM orders GROUP BY o_custkey")
def subtree_range_join(spark, sf):
    """Items below bullet lists, by the nested-interval join."""
    n = nodes_once(D.md_orders(spark, sf), kinds=("list", "item"), columns=("node_id", "subtree_end", "kind", "list_type"))
    d = N.descendants(n.where("kind = 'item'").select("doc_id", "node_id", "kind"), n.where("kind = 'list' and list_type = 'bullet'"))
    return d.where("kind = 'item'").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'strong' AS kind, 'paragraph' AS parent, 'block_quote' AS grandparent FROM documents")
def ancestors(spark, sf):
    n = nodes_once(D.md_docs(spark, sf))
    a = N.ancestors(n, n.where("kind = 'strong'"))
    return a.groupBy("doc_id").agg(F.max(F.when(F.col("distance") == 1, F.col("kind"))).alias("parent"), F.max(F.when(F.col("distance") == 2, F.col("kind"))).alias("grandparent")).select("doc_id", F.lit("strong").alias("kind"), "parent", "grandparent")


@query("SELECT doc_id, 6::BIGINT AS n_children, 'heading' AS first_kind, 'thematic_break' AS last_kind FROM documents")
def siblings(spark, sf):
    n = N.with_siblings(nodes_of(D.md_docs, spark, sf))
    kinds = n.where("depth = 1").groupBy("doc_id").agg((F.count("*") + F.lit(1)).alias("n_children"), F.min_by("kind", "sibling_ord").alias("first_kind"), F.max_by("kind", "sibling_ord").alias("last_kind"))
    return kinds


@query("SELECT doc_id, 4::BIGINT AS blocks FROM documents")
def unlink_subtrees(spark, sf):
    n = nodes_once(D.md_docs(spark, sf))
    rest = N.without_subtrees(n, n.where("kind = 'block_quote'"))
    return rest.where("is_block and depth = 1").groupBy("doc_id").agg(F.count("*").alias("blocks"))


@query(f"SELECT url FROM (SELECT {_ENC.format(u='u')} AS url FROM ({_PAGE_LINKS}) WHERE doc_id % 2 = 0) INTERSECT SELECT url FROM (SELECT {_ENC.format(u='u')} AS url FROM ({_PAGE_LINKS}) WHERE doc_id % 2 = 1)")
def link_set_ops(spark, sf):
    x = X.links(nodes_once(D.md_pages(spark, sf), kinds=("link",)))
    return x.where("doc_id % 2 = 0").select("url").intersect(x.where("doc_id % 2 = 1").select("url"))


@query("SELECT doc_id, 'src' AS label, 'https://' || source || '.example.com/d/' || doc_id AS url FROM documents")
def ref_join(spark, sf):
    """Reference links by a relational join of uses and first definitions, without the parser."""
    t = D.md_docs(spark, sf)
    defs = t.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", "i", F.regexp_extract("line", r"^ {0,3}\[([^\]]+)\]:\s*(\S+)", 1).alias("label"), F.regexp_extract("line", r"^ {0,3}\[([^\]]+)\]:\s*(\S+)", 2).alias("url")).where("label <> ''")
    first = Window.partitionBy("doc_id", "key").orderBy("i")
    defs = defs.withColumn("key", C.normalize_label(F.col("label"))).withColumn("k", F.row_number().over(first)).where("k = 1")
    uses = t.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\]\[([^\]]+)\]"), 1)).alias("label"))
    return uses.withColumn("key", C.normalize_label(F.col("label"))).join(defs.select("doc_id", "key", "url"), ["doc_id", "key"]).select("doc_id", "label", "url")


# --- renderers: the expected text is built from the columns ---------------------------------------

_U = "'https://' || source || '.example.com/d/' || doc_id"


@query(f"SELECT doc_id, '<h1>Document ' || doc_id || '</h1>' || chr(10) || '<blockquote>' || chr(10) || '<p>from <em>' || source || '</em> in <strong>' || lang || '</strong></p>' || chr(10) || '</blockquote>' || chr(10) || '<pre><code class=\"language-' || lang || '\">chars = ' || n_chars || chr(10) || '</code></pre>' || chr(10) || '<p>See <a href=\"' || {_U} || '\" title=\"Title\">the source</a> and <code>code ' || lang || '</code>, <img src=\"/img/' || doc_id || '.png\" alt=\"pic ' || doc_id || '\" /> or <a href=\"https://example.org/' || lang || '\">https://example.org/' || lang || '</a>.</p>' || chr(10) || '<hr />' AS body FROM documents")
def to_html(spark, sf):
    return render(D.md_docs(spark, sf), "html")


@query(f"SELECT doc_id, '# Document ' || doc_id || chr(10) || chr(10) || '> from *' || source || '* in **' || lang || '**' || chr(10) || chr(10) || '```' || lang || ' sample' || chr(10) || 'chars = ' || n_chars || chr(10) || '```' || chr(10) || chr(10) || 'See [the source](' || {_U} || ' \"Title\") and `code ' || lang || '`, ![pic ' || doc_id || '](/img/' || doc_id || '.png) or <https://example.org/' || lang || '>.' || chr(10) || chr(10) || '***' AS body FROM documents")
def fmt(spark, sf):
    return render(D.md_docs(spark, sf), "commonmark")


@query("SELECT o_custkey AS doc_id, count(*) AS items, count(*) FILTER (o_orderstatus = 'F') AS checked FROM orders GROUP BY o_custkey")
def to_html_tasks(spark, sf):
    h = render(D.md_orders(spark, sf), "html", extended=True)
    n = lambda s: F.size(F.regexp_extract_all("body", F.lit(f"({s})"), 1)).cast("long")
    return h.select("doc_id", n("type=.checkbox.").alias("items"), n("checked=.checked.").alias("checked"))


_CB = f"SELECT {_BLOCK} AS doc_id, count(*) AS n FROM customer GROUP BY ALL"


@query(f"SELECT doc_id, n + 1 AS rows, 3 * (n + 1) AS cells FROM ({_CB})")
def to_xml(spark, sf):
    x = render(D.md_customers(spark, sf), "xml")
    n = lambda s: F.size(F.regexp_extract_all("body", F.lit(f"({s})"), 1)).cast("long")
    return x.select("doc_id", (n("<table_row>") - 1).alias("rows"), n("<table_cell>").alias("cells"))


@query("SELECT doc_id, '\\section*{Document ' || doc_id || '}' AS head, '\\begin{lstlisting}[language=' || lang || ']' AS code, '\\href{' || replace('https://' || source || '.example.com/d/' || doc_id, '_', '\\_') || '}{the source}' AS link FROM documents")
def to_latex(spark, sf):
    x = render(D.md_docs(spark, sf), "latex")
    return x.select("doc_id", F.regexp_extract("body", r"(\\section\*\{[^}]*\})", 1).alias("head"), F.regexp_extract("body", r"(\\begin\{lstlisting\}\[[^\]]*\])", 1).alias("code"), F.regexp_extract("body", r"(\\href\{[^}]*\}\{the source\})", 1).alias("link"))


@query("SELECT conv_id AS doc_id, count(*) AS frames FROM conversations GROUP BY conv_id")
def to_beamer(spark, sf):
    return render(D.md_chat(spark, sf), "beamer").select("doc_id", F.size(F.regexp_extract_all("body", F.lit(r"(\\begin\{frame\})"), 1)).cast("long").alias("frames"))


@query("SELECT conv_id AS doc_id, count(*) AS sections FROM conversations GROUP BY conv_id")
def to_revealjs(spark, sf):
    return render(D.md_chat(spark, sf), "revealjs").select("doc_id", F.size(F.regexp_extract_all("body", F.lit("(<section>)"), 1)).cast("long").alias("sections"))


@query("SELECT doc_id, '% Document ' || doc_id AS head, 'chars = ' || n_chars AS code FROM documents")
def to_bibtex(spark, sf):
    x = render(D.md_docs(spark, sf), "bibtex")
    return x.select("doc_id", F.regexp_extract("body", r"^(% Document \d+)", 1).alias("head"), F.regexp_extract("body", r"(chars = \d+)", 1).alias("code"))


_PLAIN = r"[*_$&|<>\[\]`~#\\]"


@query(f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '{_PLAIN}', ' ', 'g'), '\\s+', ' ', 'g'))) AS words FROM documents")
def fmt_wrap80(spark, sf):
    """Wrapping keeps every word in order: all documents, their marks blanked out."""
    d = documents(spark, sf)
    x = render(d.select("doc_id", C.normalize_ws(F.regexp_replace("text", _PLAIN, " ")).alias("text")), "commonmark", width=80)
    return x.select("doc_id", F.md5(C.normalize_ws(F.regexp_replace("body", r"\\(?=[-+.)=])", ""))).alias("words"))


@query()
def fmt_wrap80_whole(spark, sf):
    """Every document, wrapped as it stands: code spans, links, tables, several paragraphs.  SQL cannot state it."""
    return render(documents(spark, sf), "commonmark", width=80)


@query()
def raw_documents(spark, sf):
    """The parser is total on the raw texts: kinds of nodes by language."""
    d = documents(spark, sf)
    return N.parse_nodes(d).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("SELECT page_id AS doc_id, length(split_part(html, chr(10), 1)) AS chars, md5(split_part(html, chr(10), 1)) AS block FROM pages")
def html_blocks(spark, sf):
    """A page begins with a declaration, so its first block of HTML is its first line, whole and as it stands."""
    n = nodes_of(D.md_html, spark, sf, kinds=("html_block",), columns=("node_id", "literal"))
    first = F.rtrim(F.regexp_replace("literal", "\n$", ""))
    return n.where("node_id = 1").select("doc_id", F.char_length(first).cast("long").alias("chars"), F.md5(first).alias("block"))


# --- streams ----------------------------------------------------------------------------------


@query("SELECT conv_id AS doc_id, turn, role AS heading FROM conversations")
def stream_headings(spark, sf):
    c = S.stream_table(spark, f"{sf}/conversations.parquet")
    md = c.select(F.struct("conv_id", "turn").alias("k"), F.concat(F.lit("## "), "role", F.lit("\n\n"), "text").alias("text"))
    n = S.stream_nodes(md, id_col="k").where("kind = 'heading' and depth = 1 and node_id = 1")
    return S.run_to_table(n.select(F.col("k.conv_id").alias("doc_id"), F.col("k.turn").alias("turn"), F.col("text_content").alias("heading")))


_WINDOWS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def _plain_windows(counts: DataFrame) -> DataFrame:
    return counts.withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(_WINDOWS)
def event_windows(spark, sf):
    return _plain_windows(S.event_counts(read_table(spark, sf, "events")))


@query(_WINDOWS)
def event_windows_stream(spark, sf):
    """All windows of the finite run, those up to the last event too; no row is late."""
    return _plain_windows(S.run_to_table(S.event_counts(S.stream_table(spark, f"{sf}/events.parquet"), late=None), "complete"))


# --- templates, definition lists, abbreviations, TeX ----------------------------------------------


@query("SELECT c_custkey, 'Dear ' || c_name || CASE WHEN c_acctbal > 0 THEN ', you have ' || CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) ELSE ', you owe' END || CASE WHEN c_mktsegment = 'BUILDING' THEN ' (builder)' ELSE '' END || '; tags: a=' || c_custkey || ', b=none.' AS letter FROM customer")
def template_render(spark, sf):
    c = read_table(spark, sf, "customer")
    values = {"name": F.col("c_name"), "bal": D.money("c_acctbal"), "seg": F.col("c_mktsegment"), "empty": F.lit("")}
    tags = F.array(F.create_map(F.lit("k"), F.lit("a"), F.lit("v"), F.col("c_custkey").cast("string")), F.create_map(F.lit("k"), F.lit("b"), F.lit("v"), F.lit("")))
    source = 'Dear ${name}$if(bal > 0)$, you have ${bal}$else$, you owe$endif$$if(seg == "BUILDING")$ (builder)$endif$$ifnot(empty)$; $partial(tags)$$endif$.$-- end'
    return c.select("c_custkey", TPL.render(source, values, {"tags": tags}, {"tags": "tags: $for(tags)$${k}=${v:none}$sep$, $endfor$"}).alias("letter"))


@query("SELECT n_regionkey AS doc_id, n_name AS term, 'key ' || n_nationkey || '; region ' || n_regionkey AS definitions FROM nation")
def definition_lists(spark, sf):
    n = read_table(spark, sf, "nation")
    line = F.concat("n_name", F.lit("\n: key "), F.col("n_nationkey").cast("string"), F.lit("\n: region "), F.col("n_regionkey").cast("string"), F.lit("\n"))
    docs = n.groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return L.definition_lists(docs).select("doc_id", "term", F.array_join("definitions", "; ").alias("definitions"))


@query("SELECT r_regionkey AS doc_id, 'The <abbr title=\"' || r_name || ' area\">R' || r_regionkey || '</abbr> and R' || r_regionkey || 'x.' || chr(10) AS text FROM region")
def abbreviations(spark, sf):
    k = F.col("r_regionkey").cast("string")
    docs = read_table(spark, sf, "region").select(F.col("r_regionkey").alias("doc_id"), F.concat(F.lit("The R"), k, F.lit(" and R"), k, F.lit("x.\n*[R"), k, F.lit("]: "), "r_name", F.lit(" area\n")).alias("text"))
    return L.with_abbreviations(docs)


@query("SELECT p_partkey AS doc_id, 'control sequence' AS type, 'item' AS literal, 1 AS line, 1 AS col FROM part UNION ALL SELECT p_partkey, 'comment', p_brand, 2, 3 FROM part")
def tex_tokens(spark, sf):
    docs = read_table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("\\item{a}\nx $"), F.lit("%"), "p_brand").alias("text"))
    docs = docs.withColumn("text", F.replace("text", F.lit("x $%"), F.lit("$ %")))
    return L.tex_tokens(docs).where("type in ('control sequence', 'comment')").select("doc_id", "type", "literal", "line", "col")


@query("SELECT c_custkey AS doc_id, '[TOC levels=1-2]: # ' AS marker, 3 AS first, 4 AS last FROM customer")
def toc_marker(spark, sf):
    docs = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("# "), "c_name", F.lit("\n[TOC levels=1-2]: # \n\n- a\n1. b\n\ntext\n- c\n")).alias("text"))
    return L.toc_marker(docs)


@query(f"SELECT doc_id, ord, 'https://base.org' || {_ENC.format(u='u')} AS url FROM ({_PAGE_LINKS})")
def rewritten_links(spark, sf):
    n = L.rewrite_urls(nodes_of(D.md_pages, spark, sf), lambda u: F.when(u.startswith("/"), F.concat(F.lit("https://base.org"), u)).otherwise(u))
    return X.links(n).select("doc_id", "ord", "url")


@query("SELECT DISTINCT doc_id // 10 AS doc_id, 'https://none.org' AS url FROM documents")
def resolved_links(spark, sf):
    known = spark.createDataFrame([("None", "https://none.org")], "label string, url string")
    return L.resolve_broken_links(X.links(nodes_of(D.md_dup, spark, sf)), known).where("text = 'none'").select("doc_id", "url")


@query(f"SELECT doc_id, '<nav class=\"toc\">' || chr(10) || '<ul>' || chr(10) || '<li><a href=\"#' || replace(replace(lower(r_name), '_', '-'), ' ', '-') || '\">' || r_name || '</a></li>' || chr(10) || '<ul>' || chr(10) || '<li><a href=\"#' || replace(replace(lower(n_name), '_', '-'), ' ', '-') || '\">' || n_name || '</a></li>' || chr(10) || '</ul>' || chr(10) || '</ul>' || chr(10) || '</nav>' AS html FROM {_CUST}")
def toc_html(spark, sf):
    return X.toc_html(nodes_once(D.md_customers(spark, sf), kinds=("heading",)))


@query("SELECT c_custkey AS doc_id, '# ' || c_name || chr(10) || chr(10) || '[TOC levels=2 numbered]: #' || chr(10) || chr(10) || '- [1 Bal](#bal)' || chr(10) || chr(10) || '## Bal' || chr(10) || chr(10) || '- x' AS body FROM customer")
def fmt_with_toc(spark, sf):
    docs = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("# "), "c_name", F.lit(" #\n[TOC levels=2 numbered]: #\n- old\n\nBal\n-\n* x\n")).alias("text"))
    return format_documents(docs.withColumn("text", F.replace("text", F.lit("Bal\n-\n"), F.lit("## Bal ##\n"))))


@query("SELECT o_custkey AS doc_id, 'n' || o_custkey AS name, 'about ' || o_custkey AS content, 2::BIGINT AS n_refs FROM (SELECT DISTINCT o_custkey FROM orders)")
def footnotes(spark, sf):
    k = F.col("o_custkey").cast("string")
    docs = read_table(spark, sf, "orders").select("o_custkey").distinct().select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("a[^n"), k, F.lit("] b[^n"), k, F.lit("]\n\n[^n"), k, F.lit("]: about "), k, F.lit("\n")).alias("text"))
    return X.footnotes(nodes_once(docs, extended=("footnotes",)))


@query("SELECT n_nationkey AS doc_id, true AS ok, 'k|na\"me' || chr(10) || n_nationkey || '|' || n_name || ', x' AS rows FROM nation")
def csv_grids(spark, sf):
    docs = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit('k, "na""me"\r\n'), F.col("n_nationkey").cast("string"), F.lit(',"'), "n_name", F.lit(', x"\n')).alias("text"))
    return L.csv_grids(docs).select("doc_id", "ok", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"))

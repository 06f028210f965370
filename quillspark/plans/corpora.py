"""Markdown corpora derived from the relational tables.

What a query over them must return is known from the tables alone, so the SQL
of a query never parses Markdown.  Documents are bounded: a group that can
grow with the data is cut into numbered documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.text import read_table

ROWS = 500  #: keys in a document of a grouped corpus


def _joined(items, sep: str = "\n"):
    return F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda x: x["line"]), sep)


def money(c):
    return F.col(c).cast("decimal(15,2)").cast("string")


def md_customers(spark: SparkSession, sf: str) -> DataFrame:
    """# region, ## nation, and a table of custkey, name and balance; a document for each nation and block of keys."""
    c = read_table(spark, sf, "customer")
    n, r = F.broadcast(read_table(spark, sf, "nation")), F.broadcast(read_table(spark, sf, "region"))  # 25 and 5 rows by definition
    c = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    line = F.concat(F.lit("| "), F.col("c_custkey").cast("string"), F.lit(" | "), F.col("c_name"), F.lit(" | "), money("c_acctbal"), F.lit(" |"))
    block = F.floor(F.col("c_custkey") / ROWS)
    g = c.groupBy((F.col("c_nationkey").cast("long") * 1_000_000_000 + block).alias("doc_id"), "n_name", "r_name").agg(_joined(F.struct(F.col("c_custkey"), line.alias("line"))).alias("rows"))
    return g.select("doc_id", F.concat(F.lit("# "), "r_name", F.lit("\n\n## "), "n_name", F.lit("\n\n| custkey | name | acctbal |\n|---|:---|---:|\n"), "rows", F.lit("\n")).alias("text"))


def md_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A task list of a customer's orders, ticked where the order is filled, and a numbered list of priorities."""
    o = read_table(spark, sf, "orders")
    task = F.concat(F.when(F.col("o_orderstatus") == "F", "- [x] ").otherwise("- [ ] "), F.lit("order "), F.col("o_orderkey").cast("string"))
    o = o.select("o_custkey", "o_orderkey", task.alias("line"), F.concat(F.lit("1. "), "o_orderpriority").alias("p"))
    g = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(_joined(F.struct("o_orderkey", "line")).alias("tasks"), _joined(F.struct("o_orderkey", F.col("p").alias("line"))).alias("prio"))
    return g.select("doc_id", F.concat("tasks", F.lit("\n\nPriorities\n\n"), "prio", F.lit("\n")).alias("text"))


LINK = r'<a href="([^"]*)">([^<]*)</a>'


def md_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Front matter with the url, the page's h1, and a bullet link for each plain anchor."""
    p = read_table(spark, sf, "pages")
    links = F.zip_with(F.regexp_extract_all("html", F.lit(LINK), 1), F.regexp_extract_all("html", F.lit(LINK), 2), lambda u, t: F.concat(F.lit("- ["), t, F.lit("]("), u, F.lit(")")))
    h1 = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    return p.select(F.col("page_id").alias("doc_id"), F.concat(F.lit("---\nurl: "), "url", F.lit("\n---\n\n# "), h1, F.lit("\n\n"), F.array_join(links, "\n"), F.lit("\n")).alias("text"))


def md_html(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


def md_chat(spark: SparkSession, sf: str) -> DataFrame:
    """## role and the text of every turn, with breaks between turns; a document for each conversation."""
    c = read_table(spark, sf, "conversations")
    line = F.concat(F.lit("## "), "role", F.lit("\n\n"), F.regexp_replace("text", r"\s+", " "))
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(_joined(F.struct("turn", line.alias("line")), "\n\n---\n\n").alias("text"))


def md_docs(spark: SparkSession, sf: str) -> DataFrame:
    """A heading, a quote, a fenced block, emphasis, an image, and a reference link with its definition."""
    d = read_table(spark, sf, "documents")
    k = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("# Document "), k, F.lit("\n\n> from *"), "source", F.lit("* in **"), "lang", F.lit("**\n\n```"), "lang", F.lit(" sample\nchars = "), F.col("n_chars").cast("string"),
        F.lit("\n```\n\nSee [the source][src] and `code "), "lang", F.lit("`, ![pic "), k, F.lit("](/img/"), k, F.lit(".png) or <https://example.org/"), "lang", F.lit(">.\n\n***\n\n[SRC]: https://"), "source", F.lit(".example.com/d/"), k, F.lit(" 'Title'\n"),
    )
    return d.select("doc_id", text.alias("text"))


def md_dup(spark: SparkSession, sf: str) -> DataFrame:
    """Headings that repeat by lang in each block of documents, with one good and one broken anchor and an empty link."""
    d = read_table(spark, sf, "documents")
    g = d.groupBy(F.floor(F.col("doc_id") / 10).alias("doc_id")).agg(_joined(F.struct(F.col("doc_id").alias("k"), F.concat(F.lit("## Lang "), "lang").alias("line")), "\n\n").alias("h"))
    return g.select("doc_id", F.concat("h", F.lit("\n\n[ok](#lang-en) [bad](#nowhere) [none]() [odd](<http://a b>)\n")).alias("text"))

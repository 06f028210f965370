"""Line-level extensions: definition lists, abbreviations, TeX tokens, contents markers, custom links."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..kernel.tex import tokenize
from .nodes import spread


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, i, line), lines from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


def definition_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, term_line, term, definitions): a term line and the ``:`` lines right after it, by sessions over the lines."""
    w = Window.partitionBy("doc_id").orderBy("i")
    x = lines(docs).withColumn("is_def", C.is_definition_line(F.col("line")))
    x = x.withColumn("group", F.sum(F.when(F.col("is_def"), 0).otherwise(1)).over(w))
    g = x.groupBy("doc_id", "group").agg(F.min("i").alias("term_line"), F.min_by("line", "i").alias("term"), F.array_sort(F.collect_list(F.when(F.col("is_def"), F.struct("i", C.definition_text(F.col("line")).alias("d"))))).alias("ds"))
    g = g.where((F.size("ds") > 0) & (F.trim("term") != "") & ~C.is_definition_line(F.col("term")))
    return g.select("doc_id", "term_line", F.trim("term").alias("term"), F.transform("ds", lambda d: d["d"]).alias("definitions"))


def definition_html(d: DataFrame) -> DataFrame:
    """(doc_id, html) of all definition lists of a document."""
    item = F.concat(F.lit("<dt>"), C.escape_html(F.col("term")), F.lit("</dt>\n"), F.array_join(F.transform("definitions", lambda x: F.concat(F.lit("<dd>"), C.escape_html(x), F.lit("</dd>\n"))), ""))
    g = d.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term_line", item.alias("h")))).alias("x"))
    return g.select("doc_id", F.concat(F.lit("<dl>\n"), F.array_join(F.transform("x", lambda x: x["h"]), ""), F.lit("</dl>")).alias("html"))


def definition_markdown(term: Column, definitions: Column) -> Column:
    return F.concat(term, F.lit("\n"), F.array_join(F.transform(definitions, lambda d: F.concat(F.lit(": "), d)), "\n"))


def abbreviations(docs: DataFrame) -> DataFrame:
    """(doc_id, term, meaning): the last definition of a term wins."""
    x = lines(docs).where(C.is_abbreviation(F.col("line"))).select("doc_id", "i", C.abbreviation_term(F.col("line")).alias("term"), C.abbreviation_text(F.col("line")).alias("meaning"))
    return x.groupBy("doc_id", "term").agg(F.max_by("meaning", "i").alias("meaning"))


def with_abbreviations(docs: DataFrame) -> DataFrame:
    """(doc_id, text): words that a document abbreviates become ``<abbr>``, its definitions go; the longest term wins."""
    found = abbreviations(docs).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "meaning"))).alias("terms"))
    rows = docs.select("doc_id", "text").join(found, "doc_id", "left")

    def run(batches):
        for b in batches:
            out = []
            for text, terms in zip(b.column(1), b.column(2), strict=True):
                text, terms = text.as_py(), dict(terms.as_py() or [])
                if text and terms:
                    text = "\n".join(x for x in text.split("\n") if not re.match(r"\*\[[^\]]+\]:", x))
                    names = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
                    esc = lambda s: s.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")
                    text = re.sub(rf"(?<!\w)(?:{names})(?!\w)", lambda m, terms=terms, esc=esc: f'<abbr title="{esc(terms[m[0]])}">{m[0]}</abbr>', text)
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "text", "terms").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def tex_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, type, literal, line, col) of TeX sources."""

    def run(batches):
        for b in batches:
            rows: list[tuple] = []

            def flush(rows, like=b.schema.field(0).type):
                types = (like, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "ord", "type", "literal", "line", "col"])

            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for i, token in enumerate(tokenize(text.as_py() or "")):
                    rows.append((key, i, *token))
                    if len(rows) >= 10_000:
                        yield flush(rows)
                        rows = []
            if rows:
                yield flush(rows)

    return spread(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ord int, type string, literal string, line int, col int")


def toc_marker(docs: DataFrame) -> DataFrame:
    """(doc_id, marker, first, last): the first ``[TOC ...]: #`` line, and the lines of the list right after it."""
    x = lines(docs).withColumn("is_marker", F.trim("line").rlike(r"^\[TOC\s*[^\]]*\]\s*:\s*#(?:\s+.*)?$"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("at", F.min(F.when(F.col("is_marker"), F.col("i"))).over(w)).where("i > at or is_marker")
    after = (F.col("i") > F.col("at")) & (F.trim("line") != "")
    x = x.withColumn("stop", F.min(F.when(after & ~F.trim("line").rlike("^(-|[0-9])"), F.col("i"))).over(w))
    inside = after & F.col("stop").isNull()
    return x.groupBy("doc_id").agg(F.min_by("line", "i").alias("marker"), F.min(F.when(inside, F.col("i"))).alias("first"), F.max(F.when(inside, F.col("i"))).alias("last"))


def rewrite_urls(nodes: DataFrame, rewrite: Callable[[Column], Column]) -> DataFrame:
    """The node table with every url passed through a column function."""
    return nodes.withColumn("url", F.when(F.col("url").isNotNull(), rewrite(F.col("url"))))


def resolve_broken_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links whose url is empty take the url that a (label, url) table has for their text."""
    k = known.select(C.normalize_label(F.col("label")).alias("key"), F.col("url").alias("known_url"))
    out = links.withColumn("key", C.normalize_label(F.col("text"))).join(k, "key", "left")
    return out.withColumn("url", F.when(F.trim("url") == "", F.coalesce("known_url", "url")).otherwise(F.col("url"))).drop("key", "known_url")


def read_csv_grid(text: str, sep: str = ",", quote: str = '"') -> list[list[str]] | None:
    """Rows of delimited text with quotes and doubled quotes; None where rows differ in length."""
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep, quotechar=quote, skipinitialspace=True) if r]
    return None if len({len(r) for r in rows}) > 1 else rows


def csv_grids(docs: DataFrame, sep: str = ",") -> DataFrame:
    """(doc_id, ok, rows) of delimited texts; a ragged one has ok false and null rows, it fails no job."""

    def run(batches):
        for b in batches:
            grids = [read_csv_grid(t.as_py() or "", sep) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g is not None for g in grids]), pa.array(grids, pa.list_(pa.list_(pa.string())))], names=["doc_id", "ok", "rows"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ok boolean, rows array<array<string>>")

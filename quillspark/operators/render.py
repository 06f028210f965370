"""Rendering of documents: one Arrow pass, a kernel for each format."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernel import writers
from ..kernel.html import to_html
from ..kernel.markdown import Options, format_text, to_markdown
from ..sources.text import FORMATS, register_format
from .nodes import CHUNK_CHARS, spread, tree_of

for _name, _render, _ext, _mime in (
    ("page", writers.to_page, "html", "text/html"), ("revealjs", writers.to_revealjs, "html", "text/html"), ("html", to_html, "html", "text/html"), ("xml", writers.to_xml, "xml", "application/xml"),
    ("beamer", writers.to_beamer, "tex", "application/x-tex"), ("latex", writers.to_latex, "tex", "application/x-tex"), ("bibtex", writers.to_bibtex, "bib", "application/x-bibtex"), ("commonmark", to_markdown, "md", "text/markdown"),
):
    register_format(_name, _render, _ext, _mime)


def _bodies(batch: pa.RecordBatch, write: Callable[[str | None], str]):
    """(doc, body) of a batch of (doc, text), in pieces of about CHUNK_CHARS: Python never holds the bodies of a whole batch."""
    begin, bodies, chars = 0, [], 0
    for i, t in enumerate(batch.column(1)):
        t = t.as_py()
        bodies.append(write(t))
        chars += len(t or "") + len(bodies[-1])
        if chars >= CHUNK_CHARS or i + 1 == batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(bodies)), pa.array(bodies, pa.string())], names=["doc", "body"])
            begin, bodies, chars = i + 1, [], 0


def render(docs: DataFrame, fmt: str = "html", *, id_col: str = "doc_id", text_col: str = "text", extended: bool = False, smart: bool = False, shortcodes: dict[str, str] | None = None, **options: Any) -> DataFrame:
    """(id_col, body); an unknown format raises here, not in a task."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {sorted(FORMATS)}")
    write = FORMATS[fmt]
    rows = spread(docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")))

    def run(batches):
        for b in batches:
            yield from _bodies(b, lambda t: write(tree_of(t, extended, smart=smart, shortcodes=shortcodes), **options))

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, body string").withColumnRenamed("doc", id_col)


def format_documents(docs: DataFrame, *, width: int = 0, cjk_spacing: bool = False, id_col: str = "doc_id", text_col: str = "text", **options: Any) -> DataFrame:
    """(id_col, body): formatted Markdown; a contents marker keeps its place and gets a new list.

    Further options, handlers of single kinds of nodes among them, are those of
    :class:`quillspark.kernel.markdown.Options`; wrong ones raise here.
    """
    Options(width, cjk_spacing=cjk_spacing, **options)
    rows = spread(docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")))

    def run(batches):
        for b in batches:
            yield from _bodies(b, lambda t: format_text(t or "", width, cjk_spacing, **options))

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, body string").withColumnRenamed("doc", id_col)

"""Text files as documents, derived corpora's tables, and sinks for results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, text): one row for each file, a leading byte order mark removed."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))
    return t.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "text")


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sources(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """(kind, name, text) of in-memory sources: kind is file, string or url."""
    return spark.createDataFrame(rows, "kind string, name string, text string")


def concat_sources(s: DataFrame, order: str = "name") -> DataFrame:
    """One row with all texts in order, and the totals of lines and characters; for bounded sets of sources."""
    return s.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.coalesce(F.sum(C.count_lines(F.col("text"))), F.lit(0)).alias("n_lines"),
        F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n_chars"),
    )


def with_offsets(s: DataFrame, order: str = "name") -> DataFrame:
    """``s`` with line_offset and char_offset: where each source begins in the set of all, laid end to end in order with a line end between two.

    Prefix sums over ranges of the order, so no task sees the whole set; null texts are empty.
    """
    from ..operators.ordering import running

    t = F.coalesce("text", F.lit(""))
    return running(s, order, sums={"line_offset": C.count_lines(t), "char_offset": (F.char_length(t) + 1).cast("long")}).drop("position")


def source_at(offsets: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (place) with the source that holds each character of the whole and the character in it; places beyond the end have none.

    Sources are disjoint intervals, so an as-of join: both are put in one order,
    and each place takes the last source that begins before it.
    """
    from ..operators.ordering import running

    begins = offsets.select(F.col("char_offset").alias("at"), F.lit(0).alias("kind"), "name", (F.char_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"))
    asks = places.select(F.col("place").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("size"))
    both = running(begins.unionByName(asks), "at", "kind", sums={"source_no": (F.col("kind") == 0).cast("long")})
    numbered = both.where("kind = 0").select((F.col("source_no") + 1).alias("source_no"), "name", F.col("at").alias("begin"), "size")
    found = both.where("kind = 1").select(F.col("at").alias("place"), "source_no").join(numbered, "source_no", "left")
    inside = F.col("place") - F.col("begin")
    held = inside < F.col("size")
    return found.select("place", F.when(held, F.col("name")).alias("name"), F.when(held, inside).alias("char"))


def media_bag(files: DataFrame) -> DataFrame:
    """(key, mime, content): binary files once for each content, named by hash and extension."""
    named = files.select(F.concat(F.md5("content"), F.when(C.extension(F.col("path")) != "", F.concat(F.lit("."), C.extension(F.col("path")))).otherwise("")).alias("key"), C.mime_type_or_default(F.col("path")).alias("mime"), "content")
    return named.dropDuplicates(["key"])


#: Renderers by format name, and the (extension, MIME type) of its files; :func:`register_format` adds one, the last registered wins.
FORMATS: dict[str, Callable] = {}
FILES: dict[str, tuple[str, str]] = {}


def register_format(name: str, render: Callable, extension: str = "txt", mime: str = "text/plain") -> None:
    FORMATS[name] = render
    FILES[name] = extension, mime


def file_type(path: str) -> tuple[str | None, str]:
    """(format, MIME type) by a path's extension: the last registered format that has it, else the format and type that the extension is known for."""
    ext = path.rpartition("/")[2].rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    for name, (of, mime) in reversed(FILES.items()):
        if of == ext:
            return name, mime
    return C.FORMATS.get(ext), C.MIME.get(ext, "application/octet-stream")


def write_rendered(docs: DataFrame, path: str, fmt: str = "html", **options) -> None:
    """Render documents and write them as Parquet, partitioned by format; an unknown format fails when the plan is built."""
    from ..operators.render import render

    render(docs, fmt, **options).withColumn("format", F.lit(fmt)).write.mode("overwrite").partitionBy("format").parquet(path)

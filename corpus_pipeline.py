"""The corpus pipeline: toxicity, line dedup, near-duplicate join, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of ``documents``; the last one returns the packing.
Stages are written as Parquet and read again, so each starts from a table that
survives lost executors.

* toxicity: documents that score 0.7 or more go; the grammar learns from all
  labelled rows but the held-out third.
* line dedup: later copies of line runs of 20 words or more leave the text;
  a document that had text and loses all of it goes.
* n-gram join: five-word shingles, Jaccard 0.8; the smallest id of each group
  of linked documents stays, as do documents without words.
* decontamination: documents that hold a benchmark item within its edit budget go.
* packing: one row for each piece of a document.

Defined cases: rows with a null id pass every filter but can link with
nothing; null and empty texts are kept until packing, where they get no batch;
rows that repeat an id go or stay together, but for line dedup, where rows with
other texts are documents of their own; of tied copies the smaller id stays;
columns other than those of documents are dropped, whatever their names; an
empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import read, stage
from quillspark.llm.decontam import contamination
from quillspark.llm.line_runs import line_run_dedup
from quillspark.llm.ngram_join import ngram_join
from quillspark.llm.packing import pack
from quillspark.llm.queries import crc_mod
from quillspark.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = score_toxicity(docs, read(spark, sf_dir, "labels"), crc_mod(3) != 1)
    rejected = scored.where("score >= 0.7 and doc_id is not null").select("doc_id").distinct()
    return docs.join(rejected.hint("merge"), "doc_id", "left_anti").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_run_dedup(docs.select(COLUMNS))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", r"\s", "")) == "")
    kept = out.where(~F.coalesce(emptied, F.lit(False)))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join(docs, words=5, num=80, den=100)
    copies = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies.hint("merge"), "doc_id", "left_anti").select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = contamination(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks.hint("merge"), "doc_id", "left_anti").select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("packing", packing)]
#: Packing and the grammar have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs

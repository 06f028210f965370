"""Line dedup by a suffix array over line-id sequences (operator 8).

Every document is a sequence of line ids.  Suffix ranks come from distributed
prefix doubling with discarding: rank 0 orders the ids of repeated lines, and
the rank of the first 2k lines orders the pairs of ranks of k lines; suffixes
that are unique at a depth take no further part.  Ranks are order-preserving
row numbers of a range-partitioned sort, so no step gathers the corpus.

A run of lines counts when it holds at least ``min_words`` words.  The LCP
interval of a suffix at depth l is named by the ranks of its first and last
2^j <= l lines, and its earliest suffix (by id, then line) stays.  A repeated
run is the union of the shortest counting windows that start, and of those
that end, at its lines; all members of an interval but the earliest are later
copies, and the union of their windows is exactly the union of the maximal
repeated runs, which is deleted.

Defined cases: null and empty texts have no lines and stay as they are; lines
compare without surrounding white space; blank lines take part in runs but
have no words; rows that repeat an id and a text are one document to the order,
so they are no copies of each other; rows that repeat an id with other texts are
documents of their own, ordered by a hash of the text; rows with a null id stay
as they are; a document whose every line goes has an empty text; other columns
pass through, and a count whose name an input column has is left out; an empty
table gives an empty result.  Ids are integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, numbered, stage


def windows(counts: list[int], least: int) -> tuple[list[int], list[int]]:
    """Lines of the shortest window of ``least`` words from each line, and to each line (0: none)."""
    n = len(counts)
    total = np.concatenate(([0], np.cumsum(counts)))
    end = np.searchsorted(total, total[:-1] + least)
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    fwd = np.where(end <= n, end - np.arange(n), 0)
    back = np.where(total[1:] >= least, np.arange(1, n + 1) - start, 0)
    return fwd.tolist(), back.tolist()


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(id, i, line, fwd, back): 64-bit line ids with their shortest counting windows."""

    def run(batches):
        for b in batches:
            ids, at, line, fwd, back = [], [], [], [], []
            for key, text in zip(b.column(0), b.column(1), strict=True):
                text = (text.as_py() or "").encode()
                if not text:
                    continue
                got = [x.strip() for x in text.split(b"\n")]
                f, k = windows([len(x.split()) for x in got], least)
                if not any(f):
                    continue  # too few words for any run
                ids += [key.as_py()] * len(got)
                at += range(len(got))
                line += [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in got]
                fwd += f
                back += k
                if len(ids) > 20_000:
                    yield _batch(ids, at, line, fwd, back)
                    ids, at, line, fwd, back = [], [], [], [], []
            yield _batch(ids, at, line, fwd, back)

    return docs.mapInArrow(run, "id long, i int, line long, fwd int, back int")


def _batch(ids, at, line, fwd, back):
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(line, pa.int64()), pa.array(fwd, pa.int32()), pa.array(back, pa.int32())], names=["id", "i", "line", "fwd", "back"])


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Order-preserving ranks of the key combinations that more than one row has: (keys, rank)."""
    names = rows.groupBy(*keys).agg(F.count("*").alias("k")).where("k > 1").select(*keys)
    return stage(names.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()))


def repeated_windows(docs: DataFrame, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """(id, first, n): windows of lines, of at least ``least`` words, that occur earlier too; and the staged tables it reads."""
    lines = stage(_lines(docs, least))
    base = ranked(lines, ["line"])
    live = stage(lines.join(base, "line").select("id", "i", "rank", "fwd", "back"))
    drop_staged(lines)
    drop_staged(base)
    level, found = 0, None
    levels = live.select("id", "i", F.col("rank").alias("r"))
    ends = live.where("back > 0").select("id", (F.col("i") - F.col("back") + 1).alias("i"), F.col("back").alias("n"))
    wanted = stage(live.where("fwd > 0").select("id", "i", F.col("fwd").alias("n")).union(ends).distinct())
    held, last = [live, wanted], live  # last: the table that the ranks of this level are in
    while True:
        step = 2**level
        here = wanted.where((F.col("n") >= step) & (F.col("n") < 2 * step))
        left = here.join(levels, ["id", "i"])
        right = levels.select("id", F.col("i").alias("j"), F.col("r").alias("q"))
        named = left.withColumn("j", F.col("i") + F.col("n") - step).join(right, ["id", "j"])
        interval = named.groupBy("n", "r", "q").agg(F.min(F.struct("id", "i")).alias("first"), F.count("*").alias("k")).where("k > 1")
        later = named.join(interval, ["n", "r", "q"]).where("struct(id, i) > first").select("id", F.col("i").alias("first"), "n")
        later = stage(later)
        held.append(later)
        found = later if found is None else found.union(later)
        if wanted.where(F.col("n") >= 2 * step).isEmpty():
            return found, [*held, last]
        ahead = levels.select("id", (F.col("i") - step).alias("i"), F.col("r").alias("r2"))
        doubled = stage(levels.join(ahead, ["id", "i"]))
        names = ranked(doubled, ["r", "r2"])
        if last is not live:
            drop_staged(last)
        levels = last = stage(doubled.join(names, ["r", "r2"]).select("id", "i", F.col("rank").alias("r")))
        drop_staged(doubled)
        drop_staged(names)
        wanted = wanted.where(F.col("n") >= 2 * step)
        level += 1


def line_run_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """The columns of ``docs`` with later copies of repeated line runs deleted from the text, and n_lines, n_removed, n_words_removed."""
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(c).alias(inner[c]) for c in docs.columns), F.col(id_col).cast("long").alias("__id"))
    rows, _ = numbered(rows, "__id", inner[text_col])
    slim = rows.select(F.col("__id").alias("id"), F.col(inner[text_col]).cast("string").alias("text")).where("id is not null")
    found, used = repeated_windows(slim, min_words)
    gone = stage(found.groupBy("id").agg(F.collect_list(F.struct("first", "n")).alias("gone")), sweep=True)
    for table in used:
        drop_staged(table)
    rows = rows.join(gone.hint("merge"), F.col("__id") == F.col("id"), "left").drop("id", "__id")  # one plan at every size
    at = [inner[c] for c in docs.columns].index(inner[text_col])
    names = [*inner.values()]

    def run(batches):
        for b in batches:
            texts, counts = [], []
            for text, cuts in zip(b.column(at), b.column(len(names)), strict=True):
                text = text.as_py()
                if not text:
                    texts.append(text)
                    counts.append((0, 0, 0))
                    continue
                if not cuts.is_valid:
                    texts.append(text)
                    counts.append((text.count("\n") + 1, 0, 0))
                    continue
                got = text.split("\n")
                mark = np.zeros(len(got) + 1, np.int64)
                for c in cuts.as_py():
                    mark[c["first"]] += 1
                    mark[c["first"] + c["n"]] -= 1
                dead = np.cumsum(mark)[:-1] > 0
                texts.append("\n".join(x for x, d in zip(got, dead, strict=True) if not d))
                counts.append((len(got), int(dead.sum()), sum(len(x.split()) for x, d in zip(got, dead, strict=True) if d)))
            cols = [pa.array(texts, b.schema.field(i).type) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))], names=[*names, "n_lines", "n_removed", "n_words_removed"])

    kinds = ", ".join(f"{inner[c]} {'string' if c == text_col else docs.schema[c].dataType.simpleString()}" for c in docs.columns)
    out = rows.select(*(F.col(inner[c]).cast("string").alias(inner[c]) if c == text_col else inner[c] for c in docs.columns), "gone").mapInArrow(run, f"{kinds}, n_lines long, n_removed long, n_words_removed long")
    more = [c for c in ("n_lines", "n_removed", "n_words_removed") if c not in docs.columns]
    return out.select(*(F.col(inner[c]).alias(c) for c in docs.columns), *more)

"""Packing into optimal length buckets (operator 9).

A dynamic programme over the global length histogram picks the bucket
boundaries that minimise padding; inside each bucket, sequences form batches
under a token budget.  Only the histogram (at most ``max_len`` rows) reaches
the driver.  Batches form inside salted cells of bounded size, so a bucket
that holds most rows is no bottleneck.

Defined cases: a null or blank text has no tokens; it stays as one row whose
bucket, batch and slot are null.  Texts above ``max_len`` tokens are cut into
pieces, none is dropped.  Rows that repeat an id get slots of their own; tied
slots of one id may fall to either of its rows.  Other columns, whatever their
names, are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_count(text: Column) -> Column:
    """Whitespace-separated words, as the default length in tokens."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " +"))).cast("long")


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with least total padding.

    best[k][j]: least padding of the first j lengths in k buckets.  The cost is
    a Monge matrix, so each row of the programme is found by divide and
    conquer over the monotone argmins, in O(k n log n).
    """
    if not lengths:
        return []
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(x)
    rows, tokens = np.concatenate(([0], np.cumsum(c))), np.concatenate(([0], np.cumsum(c * x)))
    inf = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, inf, np.int64)
    best[0] = 0
    cuts, values = [], []
    for _ in range(min(buckets, n)):
        new, arg = np.full(n + 1, inf, np.int64), np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = np.where(best[i] >= inf, inf, best[i] + x[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i]))
            k = int(cost.argmin())
            new[j], arg[j] = min(int(cost[k]), inf), i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        best = new
        cuts.append(arg)
        values.append(int(new[n]))
    j, out = n, []
    for arg in reversed(cuts[: int(np.argmin(values)) + 1]):
        if j == 0:
            break
        out.append(int(x[j - 1]))
        j = int(arg[j])
    return out[::-1]


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: Column | None = None,
    max_len: int = 2048,
    buckets: int = 12,
    token_budget: int = 32768,
    cell_rows: int = 50_000,
) -> DataFrame:
    """One row for each piece: (doc_id, piece, n_tokens, bucket, bucket_len, padding, cell, batch, slot).

    ``length`` is the column with the number of tokens (default: words).  A
    batch is named by (bucket, cell, batch) and holds at most
    ``token_budget // bucket_len`` pieces, at least one.
    """
    size = (length if length is not None else word_count(docs[text_col])).cast("long")
    docs = docs.select(docs[id_col].alias("doc_id"), F.coalesce(size, F.lit(0)).alias("total"))
    last = F.greatest(F.ceil(F.col("total") / max_len), F.lit(1)) - 1
    pieces = docs.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("doc_id", F.col("piece").cast("int"), F.least(F.lit(max_len), F.col("total") - F.col("piece") * max_len).cast("int").alias("n_tokens"))
    seen = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    blank = max(1, -(-seen.pop(0, 0) // cell_rows))  # cells of the rows without tokens
    bounds = best_boundaries(list(seen), list(seen.values()), buckets)
    bucket, width, room, cells = (F.lit(None).cast("int") for _ in range(4))
    for i in range(len(bounds) - 1, -1, -1):
        fits = (F.col("n_tokens") <= bounds[i]) & (F.col("n_tokens") > 0)
        n = sum(v for k, v in seen.items() if (bounds[i - 1] if i else 0) < k <= bounds[i])
        bucket, width = F.when(fits, i).otherwise(bucket), F.when(fits, bounds[i]).otherwise(width)
        room, cells = F.when(fits, max(1, token_budget // bounds[i])).otherwise(room), F.when(fits, -(-n // cell_rows)).otherwise(cells)
    out = pieces.select("*", bucket.alias("bucket"), width.alias("bucket_len"), room.alias("room"), F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce(cells, F.lit(blank)).cast("long")).cast("int").alias("cell"))
    rank = F.row_number().over(Window.partitionBy("bucket", "cell").orderBy("doc_id", "piece")) - 1
    out = out.withColumn("rank", rank)
    return out.select(
        "doc_id", "piece", "n_tokens", "bucket", "bucket_len", (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        F.when(F.col("bucket").isNotNull(), F.col("cell")).alias("cell"), F.floor(F.col("rank") / F.col("room")).cast("int").alias("batch"), F.when(F.col("bucket").isNotNull(), F.col("rank") % F.col("room")).cast("int").alias("slot"),
    )

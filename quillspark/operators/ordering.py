"""Total orders and running totals over whole tables, without a task that sees them all.

Rows are dealt out by ranges of the order (:func:`ordered`), so each task sorts
its own range; the totals of the ranges are few, one row each, and their running
sums, joined back, carry every range on from where the one before ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage


def ordered(rows: DataFrame, *order: Column | str, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``range_no`` and ``range_row``, staged: range after range and row after row is the order.

    Rows that are equal in ``order`` stand in the order of their other columns by
    hash, so the order is total up to rows that are equal in all; these are alike.
    Many equal rows spread over several ranges.  Nulls stand first, or last under
    a descending order, as in Spark's sort.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    tie = F.xxhash64(*(F.col(c).cast("string") if t.startswith("map") else F.col(c) for c, t in rows.dtypes))
    dealt = rows.withColumn("__tie", tie).repartitionByRange(n, *keys, "__tie").sortWithinPartitions(*keys, "__tie")
    numbered = dealt.withColumns({"range_no": F.spark_partition_id(), "range_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    return stage(numbered.drop("__tie"))


def running(rows: DataFrame, *order: Column | str, sums: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``position`` (from 0 in the order) and, for each of ``sums``, the total over the rows before."""
    sums = {} if sums is None else sums
    held = ordered(rows, *order, ranges=ranges)
    totals = held.groupBy("range_no").agg(F.count("*").alias("__rows"), *(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select("range_no", *(F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in ("rows", *sums)))
    inside = Window.partitionBy("range_no").orderBy("range_row").rowsBetween(Window.unboundedPreceding, -1)
    out = held.withColumns({f"__in_{k}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}) if sums else held
    out = out.join(F.broadcast(totals), "range_no")  # as many rows as ranges
    return out.select(*rows.columns, (F.col("__rows") + F.col("range_row")).alias("position"), *((F.col(f"__{k}") + F.col(f"__in_{k}")).alias(k) for k in sums))


def top(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of the order with their position; each task keeps ``n`` of its rows at most."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    return rows.orderBy(*keys).limit(n).withColumn("position", F.row_number().over(Window.orderBy(*keys)) - 1)

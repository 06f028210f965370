"""Mergeable summaries: distinct counts and quantiles of any union of groups from one staged row a group.

``sketch`` summarises each group once; ``merged`` and the estimates answer for any
coarser grouping from these rows, never from the data again.  Distinct counts
are HyperLogLog registers (Spark's ``hll_sketch_agg``); quantiles are counts in
buckets whose borders grow by a factor, so a quantile is off by ``error`` of its
value at most, whatever the distribution, and buckets of unions just add up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float) -> Column:
    """The number of the bucket that a positive value falls in, by the logarithm to the base gamma."""
    return F.ceil(F.log(value) / F.lit(math.log(gamma(error)))).cast("int")


def quantile_counts(rows: DataFrame, value: str, by: list[str], error: float = 0.01) -> DataFrame:
    """(by, sign, bucket, n): how many values of each group fall into each bucket; nulls and NaN are left out.

    Counts of unions are sums of counts: that is the whole merge.
    """
    v = F.col(value).cast("double")
    rows = rows.where(v.isNotNull() & ~F.isnan(v))
    return rows.select(*by, F.signum(v).cast("int").alias("sign"), F.when(v != 0, bucket(F.abs(v), error)).otherwise(0).alias("bucket")).groupBy(*by, "sign", "bucket").agg(F.count("*").alias("n"))


def quantiles(counts: DataFrame, by: list[str], at: list[float], error: float = 0.01) -> DataFrame:
    """(by, quantile, estimate) from bucket counts: the middle of the bucket that holds the row of that rank.

    The rank of quantile q among n values is floor(q * (n - 1)), from 0.  A group's
    buckets are as many as its values spread over, a few thousand at most.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(F.col("sign"), F.col("sign") * F.col("bucket"))
    merged = counts.groupBy(*by, "sign", "bucket").agg(F.sum("n").alias("n"))
    merged = merged.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    asked = merged.select("*", F.explode(F.array(*(F.lit(float(q)) for q in at))).alias("quantile"))
    rank = F.floor(F.col("quantile") * (F.col("all") - 1))
    hit = asked.where((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
    g = gamma(error)
    middle = F.pow(F.lit(g), F.col("bucket")) * F.lit(2 / (g + 1))
    return hit.select(*by, "quantile", F.when(F.col("sign") == 0, 0.0).otherwise(F.col("sign") * middle).alias("estimate"))


def distinct_sketch(rows: DataFrame, value: str, by: list[str], bits: int = 12) -> DataFrame:
    """(by, hll, n): HyperLogLog registers of each group; about 1.04 / sqrt(2**bits) is the standard error."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(value, F.lit(bits)).alias("hll"), F.count(value).alias("n"))


def distinct_estimates(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, distinct, n) of the unions that ``by`` makes."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("distinct"), F.sum("n").alias("n"))

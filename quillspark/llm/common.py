"""Helpers shared by the operators: staged tables, word hashing, components.

Scratch data never touches machine-local folders on a cluster: tables that cut
lineage are written below ``spark.checkpoint.dir``, which every executor sees.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about so many bytes, to bound memory.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quillspark-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, sweep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    ``sweep``, for steps that shuffle much: the driver's garbage is collected,
    so that Spark's cleaner deletes the shuffle files of the steps before, which
    nothing refers to any more, instead of keeping all until the end.  A JVM may
    ignore it; then they stay until the driver collects its garbage by itself.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/quillspark/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.staged_path = path
    del df  # else its plan stays alive, and with it the shuffles
    for _ in range(2 if sweep else 0):  # what the first one frees in Python lets go of more in the JVM
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete what :func:`stage` wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "staged_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def numbered(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """Rows under ids that no two texts share, and (node, doc): what the new ids stand for.

    Where no id repeats with another text, which one aggregation tells, the rows
    stay as they are and there are no names.  Else every pair of id and text
    gets a number; numbers are in the order of the ids, and of a hash of the
    text where ids are equal.  Null ids stay null.
    """
    version = F.xxhash64(text_col)
    seen = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), version.alias("v"))
    if seen.groupBy("doc").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").isEmpty():
        return rows, None
    names = seen.distinct().repartitionByRange("doc", "v").sortWithinPartitions("doc", "v").withColumn("node", F.monotonically_increasing_id())
    names = stage(names)
    joined = rows.withColumn("__v", version).join(names.hint("merge"), (F.col(id_col) == F.col("doc")) & (F.col("__v") == F.col("v")), "left")
    return joined.select(*(F.col("node").alias(id_col) if c == id_col else c for c in rows.columns)), names.select("node", "doc")


def slices(batch: pa.RecordBatch, column: str = "text"):
    """Yield (first row, list of UTF-8 bytes) slices of a batch; null texts are empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    start, size, got = 0, 0, []
    for i, x in enumerate(col):
        x = x.as_py() or b""
        got.append(x)
        size += len(x)
        if size >= SLICE_BYTES:
            yield start, got
            start, size, got = i + 1, 0, []
    if got:
        yield start, got


# --- vectorised hashing of words -------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_POW = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW["n"] < n:
        n = max(n, SLICE_BYTES * 2)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POW[name] = np.multiply.accumulate(p)
        _POW["n"] = n
    return _POW["up"], _POW["down"]


def words_of(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts: (buffer, starts, ends, text index, 64-bit hash)."""
    joined = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    space = _SPACE[buf]
    before = np.concatenate(([True], space[:-1]))
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    up, down = _powers(len(buf) + 1)
    cum = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up[: len(buf)], dtype=np.uint64)))
    h = mix((cum[ends] - cum[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return buf, starts, ends, np.searchsorted(offsets, starts, "right") - 1, h


def shingles_of(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct ``n``-word shingle hashes of each text; a text of fewer words is one shingle, an empty one none."""
    _, _, _, at, h = words_of(texts)
    bounds = np.searchsorted(at, np.arange(len(texts) + 1))
    coef = mix(np.arange(1, n + 1, dtype=np.uint64))
    out = []
    if len(h) >= n:
        acc = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            acc += h[k : len(h) - n + 1 + k] * coef[k]
        acc = mix(acc)
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= n:
            out.append(np.unique(acc[a : b - n + 1]))
        elif b > a:
            out.append(mix(np.array([(h[a:b] * coef[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# --- connected components ---------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    Returns (node, component) with the smallest node id of each component, for
    nodes that have an edge.  Both steps are aggregations with map-side
    combining and merge joins that adaptive execution can split, so a node with
    very many neighbours is no bottleneck and the driver holds no table for a
    broadcast; each round is a staged table.
    """
    e = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct()
    e, seen = stage(e), None
    for _ in range(most):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        new = stage(small)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_staged(e)
        e = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

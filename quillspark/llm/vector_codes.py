"""Vector code compression: product codes by Hamerly's Lloyd rounds (operator 13).

Components become integers ``floor(scale * x)``; vectors are cut into equal
consecutive parts, and each part position has a codebook that starts as that
part of the vectors with the smallest ids.  A round assigns every part to the
nearest entry and replaces each entry by the componentwise floor of its mean;
after the rounds parts are assigned once more.

Each part of each vector carries two bounds from round to round, written with
its code: no less than its distance to its own entry, and no more than that to
any other one.  When entries move, the first grows by the move of its own entry
and the second shrinks by the largest move among the others.  While the first
is strictly below the second, or below half the way from its entry to the next
one, the code stands; else the first is made exact, and only if it still is not
strictly below are all entries compared, in 64-bit integers, the lower index
winning ties.  Bounds are rounded outwards, so they never hide a tie.

Each round is one pass over a staged table, with no shuffle of vectors: tasks
return sums of each entry (parts x entries x (width + 1) numbers at most), which
Spark adds up.  Only codebooks (entries x dimension integers) reach the driver.
Rows meet the error of their label in a join, broadcast by Spark only while the
table of labels is below its threshold.

Defined cases: rows whose vector is null or holds null or non-finite components
are dropped, as are vectors of another length than that of the smallest id;
that length must be a multiple of ``parts`` and components must lie within
2**26 after scaling, else ValueError; an empty vector has codes of zeros;
rows that repeat an id are coded each, and as seeds stand in the order of their
vectors; null ids come last as seeds; fewer rows than ``entries`` give as many
entries; entries without parts stay; null labels form one group; other columns,
whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage

#: Scaled components beyond it could pass 64 bits when squared and summed.
LARGEST = 1 << 26
#: Rows worked on at a time: the distance table of a part has so many times ``entries`` integers.
ROWS = 4096


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(np.asarray(values, np.float64) * scale)
    if x.size and np.abs(x).max() >= LARGEST:
        raise ValueError(f"a component passes {LARGEST} after scaling by {scale}")
    return x.astype(np.int64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances over the last axis."""
    d = x - y
    return (d * d).sum(-1)


def half_gaps(book: np.ndarray) -> np.ndarray:
    """Half the distance from each entry to the nearest other one, rounded down."""
    if len(book) < 2:
        return np.full(len(book), np.inf)
    d = np.stack([squared(e, book) for e in book]).astype(np.float64)
    np.fill_diagonal(d, np.inf)
    return _down(np.sqrt(d.min(1)) / 2).astype(np.float64)


def moved(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each entry went, rounded up, and the largest way among the others."""
    way = _up(np.sqrt(squared(old, new).astype(np.float64))).astype(np.float64) * (old != new).any(-1)
    if len(way) < 2:
        return way, np.zeros(len(way))
    first = int(way.argmax())
    rest = np.full(len(way), way[first])
    rest[first] = np.delete(way, first).max()
    return way, rest


def assign_part(x: np.ndarray, book: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and bounds of one part against ``book``, and how many rows were compared with every entry."""
    code, upper, lower = code.copy(), upper.copy(), lower.copy()
    bar = np.maximum(lower, half_gaps(book)[code])
    open_ = np.flatnonzero(~(upper < bar))
    upper[open_] = _up(np.sqrt(squared(x[open_], book[code[open_]]).astype(np.float64)))
    open_ = open_[~(upper[open_] < bar[open_])]
    if len(open_):
        d = np.zeros((len(open_), len(book)), np.int64)
        for k in range(x.shape[1]):
            step = x[open_, k][:, None] - book[None, :, k]
            d += step * step
        best = d.argmin(1)  # the first of equal ones
        row = np.arange(len(open_))
        code[open_], upper[open_] = best, _up(np.sqrt(d[row, best].astype(np.float64)))
        d[row, best] = np.iinfo(np.int64).max
        lower[open_] = np.maximum(_down(np.sqrt(d.min(1).astype(np.float64))), 0) if len(book) > 1 else np.inf
    return code, upper, lower, len(open_)


def _vectors(column: pa.Array, scale: int, parts: int) -> np.ndarray:
    rows = len(column)
    flat = integers(column.flatten().to_numpy(zero_copy_only=False), scale)
    return flat.reshape(rows, parts, -1)


def _fixed(column: pa.Array, kind: type, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), parts)


def _assigner(books: np.ndarray, old: np.ndarray | None, scale: int, last: bool):
    """Arrow function: codes and bounds of each row, from those before where ``old`` codebooks are given; with ``last`` the error."""
    parts = books.shape[0]
    ways = [moved(o, n) for o, n in zip(old, books, strict=True)] if old is not None else None

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x = _vectors(b.column(2), scale, parts)
                if ways is None:
                    code = np.zeros((len(x), parts), np.uint16)
                    upper, lower = np.full(code.shape, np.inf, np.float32), np.full(code.shape, -np.inf, np.float32)
                else:
                    code, upper, lower = (_fixed(b.column(i), k, parts).copy() for i, k in ((3, np.uint16), (4, np.float32), (5, np.float32)))
                for p in range(parts):
                    if ways is not None:
                        way, rest = ways[p]
                        upper[:, p] = np.where(way[code[:, p]] > 0, _up(upper[:, p] + way[code[:, p]]), upper[:, p])
                        lower[:, p] = np.where(rest[code[:, p]] > 0, _down(lower[:, p] - rest[code[:, p]]), lower[:, p])
                    code[:, p], upper[:, p], lower[:, p], _ = assign_part(x[:, p], books[p], code[:, p], upper[:, p], lower[:, p])
                if last:
                    error = sum(squared(x[:, p], books[p][code[:, p]]) for p in range(parts))
                    text = [bytes(c).hex() for c in code.astype(np.uint8)]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text), pa.array(error)], names=["id", "label", "code", "error"])
                else:
                    rows = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), rows(code), rows(upper), rows(lower)], names=["id", "label", "emb", "code", "upper", "lower"])

    return run


def _sums(entries: int, parts: int, width: int, scale: int):
    """Arrow function: for each entry that a task met, the sums of its parts by position, and at position -1 their number."""

    def run(batches):
        total = np.zeros((parts, entries, width + 1), np.int64)
        for b in batches:
            x, code = _vectors(b.column(0), scale, parts), _fixed(b.column(1), np.uint16, parts)
            for p in range(parts):
                np.add.at(total[p, :, 0], code[:, p], 1)
                for k in range(width):
                    np.add.at(total[p, :, k + 1], code[:, p], x[:, p, k])
        p, e = np.nonzero(total[:, :, 0])
        at = np.tile(np.arange(-1, width), len(p))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(p, width + 1)), pa.array(np.repeat(e, width + 1)), pa.array(at), pa.array(total[p, e].ravel())], names=["part", "entry", "at", "total"])

    return run


def _means(state: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    parts, entries, width = books.shape
    rows = state.select("emb", "code").mapInArrow(_sums(entries, parts, width, scale), "part long, entry long, at long, total long")
    rows = rows.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # parts x entries x (width + 1) at most
    total = {(r["part"], r["entry"], r["at"]): int(r["total"]) for r in rows}
    new = books.copy()
    for (p, e, at), s in total.items():
        if at >= 0:
            new[p, e, at] = s // total[p, e, -1]
    return new


def vector_codes(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of every vector without null or non-finite components."""
    if not 0 < entries <= 256:
        raise ValueError("a code is two hex digits: at most 256 entries")
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.coalesce(F.col(vec_col).isNotNull() & finite, F.lit(False))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("emb"))
    first = rows.select("id", "emb").orderBy(F.col("id").asc_nulls_last(), "emb").limit(1).collect()
    dim = len(first[0]["emb"]) if first else 0
    if dim % parts:
        raise ValueError(f"vectors of {dim} components do not make {parts} equal parts")
    rows = rows.where(F.size("emb") == dim)
    seeds = rows.select("id", "emb").orderBy(F.col("id").asc_nulls_last(), "emb").limit(entries).collect()
    books = integers(np.array([r["emb"] for r in seeds], np.float64).reshape(len(seeds), dim), scale).reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2).copy()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    held = f"id {kinds['id']}, label {kinds['label']}, emb {kinds['emb']}, code binary, upper binary, lower binary"
    old, state = None, None
    for _ in range(rounds if seeds else 0):
        now = stage((rows if state is None else state).mapInArrow(_assigner(books, old, scale, False), held))
        if state is not None:
            drop_staged(state)
        state, old = now, books
        books = _means(state, books, scale)
    coded = (rows if state is None else state).mapInArrow(_assigner(books, old, scale, True), f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    coded = stage(coded)
    if state is not None:
        drop_staged(state)
    sums = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "of_label")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

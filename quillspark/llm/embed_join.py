"""Embedding near-duplicates by a subspace pigeonhole join (operator 10).

Unit vectors are rotated by a fixed orthogonal matrix and split into blocks.
If two vectors are within squared distance ``tau``, at least one block is
within its share of ``tau``, so each block is range-joined under its share:
a grid on its two leading coordinates, each vector in its own cell and in the
next one where it is within reach of the border.  A pair is counted in the
first block that finds it, and its cosine is computed in double precision.

A grid pays only where vectors spread further than its cells.  The cells of
each label are counted first; where the grids of all blocks would compare more
pairs than the label has, as with vectors that point everywhere alike, the
whole label is the only cell, each pair meets once, and its blocks are tested
one after another.  Both ways find the same pairs.

Cells above ``tile_rows`` vectors are cut into tiles that meet pairwise; cells
are dealt out as ids, and the vectors join them once.  Tiles return counts and
spanning links, never pairs; equal vectors with equal labels are one class that
carries its size.  Tables that grow with the vectors are joined by merges, so
the driver holds none of them for a broadcast; those of labels may be broadcast.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components, and null labels, link with nothing and are their own component;
vectors of different lengths do not link; rows that repeat an id count as
vectors each; equal vectors are ties and link; other columns, whatever their
names, are ignored; an empty table gives an empty result.  Ids are integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stage
from .ngram_join import _groups

_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    """A fixed orthogonal matrix, the same in every process."""
    if dim not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
        _ROTATIONS[dim] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim]


def block_cuts(dim: int, width: int = 16) -> list[int]:
    n = max(1, round(dim / width))
    return [dim * i // n for i in range(n + 1)]


def budget(dim: int, cuts: list[int], block: int, tau: float) -> float:
    return tau * (cuts[block + 1] - cuts[block]) / dim


def _spread(tau: float):
    """Arrow function over (label, rep, emb): a row for each block and cell that a vector is compared in."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                lists = part.column(2)
                lens = np.diff(np.asarray(lists.offsets))
                label, rep = part.column(0).to_numpy(), part.column(1).to_numpy()
                for dim in np.unique(lens):
                    rows = np.flatnonzero(lens == dim)
                    x = np.stack([np.asarray(lists[i].values, float) for i in rows.tolist()])
                    z = x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation(int(dim))
                    cuts = block_cuts(int(dim))
                    for block in range(len(cuts) - 1):
                        reach = math.sqrt(budget(dim, cuts, block, tau)) + 1e-7
                        side = z[:, cuts[block] : cuts[block + 1]][:, :2]
                        home = np.floor(side / (2 * reach)).astype(np.int64)
                        near = (home + 1) * 2 * reach - side <= reach
                        if side.shape[1] < 2:
                            home, near = np.pad(home, ((0, 0), (0, 1))), np.pad(near, ((0, 0), (0, 1)))
                        for d1, d2 in ((0, 0), (0, 1), (1, 0), (1, 1)):
                            on = (near[:, 0] | (d1 == 0)) & (near[:, 1] | (d2 == 0))
                            cols = [label[rows[on]], np.full(on.sum(), dim), np.full(on.sum(), block), home[on, 0] + d1, home[on, 1] + d2, home[on, 0], home[on, 1], rep[rows[on]]]
                            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["label", "dim", "block", "c1", "c2", "h1", "h2", "rep"])

    return run


def compare_tile(emb: np.ndarray, reps: np.ndarray, n: np.ndarray, home: np.ndarray, cell: tuple[int, int], block: int, ask: np.ndarray, answer: np.ndarray, same: bool, threshold: float, tau: float):
    """Linked counts of every row of a tile, and the smallest rep of its local component."""
    rows, dim = emb.shape
    u = emb / np.linalg.norm(emb, axis=1, keepdims=True)
    z = u @ rotation(dim)
    cuts = block_cuts(dim)
    count, label = np.zeros(rows, np.int64), np.arange(rows)
    for a in range(0, len(ask), 256):
        i, j = ask[a : a + 256], answer
        inside = lambda k, i, j: _within(z[i, cuts[k] : cuts[k + 1]], z[j, cuts[k] : cuts[k + 1]], budget(dim, cuts, k, tau) + 1e-9)
        ok = (reps[i][:, None] < reps[j][None]) if same else np.ones((len(i), len(j)), bool)
        if block < 0:  # the only cell: any block may find the pair
            found = inside(0, i, j)
            for k in range(1, len(cuts) - 1):
                found |= inside(k, i, j)
            ok &= found
        else:  # in reach in this block, and in no earlier one; in the cell that both share first
            ok &= inside(block, i, j) & (np.maximum(home[i, None, 0], home[None, j, 0]) == cell[0]) & (np.maximum(home[i, None, 1], home[None, j, 1]) == cell[1])
            keep_i, keep_j = ok.any(1), ok.any(0)
            i, j, ok = i[keep_i], j[keep_j], ok[np.ix_(keep_i, keep_j)]
            for k in range(block if ok.size else 0):
                ok &= ~inside(k, i, j)
        if not ok.size:
            continue
        ok &= u[i] @ u[j].T >= threshold
        count[i] += ok @ n[j]
        count[j] += ok.T @ n[i]
        for r in np.flatnonzero(ok.any(1)):
            met = np.unique(label[np.append(j[ok[r]], i[r])])
            if len(met) > 1:
                label[np.isin(label, met[1:])] = met[0]
    low = np.full(rows, np.iinfo(np.int64).max)
    np.minimum.at(low, label, reps)
    return count, low[label]


def _within(x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T <= most


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, tile_rows: int = 4096) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every vector; only vectors with equal labels are compared."""
    tau = 2 - 2 * threshold + 1e-9
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    valid = F.col(vec_col).isNotNull() & F.col(label_col).isNotNull() & finite & F.exists(vec_col, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.when(F.coalesce(valid, F.lit(False)), F.col(vec_col)).alias("emb"))
    good = rows.where("emb is not null and id is not null")
    classes = stage(good.groupBy("label", "emb").agg(F.min("id").alias("rep"), F.count("*").alias("n")).select("rep", "label", "n", "emb"))
    codes = classes.groupBy("label").agg(F.min("rep").alias("code"))  # a number for each label
    coded = stage(classes.join(codes, "label").select(F.col("code").alias("label"), "rep", "n", "emb"))
    cells = stage(coded.select("label", "rep", "emb").mapInArrow(_spread(tau), "label long, dim long, block long, c1 long, c2 long, h1 long, h2 long, rep long"))
    key = ["label", "dim", "block", "c1", "c2"]
    homes = F.count(F.when((F.col("block") == 0) & (F.col("c1") == F.col("h1")) & (F.col("c2") == F.col("h2")), 1))
    costs = cells.groupBy(*key).agg(F.count("*").cast("double").alias("k"), homes.alias("m")).groupBy("label", "dim").agg((F.sum(F.col("k") * F.col("k")) < F.sum("m") * F.sum("m").cast("double")).alias("grid"))
    cells = cells.join(costs, ["label", "dim"])
    alone = cells.where("not grid and block = 0 and c1 = h1 and c2 = h2").select("label", "dim", F.lit(-1).cast("long").alias("block"), *(F.lit(0).cast("long").alias(c) for c in ("c1", "c2", "h1", "h2")), "rep")
    cells = stage(cells.where("grid").drop("grid").select(*alone.columns).union(alone))
    sizes = cells.groupBy(*key).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"), F.count("*").alias("k")).where("k > 1")
    own = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("long")
    tiles = cells.join(sizes.drop("k").hint("merge"), key).select(*cells.columns, own.alias("own"), "tiles")
    tiles = tiles.join(coded.select("rep", "n", "emb").hint("merge"), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = tiles.withColumn("ta", F.least("own", F.col("other").cast("long"))).withColumn("tb", F.greatest("own", F.col("other").cast("long")))
    key += ["ta", "tb"]

    def run(batches):
        for at, cols in _groups(batches, 7):
            reps, n, own, h1, h2 = (np.asarray(c) for c in cols[7:12])
            if len(reps) > 1:
                emb = np.concatenate([np.asarray(c.flatten(), float) for c in cols[12].chunks]).reshape(len(reps), -1)
                every = np.arange(len(reps))
                same = at[5] == at[6]
                ask, answer = (every, every) if same else (np.flatnonzero(own == at[5]), np.flatnonzero(own == at[6]))
                count, low = compare_tile(emb, reps, n, np.column_stack((h1, h2)), (at[3], at[4]), at[2], ask, answer, same, threshold, tau)
                on = count > 0
                yield pa.RecordBatch.from_arrays([pa.array(reps[on]), pa.array(count[on]), pa.array(low[on])], names=["a", "links", "b"])

    found = tiles.select(*key, "rep", "n", "own", "h1", "h2", "emb").repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, links long, b long")
    found = stage(found)
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    named = classes.join(links.hint("merge"), F.col("rep") == F.col("a"), "left").join(components(found).hint("merge"), F.col("rep") == F.col("node"), "left")
    named = named.select("label", "emb", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(named.hint("merge"), ["label", "emb"], "left").select(F.col("id").alias(id_col), F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))

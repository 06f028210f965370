"""Suffix-array dedup of byte strings (operator 7).

Every byte covered by a ``length``-byte string that starts earlier in the
corpus is removed.  The suffixes to sort are chosen by winnowing: among the
``length - k + 1`` consecutive k-grams of any window the one with the least
hash is an anchor, so equal windows hold the same anchor at the same offset.
Only suffixes at anchors that occur twice are kept, with the bytes that a
window around them can reach.

Tasks build the suffix array of their anchors by deep-shallow sorting:
multikey quicksort on eight-byte words to a shallow depth, then a blind trie
for every group whose common prefix is longer.  The LCP array gives, for each
window offset, the classes of equal right parts; within a class, equal left
parts are equal windows, and all but the earliest are copies.

Scale: exact copies of a text collapse first; anchors of one hash that are
very frequent are dealt out by offset bands, keyed by the bytes that all
windows of a band share, so that no task gets all of them; copies inside a
band collapse while they stream by.

Defined cases: a null text is an empty one; texts shorter than ``length``
bytes lose nothing; matches never cross texts; overlapping matches count; rows
that repeat an id and a text are the same document to the order, so neither is
earlier; rows that repeat an id with other texts are documents of their own,
ordered by a hash of the text; rows with a null id lose nothing; other columns
of the input, whatever their names, are ignored; an empty table gives an empty
result.  Ids are integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _powers, drop_staged, mix, numbered, slices, stage

K = 24  #: bytes of an anchor
SHALLOW = 40  #: depth of the multikey quicksort
HOT, VERY_HOT = 16_384, 1_000_000  #: anchors of one hash from which bands of 8, or of 1, offsets are dealt out
GATHER = 24_576  #: rows that a task sorts at once
SALTS = 64  #: keys over which an anchor that is frequent in a slice is dealt out
REMEMBER = 60_000  #: surroundings that a task remembers while it cuts them out


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, position) of the winnowed k-grams of texts of at least ``length`` bytes."""
    lens = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    n, w = len(buf) - K + 1, length - K + 1
    if n < w:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = _powers(len(buf) + 1)
    cum = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up[: len(buf)], dtype=np.uint64)))
    h = mix((cum[K:] - cum[:n]) * down[:n])
    starts = np.cumsum(np.concatenate(([0], lens[:-1] + 1)))
    none = np.iinfo(np.uint64).max
    for s, size in zip(starts.tolist(), lens.tolist(), strict=True):  # k-grams that leave their text
        h[max(0, s + size - K + 1) : s + size + 1] = none
    low = _sliding(h, w, np.minimum)
    high = _sliding(np.concatenate((np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64))), w, np.maximum)
    at = np.flatnonzero((high[: len(h)] == h) & (h != none))
    of = np.searchsorted(starts, at, "right") - 1
    keep = lens[of] >= length
    at, of = at[keep], of[keep]
    return h[at], of, at - starts[of]


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """``op`` over all windows of ``w`` values, by doubling."""
    out, span = x, 1
    while 2 * span <= w:
        out = op(out[:-span], out[span:])
        span *= 2
    return op(out[: len(x) - w + 1], out[w - span : w - span + len(x) - w + 1]) if span < w else out


# --- deep-shallow sorting ---------------------------------------------------


def shallow_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort on big-endian words: the order, and where groups begin that agree on all words.

    Each round sorts the groups that are still equal by their next word; groups
    that split down to one row take no further part.
    """
    n = len(words)
    order, group = np.arange(n), np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    for d in range(words.shape[1]):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        key = words[order[at], d]
        perm = np.lexsort((key, group[at]))
        order[at] = order[at][perm]
        key, g = key[perm], group[at]
        cut = np.concatenate(([True], (key[1:] != key[:-1]) | (g[1:] != g[:-1])))
        heads = at[cut]
        group[at] = heads[np.cumsum(cut) - 1]
        size = np.diff(np.append(np.flatnonzero(cut), len(at)))
        open_[at] = np.repeat(size > 1, size)
    return order, np.unique(group)


def blind_trie(rows: list[int], keys: list[bytes]) -> list[int]:
    """The rows in the order of their keys, by a trie that holds branching depths and bytes only."""
    root: list | int = rows[0]
    for r in rows[1:]:
        key, node = keys[r], root
        while isinstance(node, list):  # blind descent to some leaf
            kids = node[1]
            b = key[node[0]] if node[0] < len(key) else -1
            node = kids[b] if b in kids else next(iter(kids.values()))
        leaf = node
        while isinstance(leaf, tuple):
            leaf = leaf[0]
        other = keys[leaf]
        m = min(len(key), len(other))
        if key[:m] == other[:m]:
            lcp = m
        else:
            diff = int.from_bytes(key[:m], "big") ^ int.from_bytes(other[:m], "big")
            lcp = m - (diff.bit_length() + 7) // 8
        mine, theirs = (x[lcp] if lcp < len(x) else -1 for x in (key, other))
        parent, edge, node = None, None, root
        while isinstance(node, list) and (node[0] < lcp or (node[0] == lcp and mine == theirs)):
            parent, edge = node, key[node[0]] if node[0] < len(key) else -1
            node = node[1][edge]
        if mine == theirs:  # equal keys share a leaf
            new = node + (r,) if isinstance(node, tuple) else (node, r)
        elif isinstance(node, list) and node[0] == lcp:
            node[1][mine] = r
            continue
        else:
            new = [lcp, {theirs: node, mine: r}]
        if parent is None:
            root = new
        else:
            parent[1][edge] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        elif isinstance(node, tuple):
            out += node
        else:
            out.append(node)
    return out


def suffix_array(matrix: np.ndarray, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of zero-padded rows by deep-shallow sorting, and the LCP of neighbours."""
    order, heads = shallow_sort(matrix[:, :SHALLOW].copy().view(">u8"))
    ends = np.append(heads[1:], len(order))
    for a, b in zip(heads[ends - heads > 1].tolist(), ends[ends - heads > 1].tolist(), strict=True):
        order[a:b] = blind_trie(order[a:b].tolist(), keys)
    sorted_ = matrix[order]
    differ = sorted_[1:] != sorted_[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), matrix.shape[1])
    return order, lcp


def copied_windows(left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Flags (row, offset): the window that starts ``offset`` before the anchor equals that of an earlier row.

    Rows come in corpus order; offsets of a row run from ``low`` to ``high``.
    """
    n, reach = len(right), length - K
    width = (length + 7) // 8 * 8
    matrix = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in right), np.uint8).reshape(n, width)
    wide = (reach + 8) // 8 * 8
    before = np.frombuffer(b"".join(x[::-1].ljust(wide, b"\0") for x in left), np.uint8).reshape(n, wide)
    n_left, n_right = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    order, lcp = suffix_array(matrix, right)
    back, _ = shallow_sort(before.view(">u8"))
    differ = before[back][1:] != before[back][:-1]
    back_lcp = np.where(differ.any(1), differ.argmax(1), wide)
    flags = np.zeros((n, reach + 1), bool)
    left_class = np.zeros(n, np.int64)
    for o in range(reach + 1):
        need = length - o
        left_class[back] = np.concatenate(([0], np.cumsum(back_lcp < o)))
        right_class = np.concatenate(([0], np.cumsum(lcp < need)))
        ok = (n_right >= need) & (n_left >= o) & (low <= o) & (o <= high)
        ok = ok[order]
        shared = np.zeros(n, bool)
        shared[1:] |= lcp >= need
        shared[:-1] |= lcp >= need
        rows = order[shared & ok]
        if len(rows) < 2:
            continue
        key = right_class[shared & ok] * n + left_class[rows]
        by = np.lexsort((rows, key))
        same = np.concatenate(([False], key[by][1:] == key[by][:-1]))
        flags[rows[by[same]], o] = True
    return flags


# --- the distributed part ---------------------------------------------------


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (h, salt, ...) whose h another row has too: one shuffle and a streaming pass over sorted rows; those with a salt are known to be shared."""

    def run(batches):
        tail, last, out = None, None, False
        for b in batches:
            if not b.num_rows:
                continue
            h, salt = np.asarray(b.column(0)), np.asarray(b.column(1))
            back = np.concatenate(([(h[0], salt[0]) == last], (h[1:] == h[:-1]) & (salt[1:] == salt[:-1])))
            keep = back | (salt > 0)
            keep[:-1] |= back[1:]
            if back[0] and not out:
                yield tail
            yield b.filter(pa.array(keep))
            tail, last, out = b.slice(b.num_rows - 1, 1), (h[-1], salt[-1]), bool(keep[-1])

    return rows.select("h", "salt", "id", "at").repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(run, "h long, salt int, id long, at int")


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(h, salt, id, at) of all anchors; a hash that is frequent in a slice is dealt out over salts, and a row without id tells the others."""

    def run(batches):
        for b in batches:
            for start, texts in slices(b):
                h, of, at = anchors(texts, length)
                ids = np.asarray(b.column(0).slice(start, len(texts)))[of]
                uniq, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
                hot = counts >= max(16, len(texts) / 16)
                salt = np.where(hot[inverse], 1 + (mix(ids.view(np.uint64) + at.astype(np.uint64)) % np.uint64(SALTS)).astype(np.int64), 0)
                told = np.zeros(int(hot.sum()), np.int64)
                null = np.arange(len(h) + len(told)) >= len(h)
                cols = [np.concatenate(x) for x in ((h.view(np.int64), uniq[hot].view(np.int64)), (salt, told), (ids, told), (at, told))]
                out = pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64(), mask=null), pa.array(cols[3], pa.int32(), mask=null)], names=["h", "salt", "id", "at"])
                for a in range(0, max(out.num_rows, 1), 50_000):
                    yield out.slice(a, 50_000)

    return docs.mapInArrow(run, "h long, salt int, id long, at int")


def _contexts(docs: DataFrame, length: int, remember: int) -> DataFrame:
    """(id, text, at array<struct<at, h, band>>) to (key, id, at, low, high, left, right): what windows around anchors reach.

    An anchor whose surroundings came by earlier in the task, in a document
    that is earlier too, is a copy for certain: it becomes a span at once, a
    row without ``left`` whose low and high are the bytes to remove.  So texts
    that repeat within themselves and frequent passages shrink before they are
    dealt out.  What a task remembers is bounded; forgetting changes no result.
    """
    reach = length - K

    def run(batches):
        known: dict[tuple, tuple[int, int]] = {}
        for b in batches:
            out: list[tuple] = []
            for key, text, where in zip(b.column(0), b.column(1), b.column(2), strict=True):
                key, text = key.as_py(), (text.as_py() or "").encode()
                spans: list[list[int]] = []
                for x in sorted(where.as_py(), key=lambda x: x["at"]):
                    at, h, band = x["at"], x["h"], x["band"]
                    for low in range(0, reach + 1, band):
                        high = min(reach, low + band - 1)
                        if at < low or at + length - high > len(text):
                            continue  # not one window of the band fits
                        left, right = text[max(0, at - high) : at], text[at : at + length - low]
                        first = known.get((low, left, right))
                        if first is not None and first < (key, at):
                            a, z = at - min(high, len(left)), at - max(low, length - len(right)) + length
                            if spans and a <= spans[-1][1] and a >= spans[-1][0]:
                                spans[-1][1] = max(spans[-1][1], z)
                            else:
                                spans.append([a, z])
                            continue
                        if len(known) >= remember:
                            known.clear()
                        known[low, left, right] = (key, at)
                        name = h if band > reach else _name(h, low, text[at - low : at + length - high])
                        out.append((name, key, at, low, high, left, right))
                out += [(_name(0, 0, key.to_bytes(8, "little", signed=True)), key, -1, a, z, None, None) for a, z in spans]
                if len(out) > 5000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    return docs.mapInArrow(run, "key long, id long, at int, low int, high int, left binary, right binary")


def _name(h: int, low: int, common: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(common, digest_size=8, salt=h.to_bytes(8, "little", signed=True), person=low.to_bytes(2, "little")).digest(), "little", signed=True)


def _rows(out):
    cols = list(zip(*out, strict=True)) or [[]] * 7
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "id", "at", "low", "high", "left", "right"])


def _copied_spans(length: int, gather: int):
    """Arrow function over rows sorted by (key, id, at): spans (id, first, last) of bytes to remove."""

    def spans(rows):
        if len(rows) < 2:
            return
        key, ids, at, low, high, left, right = zip(*rows, strict=True)
        flags = copied_windows(left, right, np.array(low), np.array(high), length)
        edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        r, o0 = np.nonzero(edge == 1)
        _, o1 = np.nonzero(edge == -1)
        at, ids = np.array(at), np.array(ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids[r], pa.int64()), pa.array((at[r] - o1 + 1).astype(np.int32)), pa.array((at[r] - o0 + length).astype(np.int32))], names=["id", "first", "last"])

    def run(batches):
        held, group, seen, now = [], [], {}, None
        for b in batches:
            copies = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[5] is None:  # a span that is known already
                    copies.append((row[1], row[3], row[4]))
                    continue
                if row[0] != now:
                    if len(group) > 1:
                        held += group
                    group, seen, now = [], {}, row[0]
                    if len(held) >= gather:
                        yield from spans(held)
                        held = []
                what = (row[3], row[5], row[6])
                if what in seen:  # the same bytes came by: all windows are copies
                    first = seen[what]
                    low, high = max(row[3], length - len(row[6])), min(row[4], len(row[5]))
                    if low <= high and first != row[1:3]:
                        copies.append((row[1], row[2] - high, row[2] - low + length))
                else:
                    seen[what] = row[1:3]
                    group.append(row)
            cols = list(zip(*copies, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["id", "first", "last"])
        if len(group) > 1:
            held += group
        yield from spans(held)

    return run


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, hot: tuple[int, int] = (HOT, VERY_HOT), gather: int = GATHER, remember: int = REMEMBER) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept binary, kept_sha256) of every row.

    ``hot``, ``gather`` and ``remember`` bound what a task gets and holds; the
    result is the same whatever they are.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows, names = numbered(rows)
    ids = rows.where("id is not null")
    hashed = rows.select("id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size"))
    known = stage(hashed)
    reps = stage(known.where(f"id is not null and size >= {length}").groupBy("sha").agg(F.min("id").alias("rep")))
    first = stage(_shared(_anchor_rows(ids, length)), sweep=True)
    seen = first.distinct()
    live = seen.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select("h", "salt", "id", "at").union(seen.where("id is null"))
    live = stage(_shared(live).where("id is not null").drop("salt"), sweep=True)
    drop_staged(first)
    # only frequent anchors have narrow bands; their rows meet the band in as many tasks as there are salts
    often = live.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > hot[0])
    often = often.select("h", F.when(F.col("k") > hot[1], 1).otherwise(8).alias("narrow"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("share"))
    shared = live.withColumn("share", F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).cast("int")).join(often, ["h", "share"], "left")
    where = shared.withColumn("band", F.coalesce("narrow", F.lit(length))).groupBy("id").agg(F.collect_list(F.struct("at", "h", "band")).alias("where"))
    texts = ids.join(where.hint("merge"), "id")  # texts move the same way at every size
    texts = texts.select("id", "text", "where")
    reach = _contexts(texts, length, remember).repartition("key").sortWithinPartitions("key", "id", "at")
    spans = reach.mapInArrow(_copied_spans(length, gather), "id long, first int, last int")
    spans = stage(spans.groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("spans")))
    copies = known.join(reps, "sha").where("id > rep").select("id").distinct().select("id", F.lit(True).alias("copy"))
    marks = spans.join(copies, "id", "full")
    joined = rows.join(marks.hint("merge"), "id", "left").select("id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))

    def run(batches):
        for b in batches:
            out = []
            for text, cuts, copy in zip(b.column(1), b.column(2), b.column(3), strict=True):
                text = (text.as_py() or "").encode()
                if copy.as_py() and len(text) >= length:
                    out.append((len(text), len(text), 1, b""))
                elif not cuts.is_valid:
                    out.append((len(text), 0, 0, text))
                else:
                    merged: list[list[int]] = []
                    for a, z in sorted((c["first"], c["last"]) for c in cuts.as_py()):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], z)
                        else:
                            merged.append([a, z])
                    edges = [0, *(x for m in merged for x in m), len(text)]
                    kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                    out.append((len(text), len(text) - len(kept), len(merged), kept))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in out], pa.int64()) for i in range(3)), pa.array([x[3] for x in out], pa.binary()), pa.array([hashlib.sha256(x[3]).hexdigest() for x in out], pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    out = joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    if names is not None:
        out = out.join(names.hint("merge"), F.col("id") == F.col("node"), "left").withColumn("id", F.col("doc")).drop("node", "doc")
    return out.withColumnRenamed("id", id_col)

"""Phrase collocation mining by word suffix arrays (operator 11).

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?]`` and line ends and
those into words at blanks and tabs.  Each task works through its texts in
shards of ``SHARD_BYTES``: words get numbers, numpy prefix doubling sorts the
suffixes of the number sequence by group, and the intervals of equal common
prefixes of neighbouring suffixes are the phrases of each length with their
counts.  Spark adds the counts of all shards up by (group, phrase), with
map-side combining, so a phrase of any number of copies costs a row for each
task.

Most phrases are rare, and rare ones must not be shuffled as texts.  So a first
pass counts hashes: a shard sends each bucket the sorted 24-bit keys of its
phrases with their counts, a bucket (one for every ``BUCKET_BYTES`` of text)
adds them up, and keys of ``least`` occurrences or more set a bit in a table of
``CELLS`` bits, 8 MB whatever the input.  Keys that clash only add up to more, so
no frequent phrase is lost; a clash or a full table lets rare phrases through,
which the exact counts drop.  Two neighbours whose pair has no bit can stand in
no candidate, so the second pass cuts its pieces there before it sorts.

Only phrases of ``least`` occurrences or more stay; every part of such a phrase
has as many, so one join of candidates with their parts gives all numbers that
a score needs, and the same rows tell which shorter phrases a longer one stands
for.  Scores are exact: counts are multiplied as decimals of 38 digits, which
holds for counts up to 10**15.  The best ``top`` of a group are first taken
within 64 shares by a hash of the phrase, so no task sees more than 64 * ``top``.

Defined cases: null texts are empty; null groups are ``und``, together with
rows that say so; texts without words count nothing; a text above a shard is cut at
a piece border, so long texts are read whole and only a piece without any
border is held whole; repeated rows and ids count each time; ties in the score
fall to the higher count, then to the phrase in byte order; other columns,
whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BYTE, _powers, mix, stage

#: Text of a shard and of a bucket, rows that a bucket gathers before it adds equal ones up, bits of the table of frequent hashes, and its parts.
SHARD_BYTES, BUCKET_BYTES, MERGE_ROWS, CELLS, SLOTS = 4 << 20, 4 << 20, 1 << 21, 1 << 26, 1 << 16
BORDERS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(string.ascii_uppercase.encode() + b"\t" + BORDERS, string.ascii_lowercase.encode() + b" " + b"\n" * len(BORDERS))


def suffix_order(rank: np.ndarray, room: np.ndarray, words: int) -> np.ndarray:
    """Positions in the order of their next ``words`` or more ranks, those of one piece only; ranks are above 0.

    Each step sorts by twice as many words as the one before; what lies behind
    a piece's end counts as 0.
    """
    n, known = len(rank), 1
    rank = np.unique(rank, return_inverse=True)[1] + 1
    order = np.argsort(rank, kind="stable")
    while known < words:
        ahead = np.zeros(n, np.int64)
        ahead[: n - known] = rank[known:]
        ahead[room <= known] = 0
        key = rank * np.int64(n + 1) + ahead
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        known *= 2
    return order


def common_prefixes(order: np.ndarray, rank: np.ndarray, room: np.ndarray, words: int) -> np.ndarray:
    """How many words each suffix shares with the one before it in ``order``, up to ``words``; the first shares none."""
    shared = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    most = np.minimum(room[a], room[b])
    equal = np.ones(len(a), bool)
    for k in range(words):
        equal &= most > k
        on = np.flatnonzero(equal)
        equal[on] = rank[a[on] + k] == rank[b[on] + k]
        shared[1:] += equal
    return shared


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each of some words, by its bytes."""
    at = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[: at[-1]]
    up, down = _powers(len(data) + 1)
    cum = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    return mix((cum[at[1:]] - cum[at[:-1]]) * down[at[:-1]] + np.diff(at).astype(np.uint64))


@dataclass
class Sequence:
    """The words of a shard in order: their numbers, distinct words, groups, words left in the piece, and hashes salted by group."""

    ids: np.ndarray
    words: pa.Array
    of: np.ndarray
    room: np.ndarray
    hash: np.ndarray

    def codes(self, size: int) -> np.ndarray:
        """Hashes of the phrases of ``size`` words that begin at each word; meaningless where room is less."""
        n = max(0, len(self.hash) - size + 1)
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = mix(out + self.hash[k : n + k])
        return np.concatenate((out, np.zeros(len(self.hash) - n, np.uint64)))


def sequence_of(texts: list[bytes], groups: np.ndarray, salts: np.ndarray) -> Sequence:
    """Words of texts; ``groups`` holds a group number for each text, ``salts`` a hash for each group."""
    buf = np.frombuffer((b"\n".join(texts) + b"\n").translate(_FOLD), np.uint8)
    cut = buf == 10
    gap = cut | (buf == 32)
    before = np.concatenate(([True], gap[:-1]))
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = buf[~gap]
    named = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    ids = named.indices.to_numpy().astype(np.int64)
    text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    of = groups[np.searchsorted(text_at, starts, "right") - 1]
    return Sequence(ids, named.dictionary, of, rooms(np.cumsum(cut)[starts]), hashes(named.dictionary)[ids] + salts[of])


def rooms(piece: np.ndarray) -> np.ndarray:
    """How many words, itself included, each word has left in its piece; ``piece`` numbers the pieces."""
    last = np.flatnonzero(np.concatenate((piece[1:] != piece[:-1], [True])) if len(piece) else piece)
    return np.repeat(last, np.diff(last, prepend=-1)) + 1 - np.arange(len(piece))


def phrases_of(s: Sequence, words: int, often=None):
    """Yield (groups, length, phrases, counts) for every length from 1 to ``words``.

    ``often`` tells of hashes whether their phrases may be frequent; what cannot be is left out.
    """
    if not len(s.ids):
        return
    keep = (lambda size: np.ones(len(s.ids), bool)) if often is None else (lambda size: often(s.codes(size)) & (s.room >= size))
    rank = s.of * len(s.words) + s.ids + 1
    at, n = np.unique(np.where(keep(1), rank, 0), return_index=True, return_counts=True)[1:]
    on = keep(1)[at]
    yield s.of[at[on]], 1, s.words.take(pa.array(s.ids[at[on]])), n[on]
    # a phrase stands within a run of words of which every two neighbours may be frequent
    bound = ~keep(2) | (s.room < 2)  # no phrase goes on after this word
    run = np.cumsum(np.concatenate(([False], bound[:-1])))
    room = rooms(run)
    used = np.flatnonzero((room > 1) | (np.concatenate(([0], room[:-1])) > 1))
    if not len(used):
        return
    room = room[used]
    order = suffix_order(rank[used], room, words)
    shared = common_prefixes(order, rank[used], room, words)
    for size in range(2, words + 1):
        able = room[order] >= size
        at = order[able]
        opens = np.flatnonzero(shared[able] < size)  # each interval of common prefixes is one phrase
        counts = np.diff(opens, append=len(at))
        at = used[at[opens]]
        on = keep(size)[at]
        at = at[on]
        if len(at):
            parts = [s.words.take(pa.array(s.ids[at + k])) for k in range(size)]
            yield s.of[at], size, pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())), counts[on]


def _slots(buckets: int) -> tuple[int, int]:
    """Parts of the table of bits, and bits in each; a bucket's phrases are all in one."""
    slots = min(buckets, SLOTS)
    return slots, CELLS // slots


def _cells(places: np.ndarray, buckets: int) -> np.ndarray:
    """Bits of the table that (bucket, key) pairs, as one number each, belong to."""
    slots, span = _slots(buckets)
    return ((places >> np.uint64(32)) % np.uint64(slots) * np.uint64(span) + mix(places) % np.uint64(span)).astype(np.int64)


def _places(codes: np.ndarray, buckets: int) -> np.ndarray:
    """A hash as its bucket, above 32 bits that hold a key of 24."""
    return ((codes & np.uint64(0xFFFFFFFF)) % np.uint64(buckets) << np.uint64(32)) | (codes >> np.uint64(40))


def _in_shards(batches):
    """(texts, groups, names) of the shards of batches of (group, text); long texts are cut at piece borders."""
    texts, groups, names, size = [], [], {}, 0
    for b in batches:
        for g, t in zip(b.column(0), b.column(1).cast(pa.large_binary()), strict=True):
            g = names.setdefault(g.as_py(), len(names))
            for piece in _cuts(t.as_py() or b""):
                texts.append(piece)
                groups.append(g)
                size += len(piece) + 1
                if size >= SHARD_BYTES:
                    yield texts, groups, list(names)
                    texts, groups, size = [], [], 0
    if texts:
        yield texts, groups, list(names)


def _cuts(text: bytes):
    a = 0
    while len(text) - a > SHARD_BYTES:
        b = max(text.rfind(bytes((c,)), a, a + SHARD_BYTES) for c in BORDERS)
        if b < 0:
            b = min((x for c in BORDERS if (x := text.find(bytes((c,)), a)) >= 0), default=len(text) - 1)
        yield text[a : b + 1]
        a = b + 1
    yield text[a:] if a else text


def _sequences(batches):
    for texts, groups, names in _in_shards(batches):
        salts = mix(np.array([zlib.crc32(g.encode()) for g in names], np.uint64))
        yield sequence_of(texts, np.array(groups, np.int64), salts), names


def _hashed(words: int, buckets: int):
    """Arrow function over (group, text): (bucket, keys) of each shard, the keys sorted, with their counts behind them."""

    def run(batches):
        for s, _ in _sequences(batches):
            places, counts = np.unique(np.concatenate([_places(s.codes(k)[s.room >= k], buckets) for k in range(1, words + 1)]), return_counts=True)
            bucket = (places >> np.uint64(32)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, np.int64)
            keys = places.astype(np.uint32)
            steps = np.diff(keys, prepend=np.uint32(0))
            steps[edges[:-1]] = keys[edges[:-1]]  # a bucket's first key stands for itself
            for a in range(0, len(edges) - 1, 1024):
                part = edges[a : a + 1025]
                blobs = [pa.compress(planes(steps[x:y]) + planes(counts[x:y]), "zstd", asbytes=True) for x, y in zip(part[:-1], part[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[part[:-1]]), pa.array(np.diff(part)), pa.array(blobs, pa.binary())], names=["bucket", "rows", "keys"])

    return run


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers as four rows of bytes, which pack better than numbers in turn."""
    return np.ascontiguousarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view(np.uint32).ravel()


def _frequent(least: int, buckets: int):
    """Arrow function over (bucket, rows, keys) in the order of slots and buckets: the bits of each slot, set for keys of ``least`` or more."""

    def summed(keys, counts):
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) > 0)))
        return [keys[order][first]], [np.add.reduceat(counts[order], first)]

    slots, span = _slots(buckets)

    def mark(bits, bucket, keys, counts):
        (keys,), (counts,) = summed(keys, counts)
        bits[_cells((np.uint64(bucket) << np.uint64(32)) | keys[counts >= least].astype(np.uint64), buckets) % span] = True

    def row(slot, bits):
        return pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["slot", "bits"])

    def run(batches):
        at, slot, bits, keys, counts, rows = None, None, None, [], [], 0
        for b in batches:
            for bucket, n, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != at:
                    if keys:
                        mark(bits, at, keys, counts)
                    if bucket % slots != slot:
                        if slot is not None:
                            yield row(slot, bits)
                        slot, bits = bucket % slots, np.zeros(span, bool)
                    at, keys, counts, rows = bucket, [], [], 0
                raw = pa.decompress(blob, 8 * n, "zstd", asbytes=True)
                keys.append(np.cumsum(from_planes(raw[: 4 * n], n), dtype=np.uint32))
                counts.append(from_planes(raw[4 * n :], n).astype(np.int64))
                rows += n
                if rows > MERGE_ROWS:
                    keys, counts = summed(keys, counts)
                    rows = 0
        if keys:
            mark(bits, at, keys, counts)
            yield row(slot, bits)

    return run


def bit_table(rows: list, buckets: int) -> np.ndarray:
    """The bits of all slots as one array, eight to a byte."""
    slots, span = _slots(buckets)
    table = np.zeros((slots, span), bool)
    for r in rows:
        table[r["slot"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=span, bitorder="little")
    return np.packbits(table.ravel(), bitorder="little")


def _counted(words: int, buckets: int, table):
    """Arrow function over (group, text): (group, words, phrase, n) of each shard; the row of no words has the group's total."""

    def often(codes):
        cell = _cells(_places(codes, buckets), buckets)
        return (table.value[cell >> 3] >> (cell & 7) & 1).astype(bool)

    def out(group, size, phrases, counts):
        b = pa.RecordBatch.from_arrays([group, pa.array(np.full(len(counts), size, np.int32)), phrases, pa.array(counts.astype(np.int64))], names=["group", "words", "phrase", "n"])
        for a in range(0, b.num_rows, 1 << 16):
            yield b.slice(a, 1 << 16)

    def run(batches):
        for s, names in _sequences(batches):
            label = pa.array(names, pa.string())
            yield from out(label, 0, pa.array([""] * len(names)), np.bincount(s.of, minlength=len(names)))
            for of, size, phrases, counts in phrases_of(s, words, often):
                yield from out(label.take(pa.array(of)), size, phrases.cast(pa.large_string()).cast(pa.string()), counts)

    return run


def collocations(docs: DataFrame, *, text_col: str = "text", group_col: str = "lang", words: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """(group_col, rank, phrase, a, l, r, n, score) of the best phrases of 2 to ``words`` words of each group."""
    rows = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("group"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(held // BUCKET_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slot = F.col("bucket") % _slots(buckets)[0]
    keys = rows.mapInArrow(_hashed(words, buckets), "bucket long, rows long, keys binary").repartition(slot).sortWithinPartitions(slot, "bucket")
    bits = keys.mapInArrow(_frequent(least, buckets), "slot long, bits binary").collect()  # SLOTS rows and CELLS bits at most
    table = spark.sparkContext.broadcast(bit_table(bits, buckets))
    counts = rows.mapInArrow(_counted(words, buckets, table), "group string, words int, phrase string, n long").groupBy("group", "words", "phrase").agg(F.sum("n").alias("n"))
    common = counts.where((F.col("n") >= least) | (F.col("words") == 0)).withColumn("id", F.monotonically_increasing_id())
    common = stage(common, sweep=True)  # ids stand for phrases from here on, as they are shorter
    totals = common.where("words = 0").select("group", F.col("n").alias("total"))
    cand = common.where("words >= 2").select("id", "group", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    def part(first: int, size, slot: int):
        return F.struct(F.array_join(F.slice("w", first, size), " ").alias("part"), F.lit(slot).cast("byte").alias("slot"))

    asked = []  # slot 2k: the first k words, slot 2k + 1: the rest, slot 0: other words inside
    for k in range(1, words):
        longer = F.col("words") > k
        asked += [F.when(longer, part(1, F.lit(k), 2 * k)), F.when(longer, part(k + 1, F.col("words") - k, 2 * k + 1))]
        asked += [F.when(F.col("words") > k + size, part(k + 1, F.lit(size), 0)) for size in range(2, words - k)]
    parts = cand.select("id", "group", "a", F.explode(F.filter(F.array(*asked), lambda x: x.isNotNull())).alias("p")).select("id", "group", "a", "p.*")
    of = common.where("words > 0").select("group", F.col("phrase").alias("part"), F.col("n").alias("f"))
    known = stage(parts.join(of, ["group", "part"]), sweep=True)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = [F.max(F.when(F.col("slot") == 2 * k + r, F.col("f"))).alias(f"{s}{k}") for k in range(1, words) for r, s in enumerate("lr")]
    scored = known.where("slot > 0").groupBy("id").agg(F.first("a").alias("a"), *cuts)
    scored = scored.withColumn("aa", F.lit(1_000_000).cast("decimal(38,0)") * wide("a") * wide("a"))
    best = F.array_min(F.filter(F.array(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"aa div (cast(l{k} as decimal(38,0)) * cast(r{k} as decimal(38,0)))").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, words))), lambda x: x.isNotNull()))
    scored = scored.select("id", best.alias("b")).select("id", "b.l", "b.r", "b.score")
    held = known.where(F.col("part").contains(" ") & (F.lit(100) * F.col("a") >= F.lit(inside) * F.col("f"))).select("group", F.col("part").alias("phrase")).distinct()
    left = cand.select("id", "group", "phrase", "a").join(held, ["group", "phrase"], "left_anti")
    scored = left.join(scored, "id").select("group", "phrase", "a", "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    scored = scored.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("group", "share").orderBy(*order))).where(F.col("rank") <= top)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(*order))).where(F.col("rank") <= top)
    return scored.join(totals, "group").select(F.col("group").alias(group_col), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")

"""N-gram Jaccard self-join by T-occurrence search (operator 6).

Documents are sets of word shingles; two link when ``den * overlap >= num *
union``.  The steps:

1. Exact classes.  Equal sets collapse to the smallest node, by an aggregation.
2. Signatures thin out the documents.  A linked pair differs in at most ``d``
   shingles, so when the hash space is cut into ``d + 1 + e`` buckets, more
   than ``e`` buckets hold equal parts of both sets.  Each set emits one hash
   per non-empty bucket, for its own size class and the next one; sets with
   more than ``e`` empty buckets also emit those.  Only documents that share a
   signature go on.
3. Inverted lists.  Every shingle of these documents has its list, and lists
   are ordered by length.  A linked pair shares ``T`` shingles, so it meets
   on one of the ``n - T + 1`` shortest lists of either document (DivideSkip
   with all other lists taken as long ones).  Lists of one document vanish.
4. Verification in blocks.  Every set points to the most sharing set on its
   short lists; sets that pointers connect are a family.  A family is first
   asked by its most sharing member alone, then by those that it did not
   reach; at last, short lists that still hold several components and
   families are asked by all but their main component.  Lists with the same
   members are asked once.  Sides of a block above ``tile_rows`` sets are cut
   into tiles, so a block of any size is spread over tasks.
5. T-occurrence by DivideSkip.  In a tile, the short lists of a query are
   merged with a lowered threshold, the survivors binary-probe the long ones,
   and the exact count decides.  The merge is a stable sort of the joined
   lists, which merges sorted runs; a heap in Python takes many times longer.
   Tiles return spanning links only; components are joined with map-side
   combining.

A shingle or signature that many sets of one slice of the input hold is dealt
out over salted keys; its list counts as a longest one.

Shingles are 64-bit hashes.  Defined cases: a null or blank text has the empty
set and links with nothing; a text with fewer words than a shingle is one
shingle; equal texts are one class; rows that repeat an id are one document to
the result and carry the links of all of their texts; a null id gets a null
component; ties between lists or members go to the smaller hash or id; an empty
table gives an empty result; other columns of the input, whatever their names,
are ignored.  Ids are integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_staged, mix, numbered, shingles_of, slices, stage

CAP = 65_536  #: a list of so many documents, or one that was dealt out, counts as a longest one
SALTS = 64  #: keys over which a frequent shingle or signature is dealt out
LONG_BIAS = 0.01  # DivideSkip's constant: number of long lists = T / (LONG_BIAS * log2(longest) + 1)


class Buckets:
    """Size classes of sets and how many signature buckets each class pair has."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.hi = num, den, [0, 1]
        self.m, self.spare = [1, 1], [0, 0]

    def grow(self, size: int) -> None:
        while self.hi[-2] < size:  # also the class above the largest set
            low = self.hi[-1] + 1
            self.hi.append(max(low, low * self.den // self.num))
            d = (self.den - self.num) * 2 * self.hi[-1] // (self.den + self.num)
            spare = 0
            if d >= 12:
                mean = (d + 1) * math.exp(-(self.hi[-3] + 1) / (d + 1))
                spare = math.ceil(mean + 2 * math.sqrt(mean))
            self.m.append(d + 1 + spare)
            self.spare.append(spare)

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(signature, index of its set) over all sets."""
        sizes = np.array([len(s) for s in sets], np.int64)
        if not sizes.sum():
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.grow(int(sizes.max()))
        m, spare, hi = np.array(self.m), np.array(self.spare), np.array(self.hi)
        tokens = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets)), sizes)
        mixed = mix(tokens + np.uint64(0x51ED270B))
        own = np.searchsorted(hi, sizes)
        out_sig, out_of = [], []
        for step in (0, 1):
            p = own + step
            n_buckets = np.where(sizes > 0, m[p], 0)
            base = np.concatenate(([0], np.cumsum(n_buckets)))
            at = base[of] + (tokens % n_buckets[of].astype(np.uint64)).astype(np.int64)
            sums, filled = np.zeros(base[-1], np.uint64), np.zeros(base[-1], bool)
            np.add.at(sums, at, mixed)
            filled[at] = True
            whose = np.repeat(np.arange(len(sets)), n_buckets)
            number = np.arange(base[-1]) - base[whose]
            empty = np.bincount(whose, ~filled, len(sets))
            keep = filled | (empty > spare[p])[whose]
            tag = (p[whose].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64) * np.uint64(2) + filled.astype(np.uint64)
            out_sig.append(mix(mix(sums) ^ mix(tag))[keep])
            out_of.append(whose[keep])
        return np.concatenate(out_sig), np.concatenate(out_of)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, k1, k2): sizes and 128-bit hashes of the sets."""

    def run(batches):
        for b in batches:
            for start, texts in slices(b):
                sets = shingles_of(texts, n)
                k1 = [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                k2 = [int(np.bitwise_xor.reduce(mix(s + np.uint64(99)), initial=np.uint64(len(s))).astype(np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], names=["id", "n", "k1", "k2"])

    return docs.mapInArrow(run, "id long, n long, k1 long, k2 long")


def salted(keys: np.ndarray, ids: np.ndarray, sets: int) -> pa.RecordBatch:
    """(sig, id, salt) rows; a key that 1/16 of ``sets`` sets (and 16) hold is dealt out, with one null row at salt 0 to tell the others."""
    uniq, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    hot = counts >= max(16, sets / 16)
    salt = np.where(hot[inverse], 1 + (mix(ids.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64), 0)
    told = uniq[hot]
    key = np.concatenate((keys, told)).view(np.int64)
    null = np.concatenate((np.zeros(len(keys), bool), np.ones(len(told), bool)))
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate((salt, 0 * told.astype(np.int64))), pa.int32()), pa.array(np.concatenate((ids, 0 * told.astype(np.int64))), mask=null)], names=["sig", "salt", "id"]).select(["sig", "id", "salt"])


def _postings(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(sig, id, salt) rows of all sets; of equal sets in a slice only the smallest id emits, as no other can stand for its class."""

    def run(batches):
        buckets = Buckets(num, den)
        for b in batches:
            for start, texts in slices(b):
                sets = shingles_of(texts, n)
                ids = np.asarray(b.column(0).slice(start, len(texts)))
                first: dict[bytes, int] = {}
                for i in np.argsort(ids, kind="stable").tolist():
                    first.setdefault(sets[i].tobytes(), i)
                own = sorted(first.values())
                sig, of = buckets.signatures([sets[i] for i in own])
                yield salted(sig, ids[own][of], len(own))

    return docs.mapInArrow(run, "sig long, id long, salt int")


def _inverted(sets: DataFrame) -> DataFrame:
    """(sig, id, salt) rows of all shingles of (id, n, tokens)."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                sizes = part.column(1).to_numpy()
                ids = np.repeat(part.column(0).to_numpy(), sizes)
                yield salted(part.column(2).flatten().to_numpy().view(np.uint64), ids, part.num_rows)

    return sets.select("id", "n", "tokens").mapInArrow(run, "sig long, id long, salt int")


def shared_rows(rows: DataFrame) -> DataFrame:
    """Of (sig, id, salt), those (sig, id, df) whose sig another id has too: one shuffle, then a streaming pass over sorted rows."""

    def whole(sig, salt, ids, null):
        start = np.concatenate(([True], (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])))
        of = np.cumsum(start) - 1
        new = ~null & (start | np.concatenate(([True], (ids[1:] != ids[:-1]) | null[:-1])))  # a repeated row counts once
        hot = (salt[start] > 0) | (np.bincount(of, null) > 0)
        df = np.where(hot, CAP, np.minimum(np.bincount(of, new), CAP)).astype(np.int32)[of]
        return _rows_of(sig, ids, df, new & (df > 1))

    def run(batches):
        held, long = None, None  # rows of the last key so far; the key whose rows are known to be many
        for b in batches:
            if not b.num_rows:
                continue
            null = ~np.asarray(b.column(1).is_valid())
            cols = [np.asarray(b.column(0)), np.asarray(b.column(2)), b.column(1).fill_null(0).to_numpy(), null]
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            sig, salt, ids, null = cols
            goes_on = int(((sig == long[0]) & (salt == long[1])).sum()) if long else 0
            if goes_on:
                yield _rows_of(sig, ids, np.full(len(sig), CAP, np.int32), (np.arange(len(sig)) < goes_on) & ~null)
            last = max(goes_on, int(np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1]))))[-1]))
            if last > goes_on:
                yield whole(*(c[goes_on:last] for c in cols))
            held = [c[last:] for c in cols] if last < len(sig) else None
            if held is not None and len(held[0]) >= CAP:
                long = int(held[0][0]), int(held[1][0])
                yield _rows_of(held[0], held[2], np.full(len(held[0]), CAP, np.int32), ~held[3])
                held = None
        if held is not None:
            yield whole(*held)

    return rows.select("sig", "id", "salt").repartition("sig", "salt").sortWithinPartitions("sig", "salt", "id").mapInArrow(run, "sig long, id long, df int")


def _rows_of(sig, ids, df, keep):
    return pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(ids[keep]), pa.array(df[keep])], names=["sig", "id", "df"])


def t_occurrence(query: np.ndarray, keys: np.ndarray, firsts: np.ndarray, lens: np.ndarray, postings: np.ndarray, probes: np.ndarray, least: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents on at least ``least`` of the inverted lists of ``query``, and on how many.

    ``keys``: sorted tokens; list k is ``postings[firsts[k] : firsts[k] + lens[k]]``
    in ascending document order; ``probes``: k * docs + document, sorted.
    """
    k = np.searchsorted(keys, query)
    k = k[keys[np.minimum(k, len(keys) - 1)] == query]
    if len(k) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = k[np.argsort(lens[k], kind="stable")]
    longest = max(2, int(lens[k[-1]]))
    n_long = min(least - 1, int(least / (LONG_BIAS * math.log2(longest) + 1)), len(k))
    short, long = k[: len(k) - n_long], k[len(k) - n_long :]
    total = int(lens[short].sum())
    at = np.repeat(firsts[short] - np.concatenate(([0], np.cumsum(lens[short])[:-1])), lens[short]) + np.arange(total)
    merged = np.sort(postings[at], kind="stable")  # merges the sorted short lists
    found, counts = np.unique(merged, return_counts=True)
    near = counts >= least - n_long
    found, counts = found[near], counts[near]
    for chunk in range(0, len(found), 4096):
        part = found[chunk : chunk + 4096]
        want = long[:, None] * docs + part[None, :]
        at = np.searchsorted(probes, want)  # binary probes of the long lists
        counts[chunk : chunk + 4096] += (probes[np.minimum(at, len(probes) - 1)] == want).sum(0)
    enough = counts >= least
    return found[enough], counts[enough]


def link_tile(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, answers: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the sets that ask and those that answer, reduced to (id, smallest id of its local component).

    ``sets`` hold the shingles that can be shared, ``sizes`` count all of a set.
    """
    index = np.flatnonzero(answers)
    if not len(index) or not len(sets):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tokens = np.concatenate([sets[i] for i in index])
    owner = np.repeat(index, [len(sets[i]) for i in index])
    order = np.lexsort((owner, tokens))
    tokens, postings = tokens[order], owner[order]
    keys, firsts, lens = np.unique(tokens, return_index=True, return_counts=True)
    docs = len(sets)
    probes = np.repeat(np.arange(len(keys)), lens) * docs + postings
    root = np.arange(docs)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for q in np.flatnonzero(asks):
        least = max(1, -(-num * int(sizes[q]) // den))
        found, overlap = t_occurrence(sets[q], keys, firsts, lens, postings, probes, least, docs)
        ok = (found != q) & (den * overlap >= num * (sizes[q] + sizes[found] - overlap))
        for y in found[ok]:
            a, b = find(q), find(int(y))
            if a != b:
                root[max(a, b)] = min(a, b)
    roots = np.array([find(i) for i in range(docs)])
    linked = np.bincount(roots, minlength=docs)[roots] > 1
    low = np.full(docs, np.iinfo(np.int64).max)
    np.minimum.at(low, roots, ids)
    return ids[linked], low[roots[linked]]


def _verify(blocks: DataFrame, sets: DataFrame, num: int, den: int, tile_rows: int) -> DataFrame:
    """Spanning links (a, b) of blocks (block, side, id): side 0 asks, side 1 answers, side 2 does both."""
    many = lambda side: F.ceil(F.count(F.when(F.col("side") != side, 1)) / tile_rows).cast("long")
    sizes = blocks.groupBy("block").agg(many(1).alias("t0"), many(0).alias("t1")).where("t0 > 0 and t1 > 0")
    own = lambda t: F.pmod(F.xxhash64("id"), F.col(t))
    rows = blocks.join(sizes, "block").select("block", "side", "id", "t0", "t1", own("t0").alias("own0"), own("t1").alias("own1"))
    asked = F.transform(F.sequence(F.lit(0).cast("long"), F.col("t1") - 1), lambda j: F.struct(F.col("own0").alias("ta"), j.alias("tb")))
    answered = F.transform(F.sequence(F.lit(0).cast("long"), F.col("t0") - 1), lambda i: F.struct(i.alias("ta"), F.col("own1").alias("tb")))
    tiles = F.when(F.col("side") == 0, asked).when(F.col("side") == 1, answered).otherwise(F.array_union(asked, answered))
    rows = rows.select("block", "side", "id", "own0", "own1", F.explode(tiles).alias("tile")).select("block", "tile.ta", "tile.tb", "id", "side", "own0", "own1")
    keys = ["block", "ta", "tb"]

    def run(batches):
        for key, cols in _groups(batches, 3):
            ids, side, own0, own1, sizes = (np.asarray(cols[i]) for i in range(3, 8))
            data = [np.asarray(x.values).view(np.uint64) for x in cols[8]]
            a, b = link_tile(ids, sizes, data, (side != 1) & (own0 == key[1]), (side != 0) & (own1 == key[2]), num, den)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = rows.join(sets, "id").select(*keys, "id", "side", "own0", "own1", "n", "tokens").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, "a long, b long").where("a <> b")


def _groups(batches, n_keys: int):
    """Yield (key, columns as lists of scalars or arrays) of consecutive rows with equal key columns."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.column_stack([np.asarray(b.column(i)) for i in range(n_keys)])
        cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for a, z in zip(cut, cut[1:], strict=False):
            now = tuple(keys[a].tolist())
            if now != key and held:
                yield key, _columns(held)
                held = []
            key = now
            held.append(b.slice(a, z - a))
    if held:
        yield key, _columns(held)


def _columns(held):
    t = pa.Table.from_batches(held).combine_chunks()
    return [c if pa.types.is_list(c.type) else c.to_numpy() for c in t.columns]


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, tile_rows: int = 1024) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row; ``component_id`` is the smallest id reachable by links."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows, names = numbered(rows)
    known = stage(_sets(rows, words))
    classes = stage(known.where("n > 0 and id is not null").groupBy("n", "k1", "k2").agg(F.min("id").alias("rep")))
    shared = stage(shared_rows(_postings(rows.where("id is not null"), words, num, den)).select("id").distinct(), sweep=True)
    wanted = shared.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").hint("merge")  # one plan at every size
    sets = stage(_token_sets(rows.join(wanted, "id", "left_semi"), words).dropDuplicates(["id"]), sweep=True)
    lists = shared_rows(_inverted(sets)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("lists"))
    least = f"cast((n * {num} + {den - 1}) div {den} as int)"  # T of a set, whatever its partner
    lists = lists.join(sets.select("id", "n"), "id").where(f"size(lists) >= {least}")
    lists = stage(lists.select("id", "n", F.col("lists.sig").alias("tokens"), F.expr(f"slice(lists.sig, 1, size(lists) - {least} + 1)").alias("short")), sweep=True)
    drop_staged(sets)
    drop_staged(shared)
    sets = lists.select("id", "n", "tokens")
    edges = _links(lists, sets, num, den, tile_rows)
    out = known.join(classes, ["n", "k1", "k2"], "left").withColumn("rep", F.coalesce("rep", "id"))
    if names is not None:  # the texts of one id belong together
        out = out.join(names, F.col("id") == F.col("node"), "left").drop("node")
        low = out.where("doc is not null").groupBy("doc").agg(F.min("rep").alias("low"))
        edges = edges.union(out.join(low, "doc").select("rep", "low").where("rep <> low").distinct())
    comp = components(edges)
    out = out.join(comp, F.col("rep") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "rep")).drop("node")
    if names is not None:
        out = out.join(names.select("node", F.col("doc").alias("first")), F.col("component_id") == F.col("node"), "left").withColumn("component_id", F.col("first")).withColumn("id", F.col("doc"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def _links(lists: DataFrame, sets: DataFrame, num: int, den: int, tile_rows: int) -> DataFrame:
    """Spanning links (a, b) of all sets (id, n, tokens, short) that meet on short lists."""
    live = lists.select(F.explode("short").alias("sig"), "id")
    live = stage(live.join(live.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1"), "sig"))
    popular = live.groupBy("id").agg(F.sum("k").alias("pop"))
    centre = live.join(popular, "id").groupBy("sig").agg(F.max_by("id", F.struct("pop", -F.col("id"))).alias("centre"))
    votes = live.join(centre, "sig").groupBy("id", "centre").agg(F.count("*").alias("votes"))
    best = stage(votes.groupBy("id").agg(F.max_by("centre", F.struct("votes", -F.col("centre"))).alias("centre")))
    joined = components(best, "id", "centre")
    family = best.join(joined, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("family")).join(popular, "id")
    family = stage(family)
    star = family.groupBy("family").agg(F.max_by("id", F.struct("pop", -F.col("id"))).alias("star"), F.count("*").alias("k")).where("k > 1")
    members = stage(family.join(star, "family").select("family", "star", "id"))
    first = stage(_verify(members.select(F.col("family").alias("block"), F.when(F.col("id") == F.col("star"), 0).otherwise(1).alias("side"), "id"), sets, num, den, tile_rows))
    reached = first.select(F.col("a").alias("id")).union(first.select("b")).distinct().withColumn("reached", F.lit(1))
    rest = members.where("id <> star").join(reached, "id", "left").select(F.col("family").alias("block"), F.when(F.col("reached") == 1, 1).otherwise(2).alias("side"), "id")
    second = stage(_verify(rest, sets, num, den, tile_rows))
    comp = components(first.union(second))
    tagged = stage(live.join(family, "id").join(comp, F.col("id") == F.col("node"), "left").select("sig", "id", "family", F.coalesce("component", "id").alias("comp")))
    mixed = tagged.groupBy("sig").agg(*(f(c).alias(f.__name__ + c) for f in (F.min, F.max) for c in ("family", "comp")), F.count("*").alias("k"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    asked = mixed.where("minfamily <> maxfamily and mincomp <> maxcomp").groupBy("k", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
    left = stage(tagged.join(asked, "sig"))
    main = left.groupBy("sig", "comp").agg(F.count("*").alias("k")).groupBy("sig").agg(F.max_by("comp", F.struct("k", -F.col("comp"))).alias("main"))
    third = stage(_verify(left.join(main, "sig").select(F.col("sig").alias("block"), F.when(F.col("comp") == F.col("main"), 1).otherwise(2).alias("side"), "id"), sets, num, den, tile_rows))
    for used in (live, best, family, members, tagged, left):
        drop_staged(used)
    return first.union(second).union(third)


def _token_sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, n, tokens) of every row."""

    def run(batches):
        for b in batches:
            for start, texts in slices(b):
                sets = shingles_of(texts, n)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                sizes = [len(s) for s in sets]
                offsets = np.concatenate(([0], np.cumsum(sizes)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))], names=["id", "n", "tokens"])

    return docs.mapInArrow(run, "id long, n long, tokens array<long>")

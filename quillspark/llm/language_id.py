"""Language identification by script ranges and Viterbi over words (operator 12).

A word is a run of letters of one script.  Its script, told by code point
ranges, narrows the languages to those in whose training text the script has at
least ``least_share`` of the letters (all languages where none has).  A word's
score for a language is the log-probability of its character n-grams of one to
four letters, ends marked, averaged over the orders; n-grams are hashed to
``buckets`` counts a language.  Viterbi finds the language of every word that
maximises the sum of scores less ``penalty`` for each change within a text, so
spans of mixed text keep their own language.

The best paths of all texts of a slice are found together: texts are laid end
to end, with a change free of cost where one begins, and the sequence is cut
into blocks of about the square root of its length.  All blocks are stepped
through at once, first for every state they may start from, then, once the
states at the blocks' borders are known, for the path itself.

Learning counts n-grams in about ``fit_rows`` labelled rows a language, chosen
by a hash of the id, in one pass whose counts Spark adds up; at most languages x
(buckets + scripts) numbers reach the driver.  Prediction is one Arrow pass
without a shuffle.

Defined cases: null texts and texts without a letter are ``und`` with score 0
and no spans, as is every text where nothing was learned; long texts are read
whole, features in windows cut after white space; rows of null language teach
nothing; repeated rows are predicted alike and teach each time; ties of paths
and of totals fall to the language first in order; other columns, whatever
their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, mix, slices

#: First and last code point of the blocks of a script, in order; letters outside are of script "other".
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x0250, 0x02AF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"),
    (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"), (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0C80, 0x0CFF, "kannada"),
    (0x0D00, 0x0D7F, "malayalam"), (0x0E00, 0x0E7F, "thai"), (0x0E80, 0x0EFF, "lao"), (0x1000, 0x109F, "myanmar"), (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"), (0x1200, 0x137F, "ethiopic"), (0x1780, 0x17FF, "khmer"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x309F, "kana"), (0x30A0, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0x20000, 0x2FA1F, "han"),
)
NAMES = (*dict.fromkeys(s for _, _, s in SCRIPTS), "other")
ORDERS = (1, 2, 3, 4)
TOP = 0x30000  #: code points from here on are no letters
NEVER = -1e6  #: what a word adds to the path of a language that its script rules out


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Script of each code point, from 1, or 0 for what is no letter or mark; and its lower case."""
    kind = np.zeros(TOP, np.uint8)
    low = np.arange(TOP, dtype=np.uint32)
    for c in range(TOP):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            kind[c] = len(NAMES)
        if len(x := ch.lower()) == 1:
            low[c] = ord(x)
    for a, b, name in SCRIPTS:
        part = kind[a : b + 1]
        part[part > 0] = NAMES.index(name) + 1
    return kind, low


@dataclass
class Words:
    """Words of a slice: text index, first and last code point in the text, script, and number among the distinct ones."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    number: np.ndarray
    distinct: list[tuple[np.ndarray, np.ndarray]]  # code points and offsets of distinct words; one entry for each window


def words_in(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(starts, ends, script, number, distinct words) of the runs of letters of one script; combining marks stay with their letter."""
    kind, low = _tables()
    x = np.minimum(points, TOP - 1)
    k = kind[x]
    k[points >= TOP] = 0
    mark = (points >= 0x300) & (points < 0x370)
    if mark.any():  # a mark has the script of the letter before it
        at = np.where(mark, 0, np.arange(len(k)))
        k = np.where(mark, k[np.maximum.accumulate(at)], k)
    edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
    a, b = edge[:-1], edge[1:]
    on = k[a] > 0
    a, b = a[on], b[on]
    letters = low[x][k > 0]
    offsets = np.zeros(len(a) + 1, np.int64)
    np.cumsum(b - a, out=offsets[1:])
    named = pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(offsets * 4), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
    words = named.dictionary
    data = words.buffers()
    at = np.frombuffer(data[1], np.int64)[: len(words) + 1] // 4 if len(words) else np.zeros(1, np.int64)
    chars = np.frombuffer(data[2], np.uint32)[: at[-1]] if len(words) else np.zeros(0, np.uint32)
    return a, b, k[a] - 1, named.indices.to_numpy().astype(np.int64), (chars, at)


def grams(distinct: tuple[np.ndarray, np.ndarray], buckets: int):
    """Yield (word, bucket) of the character n-grams of distinct words, ends marked, one order at a time."""
    chars, at = distinct
    lens = np.diff(at)
    n = len(lens)
    where = np.repeat(np.arange(n), lens + 2)
    text = np.zeros(len(chars) + 2 * n, np.uint64)
    text[np.arange(len(chars)) + 2 * np.repeat(np.arange(n), lens) + 1] = chars
    for order in ORDERS:
        size = len(text) - order + 1
        if size <= 0:
            break
        h = np.full(size, order, np.uint64)
        for j in range(order):
            h = h * np.uint64(0x100000001B3) + text[j : size + j]
        keep = where[:size] == where[order - 1 :]
        if order == 1:
            keep &= text[:size] > 0
        yield where[:size][keep], (mix(h[keep]) % np.uint64(buckets)).astype(np.int64)


def windows(text: bytes):
    """A text in parts of about a slice, cut after white space, else between two characters."""
    a = 0
    while len(text) - a > SLICE_BYTES:
        b = max(text.rfind(b" ", a, a + SLICE_BYTES), text.rfind(b"\n", a, a + SLICE_BYTES)) + 1
        if b <= a:
            b = a + SLICE_BYTES
            while text[b] & 0xC0 == 0x80:
                b -= 1
        yield text[a:b]
        a = b
    yield text[a:] if a else text


def words_of_slice(texts: list[bytes]) -> Words:
    """The words of all texts of a slice; short texts share a window."""
    parts: list[tuple[list[int], list[bytes]]] = []
    for i, t in enumerate(texts):
        for w in windows(t):
            if not parts or sum(map(len, parts[-1][1])) + len(w) > 2 * SLICE_BYTES:
                parts.append(([], []))
            parts[-1][0].append(i)
            parts[-1][1].append(w)
    shift = np.zeros(len(texts), np.int64)  # code points of a text before the window
    got: list[list[np.ndarray]] = [[], [], [], [], []]
    distinct, known = [], 0
    for index, pieces in parts:
        points = np.frombuffer(b"\n".join(pieces).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        sizes = np.array([len(p) - sum(np.bincount(np.frombuffer(p, np.uint8) >> 6, minlength=4)[2:3]) for p in pieces], np.int64)
        first = np.cumsum([0, *(sizes + 1)])[:-1]
        a, b, script, number, words = words_in(points)
        piece = np.searchsorted(first, a, "right") - 1
        base = np.empty(len(pieces), np.int64)
        for j, i in enumerate(index):
            base[j] = shift[i] - first[j]
            shift[i] += sizes[j]
        for column, values in zip(got, (np.array(index, np.int64)[piece], a + base[piece], b + base[piece], script, number + known), strict=True):
            column.append(values)
        distinct.append(words)
        known += len(words[1]) - 1
    return Words(*(np.concatenate(c) if c else np.zeros(0, np.int64) for c in got), distinct)


def best_path(score: np.ndarray, opens: np.ndarray, penalty: float) -> np.ndarray:
    """The state of each step that maximises the sum of scores less ``penalty`` a change; changes are free where ``opens``.

    Of equal paths a step keeps the state it comes from, and else the first.
    """
    n, k = score.shape
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)
    s = np.zeros((blocks * size, k))
    s[:n] = score
    cost = np.full(blocks * size, np.inf)  # what is filled up changes nothing
    cost[:n] = np.where(opens, 0.0, penalty)
    s, cost = s.reshape(blocks, size, k), cost.reshape(blocks, size)

    def ahead(v, t):
        return np.maximum(v, v.max(-1, keepdims=True) - cost[:, t].reshape(-1, *[1] * (v.ndim - 1))) + s[:, t].reshape(blocks, *[1] * (v.ndim - 2), k)

    through = np.broadcast_to(np.where(np.eye(k, dtype=bool), 0.0, -np.inf), (blocks, k, k))
    for t in range(size):
        through = ahead(through, t)
    enter = np.zeros((blocks, k))
    for b in range(blocks - 1):
        v = (enter[b][:, None] + through[b]).max(0)
        enter[b + 1] = v - v.max()
    back = np.empty((size, blocks, k), np.int16)
    v, stay = enter, np.arange(k)
    for t in range(size):
        top = v.argmax(-1)
        back[t] = np.where(v.max(-1, keepdims=True) - cost[:, t, None] > v, top[:, None], stay)
        v = ahead(v, t)
    came = np.broadcast_to(stay, (blocks, k))  # where a block was entered, for each state it may end in
    for t in range(size - 1, -1, -1):
        came = np.take_along_axis(back[t], came, 1)
    ends = np.empty(blocks, np.int64)
    state = int(v[-1].argmax())
    for b in range(blocks - 1, -1, -1):
        ends[b] = state
        state = int(came[b, state])
    path = np.empty((size, blocks), np.int64)
    state, row = ends, np.arange(blocks)
    for t in range(size - 1, -1, -1):
        path[t] = state
        state = back[t][row, state]
    return path.T.ravel()[:n]


class Model:
    """Log-probabilities of n-gram buckets by language, and the scripts of each."""

    def __init__(self, langs: list[str], counts: np.ndarray, letters: np.ndarray, least_share: float):
        self.langs, self.buckets = langs, counts.shape[1]
        total = counts.sum(1, keepdims=True)
        self.log = np.log((counts + 0.05) / (total + 0.05 * self.buckets)) / len(ORDERS)
        share = letters / np.maximum(letters.sum(1, keepdims=True), 1)
        self.allowed = (share >= least_share).T  # script x language
        self.allowed[~self.allowed.any(1)] = True

    def scores(self, words: Words) -> np.ndarray:
        """(words, languages): what each word adds to the path of each language."""
        rows = []
        for part in words.distinct:
            n = len(part[1]) - 1
            table = np.zeros((n, len(self.langs)))
            for word, bucket in grams(part, self.buckets):
                for k in range(len(self.langs)):
                    table[:, k] += np.bincount(word, self.log[k, bucket], n)
            rows.append(table)
        out = np.concatenate(rows)[words.number] if rows else np.zeros((0, len(self.langs)))
        out[~self.allowed[words.script]] = NEVER
        return out

    def label(self, texts: list[bytes], penalty: float):
        """(language, score, spans) of each text; spans are (start, end, language) in code points, from a first to a last letter."""
        out = [("und", 0.0, [])] * len(texts)
        words = words_of_slice(texts)
        if not self.langs or not len(words.text):
            return out
        opens = np.concatenate(([True], words.text[1:] != words.text[:-1]))
        path = best_path(self.scores(words), opens, penalty)
        size = (words.end - words.start).astype(np.float64)
        k = len(self.langs)
        share = np.bincount(words.text * k + path, size, len(texts) * k).reshape(-1, k)
        begin = np.flatnonzero(opens | np.concatenate(([True], path[1:] != path[:-1])))
        end = words.end[np.append(begin[1:] - 1, len(path) - 1)]
        of = words.text[begin]
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        spans = list(zip(words.start[begin].tolist(), end.tolist(), [self.langs[j] for j in path[begin]], strict=True))
        for i in np.unique(words.text).tolist():
            best = int(share[i].argmax())
            out[i] = (self.langs[best], float(share[i, best] / share[i].sum()), spans[bounds[i] : bounds[i + 1]])
        return out


def _counts(buckets: int):
    """Arrow function over (lang, text): (lang, at, n), n-grams at their bucket, letters of a script at -1 less its number."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for start, texts in slices(b):
                langs = b.column(0).slice(start, len(texts)).to_pylist()
                names = sorted(set(langs))
                of = np.array([names.index(x) for x in langs])
                words = words_of_slice(texts)
                if not len(words.text):
                    continue
                lang = of[words.text]
                seen = np.concatenate([[0], np.cumsum([len(p[1]) - 1 for p in words.distinct])])
                for i, name in enumerate(names):
                    mine = lang == i
                    row = total.setdefault(name, np.zeros(buckets + len(NAMES), np.int64))
                    row[buckets:] += np.bincount(words.script[mine], words.end[mine] - words.start[mine], len(NAMES)).astype(np.int64)
                    times = np.bincount(words.number[mine], minlength=seen[-1])
                    for part, a, z in zip(words.distinct, seen[:-1], seen[1:], strict=True):
                        for word, bucket in grams(part, buckets):
                            row[:buckets] += np.bincount(bucket, times[a:z][word], buckets).astype(np.int64)
        for name, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(np.where(at < buckets, at, buckets - 1 - at)), pa.array(row[at])], names=["lang", "at", "n"])

    return run


def fit_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 4000, buckets: int = 1 << 16, least_share: float = 0.005) -> Model:
    """Learn from about ``fit_rows`` rows of each language of ``docs``."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = rows.groupBy("lang").agg((F.least(F.lit(1.0), fit_rows / F.count("*")) * F.lit(1 << 20)).alias("below"))  # reads no texts
    picked = rows.join(F.broadcast(sizes), "lang").where(  # a row for each language, as the model has
        F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("below")
    )
    got = picked.select("lang", "text").mapInArrow(_counts(buckets), "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts, letters = np.zeros((len(langs), buckets)), np.zeros((len(langs), len(NAMES)))
    where = got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    at, n = got["at"].to_numpy(np.int64), got["n"].to_numpy(np.float64)
    counts[where[at >= 0], at[at >= 0]] = n[at >= 0]
    letters[where[at < 0], -1 - at[at < 0]] = n[at < 0]
    return Model(langs, counts, letters, least_share)


def identify_languages(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = 8.0, **fit: int | float) -> DataFrame:
    """(id_col, lang_pred, score, spans) of every row, learned from the rows where ``train`` holds; the score is the share of letters in spans of lang_pred."""
    model = fit_languages(docs.where(train), id_col=id_col, text_col=text_col, lang_col=lang_col, **fit)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets numbers
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        for b in batches:
            for start, texts in slices(b):
                got = shipped.value.label(texts, penalty)
                marked = pa.array([[{"start": a, "end": z, "lang": x} for a, z, x in g[2]] for g in got], spans)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), marked], names=["id", "lang_pred", "score", "spans"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>").withColumnRenamed("id", id_col)

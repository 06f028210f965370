"""Benchmark decontamination by pigeonhole edit matching (operator 3).

A test item that occurs in a text with at most k edits, cut into k + 1 pieces,
has one piece that occurs exactly.  All pieces of all items form one
Aho-Corasick automaton; each hit proposes where the item would start, and
Myers' bit-parallel distance verifies the stretch around it.

Items stream through the driver, which holds one block of at most
``block_chars`` characters of them; each block is one pass over the texts whose
matches are written before the next block is read, so neither the driver nor a
task holds more than a block however many items there are.  No shuffle but one
aggregation of the matches.

Defined cases: matching ignores letter case and takes any white space as a
space; null and empty texts match nothing; null and blank items are skipped;
items too short for an error are searched as they are; equal items are reported
under each id; rows that repeat an id are reported once with their best match,
and of equally good matches the first; long texts are searched whole; other
columns, whatever their names, are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

_WHITE = re.compile(r"[\t\n\r\x0b\x0c\xa0]")


def normal(text: str) -> str:
    """Lower case, white space as spaces; the length stays the same."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return _WHITE.sub(" ", low)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` consecutive pieces of about equal length: (offset, piece)."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to a substring of ``text``, end of the first such substring)."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        plus = (mh << 1 | ~(xv | ph)) & full
        minus = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def find_items(text: str, automaton, items: list[str], budgets: list[int]) -> list[tuple[int, int, int, int]]:
    """Best match of every item within its budget: (item index, distance, start, end)."""
    spots: dict[int, list[int]] = {}
    for end, hits in automaton.iter(text):
        for i, offset, size in hits:
            spots.setdefault(i, []).append(end + 1 - size - offset)
    out = []
    for i, starts in spots.items():
        item, k = items[i], budgets[i]
        at = next((s for s in starts if s >= 0 and text.startswith(item, s)), None)
        if at is not None:
            out.append((i, 0, at, at + len(item)))
            continue
        best, spans = None, []
        for s in sorted(set(starts)):  # proposals that lie within the budget of each other are one stretch
            if spans and s - spans[-1][1] <= k:
                spans[-1][1] = s
            else:
                spans.append([s, s])
        for first, last in spans:
            a, b = max(0, first - k), last + len(item) + k
            distance, end = myers(item, text[a:b])
            if distance <= k and (best is None or distance < best[1]):
                _, length = myers(item[::-1], text[a : a + end][::-1])
                best = (i, distance, a + end - length, a + end)
        if best:
            out.append(best)
    return out


@functools.lru_cache(maxsize=2)
def _automaton(items: tuple[str, ...], budgets: tuple[int, ...]):
    hits: dict[str, list[tuple[int, int, int]]] = {}
    for i, (item, k) in enumerate(zip(items, budgets, strict=True)):
        for offset, piece in pieces(item, k):
            hits.setdefault(piece, []).append((i, offset, len(piece)))
    automaton = ahocorasick.Automaton()
    for piece, where in hits.items():
        automaton.add_word(piece, where)
    automaton.make_automaton()
    return automaton


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = 0.08, block_chars: int = 8_000_000) -> DataFrame:
    """(id_col, item_id, distance, start, end, n_chars of the item) of every item found in every text.

    The error budget of an item is ``floor(error_rate * characters)``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item {'long' if items.schema[item_id].dataType.simpleString() in ('bigint', 'int', 'smallint', 'tinyint') else 'string'}, distance int, start int, end int, n_chars int"
    found, held, size = None, [], 0  # matches so far; the block that is being filled
    item_kind = pa.int64() if items.schema[item_id].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else pa.string()
    wanted = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(item_id, item_text)

    def search(block):
        texts = tuple(t for _, t in block)
        budgets = tuple(int(error_rate * len(t)) for t in texts)

        def run(batches):
            automaton = _automaton(texts, budgets) if texts else None
            for b in batches if texts else ():
                out = []
                for key, text in zip(b.column(0), b.column(1), strict=True):
                    if text := text.as_py():
                        out += [(key.as_py(), block[i][0], d, s, e, len(texts[i])) for i, d, s, e in find_items(normal(text), automaton, texts, budgets)]
                yield pa.RecordBatch.from_pylist([dict(zip(("id", "item", "distance", "start", "end", "n_chars"), x, strict=True)) for x in out], schema=pa.schema([b.schema.field(0).with_name("id"), ("item", item_kind), *((c, pa.int32()) for c in ("distance", "start", "end", "n_chars"))]))

        return rows.mapInArrow(run, schema)

    for r in wanted.orderBy(item_id, item_text).toLocalIterator():
        text = normal(r[1]).strip()
        if not text:
            continue
        if size + len(text) > block_chars and held:
            got = stage(search(tuple(held)))
            found, held, size = got if found is None else found.union(got), [], 0
        held.append((r[0], text))
        size += len(text)
    if held or found is None:
        got = search(tuple(held))
        found = got if found is None else found.union(got)
    best = found.groupBy("id", "item").agg(F.min(F.struct("distance", "start", "end", "n_chars")).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_id), F.col("m.distance").alias("distance"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.n_chars").alias("item_chars"))

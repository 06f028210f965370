"""Toxicity by a weighted finite-state pattern grammar (operator 4).

Six transducers read the classes of a clause's words.  Insults and threats
emit weight, each on its own tape; negation, reported speech, target and
context change how much of it counts, the first two from where they stand, the
others at the end of the clause, so a target counts on either side.  They are
composed once into one automaton of tables, and a clause is scored by a walk
through it: a threat needs a target, a trigger that is all of its clause is no
match, and only matched clauses weigh.  The insult transducer takes a seed list
and words and stems learned from labelled rows by smoothed log-odds of their
occurrences; a logistic link fitted on the same rows turns the heaviest clause,
the sum over clauses and the sum for each word into the score of a document.

Learning uses at most ``fit_rows`` labelled rows by hash order of the id; term
counts are aggregated by Spark, and only terms that ``least_share`` of the
toxic rows hold reach the driver.  Scoring is one Arrow pass without a shuffle:
word and stem hashes find the clauses with a trigger, and only those are
walked, each from border to border.

Defined cases: null and empty texts score like any text without a trigger; long
texts are read whole; repeated rows score alike, and an id that repeats counts
once in the fit; ties between stems go to the heavier one; without labels the
seed grammar is used with a fixed link; other columns, whatever their names,
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _powers, drop_staged, mix, slices, stage

INSULTS = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown imbecile cretin vermin filth idiota imbécil estúpido basura idiote imbécile ordure dummkopf abschaum trottel".split()
THREATS = "kill murder hurt destroy burn shoot stab hang matar tuer töten umbringen".split()
TARGETS = "you your yours he she they them him her these those people du dich ihr sie tu vous ils tú usted ellos".split()
NEGATIONS = "not never no none nobody nicht kein keine pas jamais nunca tampoco".split()
REPORTS = "said says wrote writes claimed quoted quote allegedly called sagte schrieb dit écrit dijo escribió".split()
#: What a state multiplies emitted weight by, and how many words a negation reaches.
NEGATED, REPORTED, TARGETED, SCOPE = 0.3, 0.75, 1.25, 4
STEMS = (4, 5, 6, 7, 8, 9, 10)
CLASSES = OTHER, INSULT, THREAT, TARGET, NEGATE, REPORT = range(6)

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BORDER = np.zeros(256, bool)
_BORDER[list(b".;:?!\n")] = True


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer over word classes.

    ``step(state, class)`` is the next state; ``tape`` names the class whose
    weight it emits; ``factor(state)`` multiplies what any part emits there,
    and ``final(state)`` multiplies the (insult, threat) tapes at the end.
    """

    step: Callable[[int, int], int]
    tape: int | None = None
    factor: Callable[[int], float] = lambda state: 1.0
    final: Callable[[int], tuple[float, float]] = lambda state: (1.0, 1.0)


#: The grammar's parts; all start in state 0.
PARTS = (
    Transducer(lambda s, c: s, tape=INSULT),
    Transducer(lambda s, c: s, tape=THREAT),
    Transducer(lambda s, c: SCOPE if c == NEGATE else max(0, s - 1), factor=lambda s: NEGATED if s else 1.0),
    Transducer(lambda s, c: max(s, int(c == REPORT)), factor=lambda s: REPORTED if s else 1.0),
    Transducer(lambda s, c: max(s, int(c == TARGET)), final=lambda s: (TARGETED, TARGETED) if s else (1.0, 0.0)),
    Transducer(lambda s, c: min(2, s + 1), final=lambda s: (float(s > 1), float(s > 1))),
)


@dataclass(frozen=True)
class Automaton:
    """Tables over the states of a composition: next state and emitting factor by class, and final factors."""

    step: list[list[int]]
    factor: list[list[float]]
    final: list[tuple[float, float]]


def compose(parts: tuple[Transducer, ...]) -> Automaton:
    """The product of ``parts``: its states are the reachable tuples of theirs, its factors the products of theirs."""
    start = (0,) * len(parts)
    number, todo = {start: 0}, [start]
    out = Automaton([], [], [])
    emitting = {p.tape for p in parts}
    for state in todo:
        row = []
        for c in CLASSES:
            ahead = tuple(p.step(s, c) for p, s in zip(parts, state, strict=True))
            if ahead not in number:
                number[ahead] = len(todo)
                todo.append(ahead)
            row.append(number[ahead])
        weight = math.prod(p.factor(s) for p, s in zip(parts, state, strict=True))
        finals = [p.final(s) for p, s in zip(parts, state, strict=True)]
        out.step.append(row)
        out.factor.append([weight if c in emitting else 0.0 for c in CLASSES])
        out.final.append((math.prod(f[0] for f in finals), math.prod(f[1] for f in finals)))
    return out


class Grammar:
    """The composed transducers with their lexicon: words map to (class, weight), stems of insults to weights."""

    def __init__(self, learned: list[tuple[bytes, bool, float]] = ()):
        self.automaton = compose(PARTS)
        self.arcs: dict[bytes, tuple[int, float]] = {}
        for words, kind, weight in ((REPORTS, REPORT, 0), (NEGATIONS, NEGATE, 0), (TARGETS, TARGET, 0), (THREATS, THREAT, 1.5), (INSULTS, INSULT, 2.0)):
            self.arcs |= {w.encode(): (kind, weight) for w in words}
        self.stems: dict[bytes, float] = {}
        for term, whole, weight in learned:
            if whole:
                self.arcs[term] = (INSULT, weight)
            else:
                self.stems[term] = weight
        self.link = (-3.0, 2.0, 1.5, 0.0)
        h = lambda terms: np.unique(np.array([_hash(t) for t in terms], np.uint64))
        self.words = h([w for w, (k, _) in self.arcs.items() if k in (INSULT, THREAT)])
        self.by_length = {n: s for n in STEMS if len(s := h([t for t in self.stems if len(t) == n]))}

    def clause(self, clause: bytes) -> float:
        """Weight that the automaton emits over one lower-cased clause."""
        step, factor = self.automaton.step, self.automaton.factor
        state, tapes = 0, [0.0, 0.0]
        for m in _WORD.finditer(clause):
            kind, weight = self.arcs.get(m[0], (OTHER, 0.0))
            if kind == OTHER and self.by_length:
                weight = max((self.stems.get(m[0][:n], 0.0) for n in self.by_length), default=0.0)
                kind = INSULT if weight else OTHER
            if weight:
                tapes[kind == THREAT] += weight * factor[state][kind]
            state = step[state][kind]
        insult, threat = self.automaton.final[state]
        return tapes[0] * insult + tapes[1] * threat

    def weigh(self, texts: list[bytes]) -> np.ndarray:
        """(heaviest clause, sum over clauses, sum for each hundred words) of each text."""
        joined = (b"\n".join(texts) + b"\n").lower()
        buf = np.frombuffer(joined, np.uint8)
        inside = _LETTER[buf]
        before = np.concatenate(([False], inside[:-1]))
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
        up, down = _powers(len(buf) + 1)
        cum = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up[: len(buf)], dtype=np.uint64)))
        piece = lambda to: mix((cum[to] - cum[starts]) * down[starts] + (to - starts).astype(np.uint64))
        hit = np.isin(piece(ends), self.words)
        for n, known in self.by_length.items():
            hit |= np.isin(piece(np.minimum(ends, starts + n)), known) & (ends - starts >= n)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        borders = np.flatnonzero(_BORDER[buf])  # every text ends with one
        out = np.zeros((len(texts), 3))
        for k in np.unique(np.searchsorted(borders, starts[hit])):
            left, right = int(borders[k - 1]) + 1 if k else 0, int(borders[k])
            i = int(np.searchsorted(offsets, left, "right")) - 1
            w = self.clause(joined[left:right])
            out[i, 0] = max(out[i, 0], w)
            out[i, 1] += w
        words = np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=len(texts))
        out[:, 2] = 100 * out[:, 1] / np.maximum(words, 1)
        return out

    def probability(self, weights: np.ndarray) -> np.ndarray:
        z = self.link[0] + np.log1p(weights) @ np.array(self.link[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit_link(self, weights: np.ndarray, toxic: np.ndarray, rounds: int = 50) -> None:
        """Ridge logistic regression of the label on the clause weights, by Newton steps."""
        x = np.column_stack((np.ones(len(weights)), np.log1p(weights)))
        w = np.zeros(4)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - toxic) + 0.5 * w * (0, 1, 1, 1)
            w = w - np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + 0.5 * np.diag((1e-6, 1, 1, 1)), g)
        self.link = tuple(map(float, w))


def _hash(term: bytes) -> int:
    up, _ = _powers(len(term) + 1)
    b = np.frombuffer(term, np.uint8)
    return int(mix(np.array([(_BYTE[b] * up[: len(b)]).sum(dtype=np.uint64) + np.uint64(len(b))], np.uint64))[0])


def _terms(batches):
    """(term, whole, toxic, rows, uses): in how many of a batch's rows each word and stem occurs, and how often."""
    for b in batches:
        rows: dict[tuple[bytes, bool, int], int] = {}
        uses: dict[tuple[bytes, bool, int], int] = {}
        for text, toxic in zip(b.column(0), b.column(1), strict=True):
            toxic = toxic.as_py()
            own: dict[tuple[bytes, bool, int], int] = {}
            for w in _WORD.findall((text.as_py() or "").encode().lower()):
                for key in ((w, True, toxic), *((w[:n], False, toxic) for n in STEMS if len(w) > n)):
                    own[key] = own.get(key, 0) + 1
            for key, n in own.items():
                rows[key], uses[key] = rows.get(key, 0) + 1, uses.get(key, 0) + n
        keys = list(rows)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(rows.values()), pa.int64()), pa.array([uses[k] for k in keys], pa.int64())], names=["term", "whole", "toxic", "rows", "uses"])


def learn_grammar(labelled: DataFrame, *, least_rows: int = 4, least_share: float = 0.004, least_odds: float = 2.5) -> Grammar:
    """Learn terms and the link from (doc_id, text, toxic); ``labelled`` is a bounded sample."""
    n_tox, n_all = labelled.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not n_tox or n_tox == n_all:
        return Grammar()
    counts = labelled.select("text", F.col("toxic").cast("int")).mapInArrow(_terms, "term binary, whole boolean, toxic int, rows long, uses long")
    part = lambda c, k: F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col(c))), F.lit(0))
    counts = stage(counts.groupBy("term", "whole").agg(part("rows", 1).alias("t"), part("rows", 0).alias("c"), part("uses", 1).alias("tu"), part("uses", 0).alias("cu")))
    sums = counts.where("whole").agg(F.sum("tu").alias("tu"), F.sum("cu").alias("cu")).first()
    rate = lambda n, total: (F.col(n) + 0.3) / ((total or 0) + 0.6)
    odds = F.log(rate("tu", sums["tu"])) - F.log(rate("cu", sums["cu"]))
    rowwise = F.log((F.col("t") + 0.1) / (n_tox + 0.2)) - F.log((F.col("c") + 0.3) / (n_all - n_tox + 0.6))
    known = counts.withColumn("odds", odds).where((F.col("t") >= max(least_rows, least_share * n_tox)) & (F.col("odds") >= least_odds) & (rowwise >= least_odds / 2)).collect()
    drop_staged(counts)
    learned = sorted((bytes(r["term"]), r["whole"], min(4.0, r["odds"] / 2)) for r in known)
    stems = {t for t, whole, _ in learned if not whole}
    keep = [x for x in learned if x[1] or not any(x[0][:n] in stems for n in STEMS if n < len(x[0]))]  # shortest stems
    grammar = Grammar(keep)
    weights = weigh(labelled, grammar).join(labelled.select("doc_id", "toxic"), "doc_id").toPandas().sort_values("doc_id")
    grammar.fit_link(weights[["heaviest", "total", "density"]].to_numpy(), weights["toxic"].to_numpy(float))
    return grammar


def weigh(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, heaviest, total, density, score) for every row of (doc_id, text)."""

    def run(batches):
        for b in batches:
            for start, texts in slices(b):
                w = grammar.weigh(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), *(pa.array(w[:, k]) for k in range(3)), pa.array(grammar.probability(w))], names=["doc_id", "heaviest", "total", "density", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, heaviest double, total double, density double, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column, *, fit_rows: int = 12_000) -> DataFrame:
    """Learn from the labels' rows where ``train`` holds, score all of ``docs``: (doc_id, heaviest, total, density, score)."""
    ids = labels.where(train & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null")
    sample = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # an id counts once
    sample = stage(sample)
    grammar = learn_grammar(sample)
    drop_staged(sample)
    return weigh(docs, grammar)

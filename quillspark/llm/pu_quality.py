"""Quality classifier by positive-unlabelled learning (operator 2).

Trusted positives and unlabelled web text are all it is fitted on.  The class
prior is estimated from a positives-against-unlabelled score by the best-bin
mixture bound; a small network then minimises the non-negative unbiased risk
``pi * R_p+  +  max(0, R_u-  -  pi * R_p-)``.  Inputs are style statistics of
the whole text; ids, languages, sources and labels are never inputs.

At most ``fit_rows`` positives are used, by hash order of the id.  The features of
all unlabelled rows are staged once; the prior is counted over all of them.  The
network begins from a fit on ``fit_rows`` of them and is then moved by ``rounds``
steps of Adam on the risk of all: each round is one pass over the staged
features that returns sums of the loss and of its gradient, so the driver holds
the positives' features, the first sample's, and one number for each weight.
Scoring is one Arrow pass over all rows without a shuffle.

Defined cases: null and empty texts get the score of an all-zero feature row;
very long texts are read whole; repeated rows score alike, and an id that
repeats counts once in the fit and the prior; null ids take no part in them;
without positives or without unlabelled rows the model is constant at the prior
0.5; rows that tie at a threshold reach it; other columns, whatever their names,
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, slices, stage, words_of

_CLASS = np.full(256, 5, np.uint8)  # 5: other symbols
for _i in range(256):
    if chr(_i) in "abcdefghijklmnopqrstuvwxyz":
        _CLASS[_i] = 0
    elif chr(_i) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        _CLASS[_i] = 1
    elif chr(_i) in "0123456789":
        _CLASS[_i] = 2
    elif _i in (9, 11, 12, 13, 32):
        _CLASS[_i] = 3
    elif _i == 10:
        _CLASS[_i] = 4
    elif chr(_i) in ".,;:'\"()-?":
        _CLASS[_i] = 6
    elif chr(_i) == "!":
        _CLASS[_i] = 7
    elif chr(_i) == "|":
        _CLASS[_i] = 8
    elif _i >= 128:
        _CLASS[_i] = 9
FEATURES = 20


def style_features(texts: list[bytes]) -> np.ndarray:
    """FEATURES statistics for each text, all vectorised over the slice."""
    n = len(texts)
    buf, starts, ends, at, h = words_of(texts)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    of = np.repeat(np.arange(n), lens + 1)
    per = np.bincount(of * 10 + _CLASS[raw], minlength=n * 10).reshape(n, 10).astype(float)
    per[:, 4] -= 1  # the separator
    chars = np.maximum(lens, 1)
    words = np.bincount(at, minlength=n).astype(float)
    some = np.maximum(words, 1)
    size = (ends - starts).astype(float)
    mean = np.bincount(at, size, n) / some
    var = np.bincount(at, size**2, n) / some - mean**2
    key = h ^ (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    uniq, first, counts = np.unique(key, return_index=True, return_counts=True)
    distinct = np.bincount(at[first], minlength=n) / some
    top = np.zeros(n)
    np.maximum.at(top, at[first], counts)
    same = np.flatnonzero((h[1:] == h[:-1]) & (at[1:] == at[:-1])) + 1
    tail = _CLASS[raw[np.maximum(ends - 1, 0)]] if len(ends) else np.zeros(0, np.uint8)
    odd = np.bincount(at[np.isin(tail, (5, 7, 8))], minlength=n) / some
    shout = np.bincount(at[_CLASS[raw[starts]] == 1], minlength=n) / some if len(starts) else np.zeros(n)
    short = np.bincount(at[size <= 3], minlength=n) / some
    letters = np.maximum(per[:, 0] + per[:, 1], 1)
    lines = per[:, 4] + 1
    cols = [
        np.log1p(words), np.log1p(lens), mean / 10, np.sqrt(np.maximum(var, 0)) / 5, distinct, top / some, np.bincount(at[same], minlength=n) / some, odd, shout, short,
        per[:, 1] / letters, per[:, 2] / chars, per[:, 3] / chars, lines / some, per[:, 5] / some, per[:, 6] / some, per[:, 7] / some, per[:, 8] / some, per[:, 9] / chars, (lens == 0).astype(float),
    ]
    return np.column_stack(cols)


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, f array<double>) of (doc_id, text)."""

    def run(batches):
        for b in batches:
            for start, texts in slices(b):
                f = style_features(texts)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, FEATURES), pa.int32()), pa.array(f.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), flat], names=["doc_id", "f"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, f array<double>")


class Net:
    """One hidden layer of tanh units, trained by Adam on the non-negative PU risk with the logistic loss."""

    def __init__(self, width: int, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.mean, self.sd, self.rng = np.zeros(width), np.ones(width), rng

    def _forward(self, x):
        a = np.tanh(x @ self.p[0] + self.p[1])
        return a, a @ self.p[2] + self.p[3][0]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -8, 8)

    def gradient(self, x: np.ndarray, a: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        """By each weight, where ``g`` is the gradient by each row's logit and ``a`` its hidden units."""
        d = np.outer(g, self.p[2]) * (1 - a * a)
        return [x.T @ d, d.sum(0), a.T @ g, np.array([g.sum()])]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._forward(self.scaled(x))[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))

    def fit(self, pos: np.ndarray, unl: np.ndarray, prior: float | None, epochs: int = 40, batch: int = 512, rate: float = 0.01):
        """``prior`` None: plain positives-against-unlabelled training, for the prior estimate."""
        both = np.vstack((pos, unl))
        self.mean, self.sd = both.mean(0), both.std(0) + 1e-6
        pos, unl = self.scaled(pos), self.scaled(unl)
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        steps = max(1, max(len(pos), len(unl)) // batch)
        for epoch in range(epochs):
            for _ in range(steps):
                xp, xu = pos[self.rng.integers(0, len(pos), batch)], unl[self.rng.integers(0, len(unl), batch)]
                (ap, zp), (au, zu) = self._forward(xp), self._forward(xu)
                sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
                if prior is None:
                    gp, gu = (sp - 1) / batch, su / batch
                else:
                    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                    if negative >= 0:
                        gp, gu = prior * ((sp - 1) - sp) / batch, su / batch
                    else:  # step back from a negative risk of the negatives
                        gp, gu = prior * sp / batch, -su / batch
                grads = [x + y for x, y in zip(self.gradient(xp, ap, gp), self.gradient(xu, au, gu), strict=True)]
                t += 1
                for i, g in enumerate(grads):
                    g = g + 1e-4 * self.p[i] * (i in (0, 2))
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - rate * 0.95**epoch * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self


class PriorScore:
    """A positives-against-unlabelled score, and thresholds from held-back positives, to estimate the class prior with."""

    def __init__(self, pos: np.ndarray, unl: np.ndarray):
        self.net = Net(pos.shape[1], seed=11).fit(pos[::2], unl, None, epochs=10)
        p = np.sort(self.net.logit(pos[1::2]))
        self.n = len(p)
        self.at = np.quantile(p, np.linspace(0, 0.9, 46)) if self.n else np.zeros(0)
        self.tail = 1 - np.searchsorted(p, self.at) / max(1, self.n)

    def above(self, x: np.ndarray) -> np.ndarray:
        """How many thresholds each row reaches."""
        return np.searchsorted(self.at, self.net.logit(x), "right")

    def prior(self, counts: dict[int, int]) -> float:
        """Share of positives, given how many unlabelled rows reach how many thresholds.

        It is the least ratio of upper tails, unlabelled to positive, with its
        confidence slack.
        """
        total = sum(counts.values())
        if not self.n or not total:
            return 0.5
        reach = np.array([sum(n for k, n in counts.items() if k > i) for i in range(len(self.at))]) / total
        slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(self.n) + 1 / np.sqrt(total))
        best = int(((reach + slack) / self.tail).argmin())
        return float(np.clip(reach[best] / self.tail[best], 0.05, 0.99))


def unlabelled_features(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, f) of all ``ids``, staged; an id counts once, with the least of its feature rows."""
    return stage(feature_rows(docs).join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("f").alias("f")))


def _features(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, FEATURES)


def count_above(features: DataFrame, score: PriorScore) -> dict[int, int]:
    """Of all rows of (doc_id, f), how many reach how many thresholds."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(score.above(_features(b.column(0))), pa.int32())], names=["above"])

    rows = features.select("f").mapInArrow(run, "above int")
    return {r["above"]: r["n"] for r in rows.groupBy("above").agg(F.count("*").alias("n")).collect()}


def risk_sums(features: DataFrame, net: Net) -> tuple[int, float, list[np.ndarray]]:
    """Over all unlabelled rows: their number, the sum of the loss as negatives, and its gradient by each weight.

    Tasks return a row for each weight; sums are of decimals, so they don't depend on the order of the tasks.
    """

    def run(batches):
        n, loss, total = 0, 0.0, [np.zeros_like(p) for p in net.p]
        for b in batches:
            x = net.scaled(_features(b.column(0)))
            a, z = net._forward(x)
            n, loss = n + len(x), loss + float(np.logaddexp(0, z).sum())
            total = [t + g for t, g in zip(total, net.gradient(x, a, 1 / (1 + np.exp(-np.clip(z, -30, 30)))), strict=True)]
        flat = np.concatenate([[n, loss], *(t.ravel() for t in total)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "value"])

    rows = features.select("f").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,12)")).alias("v")).collect()
    flat = np.zeros(2 + sum(p.size for p in net.p))
    for r in rows:
        flat[r["at"]] = float(r["v"])
    cuts = np.cumsum([2, *(p.size for p in net.p)])
    return int(flat[0]), float(flat[1]), [flat[a:b].reshape(p.shape) for a, b, p in zip(cuts[:-1], cuts[1:], net.p, strict=True)]


def refine(net: Net, pos: np.ndarray, features: DataFrame, prior: float, rounds: int, rate: float = 0.002) -> Net:
    """Steps of Adam on the non-negative risk with the unlabelled part over all rows."""
    x = net.scaled(pos)
    m, v = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p]
    for t in range(1, rounds + 1):
        n, loss, unl = risk_sums(features, net)
        a, z = net._forward(x)
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if loss / n - prior * np.logaddexp(0, z).mean() >= 0:
            own, sign = prior * ((s - 1) - s) / len(x), 1
        else:  # step back from a negative risk of the negatives
            own, sign = prior * s / len(x), -1
        for i, (g, u) in enumerate(zip(net.gradient(x, a, own), unl, strict=True)):
            g = g + sign * u / n + 1e-4 * net.p[i] * (i in (0, 2))
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            net.p[i] = net.p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return net


def fit_quality(docs: DataFrame, positives: DataFrame, unlabelled: DataFrame, *, fit_rows: int = 12_000, rounds: int = 12) -> tuple[Net | None, float]:
    """Fit on at most ``fit_rows`` ids of positives (doc_id) and on all unlabelled ids; returns the network and the prior."""
    first = lambda rows: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    features = unlabelled_features(docs, unlabelled)
    picked = docs.select("doc_id", "text").join(F.broadcast(first(positives)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # an id counts once
    pos, unl = (np.vstack(f) if len(f := rows.select("f").toPandas()["f"]) else np.zeros((0, FEATURES)) for rows in (feature_rows(picked), first(features)))
    if not len(pos) or not len(unl):
        drop_staged(features)
        return None, 0.5
    shuffled = lambda f, seed: f[np.lexsort(f.T)][np.random.default_rng(seed).permutation(len(f))]  # noqa: E731  the same fit whatever order the rows arrive in
    pos, unl = shuffled(pos, 3), shuffled(unl, 4)
    score = PriorScore(pos, unl)
    prior = score.prior(count_above(features, score))
    net = refine(Net(FEATURES).fit(pos, unl, prior), pos, features, prior, rounds)
    drop_staged(features)
    return net, prior


def score_quality(docs: DataFrame, net: Net | None, prior: float) -> DataFrame:
    """(doc_id, score) for every row of (doc_id, text)."""

    def run(batches):
        for b in batches:
            for start, texts in slices(b):
                s = net.score(style_features(texts)) if net is not None else np.full(len(texts), prior)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(s)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def pu_quality(docs: DataFrame, labels: DataFrame, train: Column, *, fit_rows: int = 12_000) -> DataFrame:
    """Fit on the labels' rows where ``train`` holds, score all of ``docs``: (doc_id, score)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    positives = labels.where(train & (F.col("quality") == 1)).select("doc_id").distinct()
    unlabelled = docs.select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti").distinct()
    return score_quality(rows, *fit_quality(rows, positives, unlabelled, fit_rows=fit_rows))

"""Phrases, languages and vector codes: brute force, held-out accuracy, and nulls, ties, repeated rows, long texts, empty tables, clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import collocations as C
from quillspark.llm import language_id as L
from quillspark.llm import queries as Q
from quillspark.llm import vector_codes as V

from ..conftest import SF

RNG = random.Random(5)


# --- phrases ---------------------------------------------------------------------


def brute_phrases(rows, words=3, least=10, inside=50, top=2000):
    f = collections.defaultdict(collections.Counter)
    n = collections.Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, words + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        got = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            got.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(got)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def phrase_texts():
    vocabulary = ["Alpha", "beta", "GAMMA", "é", "x", "y", "zeta z", "a'b"]
    text = lambda n: "".join(RNG.choice(vocabulary) + RNG.choice([" ", " ", " ", "\t", ", ", "\n", "  ", ".\r\n"]) for _ in range(n))
    rows = [(RNG.choice(["en", "de", None, "und"]), text(RNG.randint(0, 60))) for _ in range(120)]
    return rows + [("en", "hot pair " * 400), ("en", "hot pair " * 400), ("fr", None), ("fr", ""), ("it", " \t\n.,"), (None, "x x x x x x x x x x x x"), ("en", "e" * 3000 + " f")]


@pytest.mark.parametrize("shard", [1 << 22, 300])
@pytest.mark.parametrize(("words", "least", "top"), [(3, 10, 2000), (4, 3, 7), (2, 10, 3)])
def test_collocations(spark, monkeypatch, shard, words, least, top):
    monkeypatch.setattr(C, "SHARD_BYTES", shard)
    rows = phrase_texts()
    docs = spark.createDataFrame([(i, lang, text, "c", 1) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int").repartition(3)
    got = C.collocations(docs, words=words, least=least, top=top)
    assert {tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == brute_phrases(rows, words, least, 50, top)


def test_shards_of_long_texts():
    text = b"ab cd. " * 90 + b"q" * 700 + b" r, s"
    assert b"".join(C._cuts(text)) == text
    old, C.SHARD_BYTES = C.SHARD_BYTES, 100
    try:
        pieces = list(C._cuts(text))
    finally:
        C.SHARD_BYTES = old
    assert b"".join(pieces) == text and len(pieces) > 5
    assert all(p[-1:] in b".,"  for p in pieces[:-1])


def test_suffix_order():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 60))
        rank, piece = rng.integers(1, 4, n), np.cumsum(rng.random(n) < 0.2)
        room = C.rooms(piece)
        order = C.suffix_order(rank, room, 4)
        suffix = lambda i, k: tuple(rank[i : i + min(k, room[i])])  # noqa: B023, E731
        assert [suffix(i, 4) for i in order] == sorted(suffix(i, 4) for i in range(n))
        shared = C.common_prefixes(order, rank, room, 3)
        for (a, b), s in zip(itertools.pairwise(order), shared[1:], strict=True):
            assert s == sum(1 for k in range(1, 4) if len(suffix(a, k)) == k and suffix(a, k) == suffix(b, k))


def test_keys_of_buckets():
    """Every frequent phrase sets its bit: packed keys come back, whatever the number of buckets."""
    rows = [C.pa.RecordBatch.from_pydict({"group": ["g"] * 12, "text": [f"common words here {i} {i * 7}" for i in range(12)]})]
    for buckets in (1, 3, 1000, 1 << 17):
        got = sorted((r for b in C._hashed(3, buckets)(rows) for r in b.to_pylist()), key=lambda r: r["bucket"])
        order = C._slots(buckets)[0]
        got = C.pa.RecordBatch.from_pylist(sorted(got, key=lambda r: (r["bucket"] % order, r["bucket"])))
        table = C.bit_table([r for b in C._frequent(12, buckets)([got]) for r in b.to_pylist()], buckets)
        assert np.unpackbits(table).sum() == 6  # 3 words, 2 pairs, 1 triple


# --- languages -------------------------------------------------------------------


def test_best_path():
    rng = np.random.default_rng(3)
    for n, k in [(1, 1), (1, 3), (5, 2), (7, 3), (30, 2)]:
        score = rng.integers(0, 5, (n, k)).astype(float) if n < 8 else rng.random((n, k))
        opens = np.concatenate(([True], rng.random(n - 1) < 0.25))
        cost = lambda p: sum(score[i, s] for i, s in enumerate(p)) - sum(1.5 for i in range(1, n) if p[i] != p[i - 1] and not opens[i])  # noqa: B023, E731
        path = L.best_path(score, opens, 1.5)
        if n < 8:
            assert math.isclose(cost(path), max(cost(p) for p in itertools.product(range(k), repeat=n)))
        else:
            v = score[0].copy()
            for i in range(1, n):
                v = score[i] + np.maximum(v, v.max() - (0 if opens[i] else 1.5))
            assert math.isclose(cost(path), v.max())


WORDS = {"aa": ["tha", "thing", "whethe"], "bb": ["schei", "zung", "über"], "ru": ["привет", "мир"], "zh": ["你好世界"]}


def test_language_spans(spark):
    say = lambda lang, n: " ".join(RNG.choice(WORDS[lang]) for _ in range(n))
    rows = [(i, say(lang, 30), lang) for i, lang in enumerate(list(WORDS) * 10)]
    mixed = say("aa", 20) + ". " + say("bb", 20)
    odd = [(100, None, "aa"), (101, "", "aa"), (102, " 12 3!", "bb"), (103, mixed, "aa"), (103, mixed, "aa"), (None, "привет", None), (105, say("bb", 90_000), "zz"), (106, "Ελλάδα", None)]
    docs = spark.createDataFrame([(*r, "c", 0.5) for r in rows + odd], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    got = L.identify_languages(docs, F.col("doc_id") < 100).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == lang and by[i]["score"] == 1 for i, _, lang in rows)
    assert all((by[i]["lang_pred"], by[i]["score"], by[i]["spans"]) == ("und", 0, []) for i in (100, 101, 102))
    cut = mixed.index(".")
    assert [tuple(s) for s in by[103]["spans"]] == [(0, cut, "aa"), (cut + 2, len(mixed), "bb")]
    assert 0.4 < by[103]["score"] < 1
    assert by[None]["lang_pred"] == "ru" and by[105]["lang_pred"] == "bb" and by[105]["spans"] == [(0, len(odd[6][1]), "bb")]
    assert by[106]["lang_pred"] in WORDS  # no language has the script: all stay
    empty = L.identify_languages(docs.limit(0), F.lit(True))
    assert empty.count() == 0
    assert {r["lang_pred"] for r in L.identify_languages(docs, F.lit(False)).collect()} == {"und"}


def test_scripts_part_words():
    """Each run of letters of one script is a word; marks stay with the letter before them; offsets are code points."""
    text = "ab́c привет你好x-1y\U0001f600z"
    w = L.words_of_slice([b"", text.encode(), text.encode()])
    half = len(w.text) // 2
    assert list(w.text) == [1] * half + [2] * half
    assert [text[a:b] for a, b in zip(w.start[:half], w.end[:half], strict=True)] == ["ab́c", "привет", "你好", "x", "y", "z"]
    assert [L.NAMES[s] for s in w.script[:half]] == ["latin", "cyrillic", "han", "latin", "latin", "latin"]


def test_windows(monkeypatch):
    monkeypatch.setattr(L, "SLICE_BYTES", 64)
    for text in ("wörter und mehr " * 40, "ü" * 300, "abc"):
        parts = list(L.windows(text.encode()))
        assert b"".join(parts).decode() == text and all(p.decode() for p in parts)
        w = L.words_of_slice([text.encode(), b"z"])
        whole = [m.span() for m in re.finditer(r"\w+", text)]
        if " " in text:
            assert list(zip(w.start[w.text == 0].tolist(), w.end[w.text == 0].tolist(), strict=True)) == whole


def test_held_out_languages(spark):
    got = Q.op12_language_spans(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) > 20 and (got.lang == got.lang_pred).mean() >= 0.97


# --- codes -----------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds, scale):
    ok = [(i, lab, [math.floor(scale * x) for x in e]) for i, lab, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(ok[0][2]) // parts
    cut = [[e[p * width : (p + 1) * width] for p in range(parts)] for _, _, e in ok]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            sums = collections.defaultdict(list)
            for c in cut:
                sums[near(c[p], books[p])[1]].append(c[p])
            for k, xs in sums.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, by_label = [], collections.Counter()
    for (i, lab, _), c in zip(ok, cut, strict=True):
        got = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got)))
        by_label[lab] += out[-1][-1]
    return sorted(((i, code, e, by_label[lab], digest) for i, lab, code, e in out), key=str)


@pytest.mark.parametrize(("n", "step"), [(400, 0.01), (300, 0.5), (40, 0.1)])
def test_vector_codes(spark, n, step):
    """Against every distance; coarse components make many ties, few rows make few entries."""
    rng = np.random.default_rng(n)
    rows = [(i * 3 - 50, [None, 1, 2][i % 3], (np.round(rng.normal(size=16) * 0.3 / step) * step).tolist()) for i in range(n)]
    rows += [(1000, 1, None), (1001, 1, [None, *rows[0][2][1:]]), (1002, 2, [float("nan"), *rows[0][2][1:]]), (1003, 2, [float("inf"), *rows[0][2][1:]]), (None, 2, rows[4][2]), (rows[9][0], 1, rows[9][2]), (rows[9][0], 1, rows[8][2])]
    df = spark.createDataFrame([(*r, "c", 7) for r in rows], "vec_id long, label int, embedding array<double>, code string, error int").repartition(3)
    got = V.vector_codes(df, parts=4, entries=64)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_codes(rows, 4, 64, 2, 256)


def test_bounds_save_scans_and_keep_ties():
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 40, (3000, 4))
    x[:1500] += np.repeat(np.array([[0] * 4, [300] * 4, [900] * 4]), 500, 0)
    book = x[[5, 600, 1100, 2000, 2500]]
    every = lambda b: np.stack([V.squared(x, c) for c in b], 1)
    code, up, low, scanned = V.assign_part(x, book, np.zeros(len(x), np.uint16), np.full(len(x), np.inf, np.float32), np.full(len(x), -np.inf, np.float32))
    assert (code == every(book).argmin(1)).all()
    for shift in (0, 1, 5):
        new = book + rng.integers(-shift, shift + 1, book.shape)
        way, rest = V.moved(book, new)
        u, lo = V._up(up + way[code]), V._down(low - rest[code])
        d = np.sqrt(every(new).astype(float))
        own = d[np.arange(len(x)), code]
        d[np.arange(len(x)), code] = np.inf
        assert (u >= own).all() and (lo <= d.min(1)).all()
        got, _, _, again = V.assign_part(x, new, code, u, lo)
        assert (got == every(new).argmin(1)).all() and again < len(x)
    same = np.array([[3, 3], [3, 3], [5, 5]])  # equal entries: the lower index
    code, *_ = V.assign_part(np.array([[3, 3], [4, 4], [9, 9]]), same, np.array([1, 2, 2], np.uint16), np.full(3, np.inf, np.float32), np.full(3, -np.inf, np.float32))
    assert code.tolist() == [0, 0, 2]


def test_vector_code_cases(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert V.vector_codes(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        V.vector_codes(spark.createDataFrame([(1, [1.0] * 17, 1)], schema))
    other = spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], schema)
    assert [r["vec_id"] for r in V.vector_codes(other).collect()] == [1]
    bare = V.vector_codes(spark.createDataFrame([(1, [], 1), (2, [], None)], schema)).collect()
    assert {(r["code"], r["error"], r["label_error"]) for r in bare} == {("00" * 16, 0, 0)}
    with pytest.raises(Exception, match="passes"):
        V.vector_codes(spark.createDataFrame([(1, [1e30] + [0.0] * 15, 1)], schema))


@pytest.mark.parametrize("name", ["op11_collocations", "op13_hamerly_codes"])
def test_new_sql(spark, duck, name):
    from ..test_queries import plain

    got, want = Q.queries()[name](spark, SF).toPandas(), duck.sql(Q.ORACLE[name]).df()
    cols = sorted(got.columns)
    rows = lambda d: sorted(tuple(plain(v) for v in r) for r in d[cols].itertuples(index=False))
    assert cols == sorted(want.columns) and rows(got) == rows(want)

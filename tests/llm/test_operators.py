"""The operators on small tables: brute force, and nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import queries as Q
from quillspark.llm.decontam import contamination
from quillspark.llm.embed_join import near_vectors
from quillspark.llm.line_runs import line_run_dedup
from quillspark.llm.ngram_join import ngram_join
from quillspark.llm.packing import pack
from quillspark.llm.pu_quality import pu_quality
from quillspark.llm.secrets import base_spans, scan_secrets
from quillspark.llm.suffix_dedup import suffix_dedup
from quillspark.llm.toxicity import score_toxicity
from quillspark.llm.url_templates import url_template_filter

from ..conftest import SF

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


BASE = prose(120)
LINE = prose(25)
TEXTS = [
    None, "", " \n\t", "one", "two words here", BASE, BASE, BASE.replace(" a", " b", 1), BASE + " tail", BASE + "\n" + LINE, LINE + "\n" + prose(40) + "\n" + LINE, LINE,
    prose(90), ("rep eat " * 400).strip(), prose(6000), "é" * 90 + "x" * 150, "x" * 300, "\n".join([LINE, prose(30), LINE, prose(30)]),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "clash", i, 0, "c") for i, t in enumerate(TEXTS)] + [(15, TEXTS[5], "again", 1, 0, "c"), (None, BASE, "n", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, n_removed int, score int, id string").repartition(3)


def plain_rows(df):
    return {r["doc_id"]: (r["text"] or "") for r in df.collect() if r["doc_id"] is not None}


def groups(items, linked):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


@pytest.mark.parametrize("words,num", [(4, 85), (5, 80)])
def test_ngram_join(docs, words, num):
    texts = plain_rows(docs)
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    want = groups(list(sets), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]))
    got = ngram_join(docs, words=words, num=num, tile_rows=2).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])


def test_suffix_dedup(docs):
    seen, want = set(), {}
    for i, t in sorted(plain_rows(docs).items()):
        b = t.encode()
        dead = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                dead[k : k + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~dead])
        want[i] = (len(b), int(dead.sum()), int((np.diff(np.concatenate(([0], dead.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = suffix_dedup(docs).drop("kept").collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert tuple(r)[1:] == want[r["doc_id"]]


def brute_suffixes(rows, length=100):
    """(n_bytes, n_removed, n_spans) of (order, text) rows; rows of equal order are one document."""
    seen, out = {}, []
    for order, t in sorted(rows):
        b = t.encode()
        dead = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            first = seen.setdefault(b[k : k + length], (order, k))
            if first < (order, k):
                dead[k : k + length] = True
        out.append((order, (len(b), int(dead.sum()), int((np.diff(np.concatenate(([0], dead.astype(int)))) == 1).sum()))))
    return out


@pytest.mark.parametrize("hot,gather,remember", [((2, 10**6), 4, 3), ((1, 2), 10, 1)])
def test_suffix_dedup_bounds(docs, hot, gather, remember):
    """Bands of 8 and of 1 offsets, small gatherings and a short memory change no result."""
    want = dict(brute_suffixes(plain_rows(docs).items()))
    for r in suffix_dedup(docs, hot=hot, gather=gather, remember=remember).collect():
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == want[r["doc_id"]]


@pytest.fixture(scope="module")
def repeated(spark):
    """Ids that repeat with other texts, and 40 near copies of one text (a frequent key of the slice)."""
    a, b, c = prose(60), prose(60) + "\n" + LINE, prose(45) + "\n" + prose(20)
    near = [(200 + i, "\n".join([a, LINE, f"copy {i}"])) for i in range(40)]
    return [(1, a), (7, a + " x"), (7, b), (7, b), (2, b + " y"), (9, c), (9, None), (9, ""), (8, c + " z"), (3, LINE + "\n" + LINE), (3, LINE), *near]


def test_repeated_ids(spark, repeated):
    df = spark.createDataFrame(repeated, "doc_id long, text string").repartition(3)
    order = {(r["doc_id"], r["text"]): (r["doc_id"], r["v"]) for r in df.select("*", F.xxhash64("text").alias("v")).collect()}
    # op6: an id carries the links of all of its texts
    sets = collections.defaultdict(list)
    for i, t in repeated:
        w = (t or "").encode().lower().split()
        sets[i].append({tuple(w[k : k + 4]) for k in range(len(w) - 3)})
    want = groups(list(sets), lambda p, q: any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[p] for y in sets[q]))
    got = ngram_join(df, words=4, num=80).collect()
    assert len(got) == len(repeated) and all(r["component_id"] == want[r["doc_id"]] for r in got)
    # op7: texts of one id are documents of their own, in the order of their hash
    brute = dict(brute_suffixes((order[x], x[1] or "") for x in repeated))
    got = suffix_dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()
    assert sorted(map(tuple, got)) == sorted((x[0], *brute[order[x]]) for x in repeated)
    # op8: likewise
    lines = {order[x]: (x[1] or "").split("\n") for x in repeated}
    first, dead = collections.defaultdict(list), {}
    for d in sorted(lines):
        dead[d] = [False] * len(lines[d])
        for at, x in enumerate(lines[d]):
            for j, k in first[x]:
                n = 0
                while at + n < len(lines[d]) and k + n < len(lines[j]) and lines[d][at + n] == lines[j][k + n]:
                    n += 1
                if sum(len(y.split()) for y in lines[d][at : at + n]) >= 20:
                    dead[d][at : at + n] = [True] * n
            first[x].append((d, at))
    got = line_run_dedup(df, min_words=20).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got)) == sorted((x[0], sum(dead[order[x]]) if x[1] else 0) for x in repeated)


def test_line_runs(docs):
    least, first, dead = 20, collections.defaultdict(list), {}
    lines = {i: [x.strip() for x in t.split("\n")] if t else [] for i, t in plain_rows(docs).items()}
    for i in sorted(lines):
        dead[i] = [False] * len(lines[i])
        for a, x in enumerate(lines[i]):
            for j, b in first[x]:
                k = 0
                while a + k < len(lines[i]) and b + k < len(lines[j]) and lines[i][a + k] == lines[j][b + k]:
                    k += 1
                if sum(len(y.split()) for y in lines[i][a : a + k]) >= least:
                    dead[i][a : a + k] = [True] * k
            first[x].append((i, a))
    out = line_run_dedup(docs.drop("n_removed"), min_words=least)
    assert set(out.columns) >= set(docs.columns)
    for r in out.collect():
        if r["doc_id"] is not None:
            assert r["n_removed"] == sum(dead[r["doc_id"]])
            assert (r["text"] or "") == "\n".join(x for x, d in zip(plain_rows(docs)[r["doc_id"]].split("\n"), dead[r["doc_id"]] or [False], strict=False) if not d)


def test_secrets(docs, spark):
    texts = ["é token: abcdefghijklmnop1", None, "", "AKIA" + "A" * 14 + " deadbeefdeadbeef", "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan_secrets(df).collect():
        base = sorted(base_spans(texts[r["doc_id"]] or ""), key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))
        plain = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base"] == plain and r["base_sha256"] == hashlib.sha256(plain.encode()).hexdigest() and set(plain.split(",")) <= set(r["spans"].split(","))
        assert r["n_assign"] == sum(k == "assign" for k, *_ in base)
    assert scan_secrets(docs).count() == docs.count()


def brute_base(text):
    """The contract's base spans, read letter by letter."""
    key = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)

    def run(at, chars):
        while at < len(text) and text[at] in chars:
            at += 1
        return at

    out, i = [], 0
    while i < len(text):
        name = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if fold.startswith(w, i)), None)
        if name:
            j = i + len(name)
            j = run(j + (text[j : j + 1] in ("'", '"')), " ")
            if text[j : j + 1] in (":", "="):
                j = run(j + 1, " ")
                j += text[j : j + 1] in ("'", '"')
                z = run(j, key)
                if z > j:
                    out += [("assign", i, z)] if z - j >= 12 else []
                    i = z
                    continue
        i += 1
    for kind, start, chars, least in (("access", "AKIA", key[:26] + "0123456789", 18), ("hex", "", "0123456789abcdef", 16)):
        i = 0
        while i < len(text):
            z = run(i + len(start), chars) if text.startswith(start, i) else i
            out += [(kind, i, z)] if z - i >= least else []
            i = max(i + 1, z if z > i + len(start) else 0)
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_secrets_against_letters(spark):
    rng = random.Random(5)
    bits = ["password", "PASSWD", "Secret", "token", "api_key", "ApiKey", "é", "ſecret", " ", "  ", ":", "=", "'", '"', "\n", "\t", "AKIA", "AKIAIOSFODNN7EXAM", "PLE", "deadbeef", "0123456789", "abc", "Zx9Q/w+3", "-", ".", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [",".join(f"{k}:{a}:{b}" for k, a, b in brute_base(t)) for t in texts]
    got = scan_secrets(df).orderBy("doc_id").collect()
    assert [r["base"] for r in got] == want and sum(map(bool, want)) > 500
    assert {k: sum(r["n_" + k] for r in got) for k in ("assign", "access", "hex")} == {k: sum(w.count(k + ":") for w in want) for k in ("assign", "access", "hex")}


def test_prior_counts_all_unlabelled(spark):
    """With ``fit_rows`` below the number of rows, the thresholds are still counted over every unlabelled id, once each."""
    from quillspark.llm import pu_quality as PU

    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice("AB!|") * rng.randint(1, 9) for _ in range(60))
    rows = [(i, good()) for i in range(120)] + [(i, good() if i % 4 == 0 else bad()) for i in range(120, 520)]
    df = spark.createDataFrame([*rows, rows[200], (None, bad())], "doc_id long, text string").repartition(3)
    pos, unl = PU.style_features([t.encode() for _, t in rows[:120]]), PU.style_features([t.encode() for _, t in rows[120:]])
    score = PU.PriorScore(pos, unl[:50])
    ids = df.where("doc_id >= 120").select("doc_id").distinct()
    features = PU.unlabelled_features(df, ids)
    got = PU.count_above(features, score)
    assert got == dict(collections.Counter(score.above(unl).tolist()))
    assert abs(score.prior(got) - 0.25) < 0.1
    n, loss, gradient = PU.risk_sums(features, score.net)
    x = score.net.scaled(unl)
    a, z = score.net._forward(x)
    assert n == len(unl) and abs(loss - np.logaddexp(0, z).sum()) < 1e-6
    for g, p in zip(gradient, score.net.p, strict=True):  # against differences of the loss itself, at some weights
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 7)]:
            old, h = p[at], 1e-5
            both = []
            for step in (h, -h):
                p[at] = old + step
                both.append(np.logaddexp(0, score.net._forward(x)[1]).sum())
            p[at] = old
            assert abs(g[at] - (both[0] - both[1]) / (2 * h)) < 1e-2 * max(1, abs(g[at]))


def test_risk_reaches_rows_beyond_the_sample(spark):
    """Two tables whose first ``fit_rows`` unlabelled rows are alike: what lies behind them changes the network."""
    from quillspark.llm import pu_quality as PU

    rng = random.Random(9)
    text = lambda letters, n=40: " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(n))
    pos, unl = [(i, text("abc") + ".") for i in range(30)], [(i, text("abcdef!")) for i in range(100, 180)]
    order = [r["doc_id"] for r in spark.createDataFrame([(i,) for i, _ in unl], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    last = set(order[20:])
    other = [(i, text("XY|", 9) if i in last else t) for i, t in unl]
    ids = lambda rows: spark.createDataFrame([(i,) for i, _ in rows], "doc_id long")
    nets = [PU.fit_quality(spark.createDataFrame(pos + rows, "doc_id long, text string"), ids(pos), ids(rows), fit_rows=20, rounds=3)[0] for rows in (unl, other)]
    start = [PU.fit_quality(spark.createDataFrame(pos + rows, "doc_id long, text string"), ids(pos), ids(rows), fit_rows=20, rounds=0) for rows in (unl, other)]
    assert abs(nets[0].p[2] - nets[1].p[2]).max() > 1e-4 and start[0][0].mean.tolist() == start[1][0].mean.tolist()


def test_contamination(docs, spark):
    text = plain_rows(docs)[42][:400]
    items = spark.createDataFrame([(1, BASE[40:200]), (2, None), (3, "zq short"), (4, text[50:250].upper()), (5, BASE[40:200]), (6, prose(40))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in contamination(docs, items, block_chars=300).collect()}
    holders = {i for i, t in plain_rows(docs).items() if BASE[60:190] in t} | {None}
    assert {i for i, k in got if k == 1} == {i for i, k in got if k == 5} and {i for i, k in got if k == 1} >= holders
    assert got[42, 4] == 0 and not {k for _, k in got} & {2, 3, 6}
    assert contamination(docs, items.limit(0)).count() == 0


def test_contamination_against_all_distances(docs, spark):
    """Every item within its budget of some stretch of a text, by the full table of edit distances."""
    rng = random.Random(8)
    texts = {i: t for i, t in plain_rows(docs).items() if 0 < len(t) < 1500}
    items = {}
    for k in range(30):
        t = texts[rng.choice(sorted(texts))]
        n = rng.randint(1, 120)
        a = rng.randrange(max(1, len(t) - n))
        item = list(t[a : a + n].strip())
        for _ in range(rng.randint(0, max(1, len(item) // 8)) if item else 0):
            at = rng.randrange(len(item))
            item[at : at + 1] = rng.choice(([], ["z"], [item[at], "q"]))
            if not item:
                break
        items[k] = "".join(item)

    def distance(p, t):
        row = np.arange(len(p) + 1)
        best, steps = len(p), np.arange(len(p) + 1)
        for c in t:
            cost = np.minimum(row[1:] + 1, row[:-1] + (np.array(list(p)) != c))
            row = np.minimum.accumulate(np.concatenate(([0], cost)) - steps) + steps
            best = min(best, int(row[-1]))
        return best

    clean = lambda s: s.lower().replace("\n", " ").replace("\t", " ")
    want = {}
    for k, p in items.items():
        if p := clean(p).strip():
            for i, t in texts.items():
                if (d := distance(p, clean(t))) <= int(0.08 * len(p)):
                    want[i, k] = d
    df = docs.where(F.col("doc_id").isin(*texts))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in contamination(df, spark.createDataFrame(list(items.items()), "item_id long, text string"), block_chars=400).collect()}
    assert got == want


def test_packing(docs):
    got = pack(docs, max_len=100, buckets=3, token_budget=300, cell_rows=7).collect()
    total = collections.Counter()
    sizes = collections.Counter()
    for r in got:
        total[r["doc_id"]] += r["n_tokens"]
        if r["bucket"] is None:
            assert r["n_tokens"] == 0 and r["batch"] is None and r["slot"] is None
        else:
            assert r["n_tokens"] + r["padding"] == r["bucket_len"] <= 100
            sizes[r["bucket"], r["cell"], r["batch"]] += r["bucket_len"]
    assert max(sizes.values()) <= 300
    want = collections.Counter()
    for r in docs.collect():
        want[r["doc_id"]] += len((r["text"] or "").split())
    assert +total == +want and set(total) == set(want)
    slots = [(r["bucket"], r["cell"], r["batch"], r["slot"]) for r in got if r["bucket"] is not None]
    assert len(slots) == len(set(slots))


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 24))
    rows = [(i, base[i % 12] + rng.normal(size=24) * (0 if i < 14 else 0.06 * (i % 7)), i % 12 % 3) for i in range(70)]
    rows = [(i, [float(x) for x in np.float32(v)], k) for i, v, k in rows]
    rows += [(100, None, 1), (101, [0.0] * 24, 1), (102, [float("nan")] * 24, 1), (103, rows[0][1], None), (104, [1.0, 2.0], 0), (105, [None] + [1.0] * 23, 0), (106, [], 0), (70, rows[3][1], 0)]
    df = spark.createDataFrame([(i, v, k, 9, 9, 9) for i, v, k in rows], "vec_id long, embedding array<float>, label int, rep int, n int, kept int")
    vec = {i: np.array(v) for i, v, k in rows[:70] + rows[-1:]}
    label = {i: k for i, v, k in rows}

    def linked(a, b):
        return a in vec and b in vec and label[a] == label[b] and vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b]) >= 0.93

    ids = [i for i, *_ in rows]
    want = groups(ids, linked)
    got = near_vectors(df, tile_rows=5).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["vec_id"]
        assert r["n_links"] == sum(linked(i, j) for j in ids if j != i)
        assert r["component_id"] == want[i] and r["kept"] == (want[i] == i)


def test_near_vectors_broadcast_no_table_of_vectors(spark, monkeypatch):
    """Only tables of labels, or none, may pass through the driver."""
    from quillspark.llm import common, embed_join

    plans, plain = [], common.stage

    def kept(df, *args, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, *args, **options)

    monkeypatch.setattr(embed_join, "stage", kept)
    monkeypatch.setattr(common, "stage", kept)
    v = spark.createDataFrame([(i, [1.0, i % 5 / 9, i % 3 / 9], i % 2) for i in range(40)], "vec_id long, embedding array<float>, label int")
    got = near_vectors(v, tile_rows=3)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert got.count() == 40
    keys = [k for p in plans for k in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", p)]
    assert all(re.fullmatch(r"(label|dim)#\d+L?", k) for found in keys for k in found.split(", ")), keys


def test_urls(spark):
    urls = [
        ("http://Shop.example.com/en/7/x?q#f", "shop.example.com", "/en/7/x", "example.com/en/7", "allow"), ("https://a.example.com/en/8", "a.example.com", "/en/8", "com/en/", "block"),
        ("http://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"), ("http://x.net/de/9", "x.net", "/de/9", "net/de/", "allow"), ("http://badexample.net/de/8", "badexample.net", "/de/8", "net/de/", "allow"),
        ("ftp://org/es/1", "org", "/es/1", "org/es/", "block"), ("http://q.org?es/", "q.org", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("a://b#/en/", "b", "", None, None), ("x://ÄB.com/en/", "Äb.com", "/en/", "com/en/", "block"),
    ]
    df = spark.createDataFrame([(i, u[0], "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, template string")
    got = {r["page_id"]: r for r in url_template_filter(df, Q.RULES).collect()}
    assert len(got) == len(urls)
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if rule else got[i]["verdict"] in ("allow", "block")


def test_template_purity(spark):
    """A host whose labelled urls are all blocked loses its like-shaped ones; an unlabelled branch stays."""
    rows = [(i, f"http://h.example.com/en/a{i}/item{i + 100}") for i in range(60)] + [(100 + i, f"http://h.example.com/fr/page{i}") for i in range(30)]
    got = url_template_filter(spark.createDataFrame(rows, "page_id long, url string"), [("h.example.com/en/a1", "block"), ("h.example.com/en/a2", "block"), ("h.example.com/en/a3", "block")], max_purity=0.8, smoothing=1.0).collect()
    verdict = {r["page_id"]: r["verdict"] for r in got}
    assert all(verdict[i] == "block" for i in range(60)) and all(verdict[100 + i] == "allow" for i in range(30))


def brute_templates(rows, rules, min_children=16, ratio=0.25, z=1.96, smoothing=5.0, most=0.8):
    """(template, verdict) of (url) rows by a tree of plain dictionaries, one host at a time."""
    import re

    judged = []
    for url in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(r), r, v) for r, v in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        segs = []
        for x in path.split("/"):
            x = re.sub(r"^[0-9]+(?=$|\.)", "<n>", x)
            x = re.sub(r"^(?=[^.]*[0-9])[0-9a-fA-F-]{8,}(?=$|\.)", "<x>", x)
            segs += [re.sub(r"^(?=[^.<]*[0-9])[^.<]{6,}(?=$|\.)", "<a>", x)] if x else []
        judged.append((host, tuple(segs), max(fits)[2] if fits else None))
    name = {(h, s): "" for h, s, _ in judged}
    for depth in range(max((len(s) for _, s, _ in judged), default=0) + 1):
        kids = collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0, 0]))
        for h, s, v in judged:
            if len(s) >= depth:
                k = kids[h, name[h, s]][s[depth] if len(s) > depth else ""]
                k[0], k[1], k[2] = k[0] + 1, k[1] + (v is not None), k[2] + (v == "block")
        new = dict(name)
        for h, s in name:
            if len(s) > depth:
                node, seg = kids[h, name[h, s]], s[depth]
                n, labelled, blocked = (sum(k[i] for k in node.values()) for i in range(3))
                _, kl, kb = node[seg]
                share = blocked / max(labelled, 1)
                if len(node) >= min_children and len(node) > ratio * n:
                    label = "*"
                elif seg.startswith("<") or len(node) == 1:
                    label = seg
                elif kl == 0:
                    label = "{unlabelled}"
                else:
                    label = "{alike}" if kl < labelled and abs(kb / kl - share) <= z * (share * (1 - share) / kl) ** 0.5 else seg
                new[h, s] = name[h, s] + "/" + label
        name = new
    sums = collections.defaultdict(lambda: [0, 0])
    for h, s, v in judged:
        k = sums[h, name[h, s]]
        k[0], k[1] = k[0] + (v is not None), k[1] + (v == "block")
    prior = (sum(k[1] for k in sums.values()) + 1) / (sum(k[0] for k in sums.values()) + 2)
    out = []
    for h, s, v in judged:
        labelled, blocked = sums[h, name[h, s]]
        impure = blocked and (blocked + smoothing * prior) / (labelled + smoothing) >= most
        out.append((name[h, s], v or ("block" if impure else "allow")))
    return out


@pytest.mark.parametrize("deep", [False, True])
def test_urls_against_a_tree(spark, deep):
    """Templates and verdicts of all pages, and of deep urls whose branches part below the seventh segment."""
    if deep:
        rng = random.Random(4)
        urls = [f"http://h{rng.randint(1, 2)}.example.com/a/b/c/d/e/f/{rng.choice('xyz')}/{rng.randint(0, 40)}k/p{i % 23}" for i in range(300)] + ["http://h1.example.com/a", "http://h1.example.com/", None]
        rules = [("h1.example.com/a/b/c/d/e/f/x/1", "block"), ("h1.example.com/a/b/c/d/e/f/x/2", "block"), ("h2.example.com/a/b/c/d/e/f/y/", "allow")]
    else:
        urls, rules = [r["url"] for r in spark.read.parquet(SF.replace("0.001", "0.01") + "/pages.parquet").orderBy("page_id").collect()], Q.RULES
    got = url_template_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()
    assert [(r["template"], r["verdict"]) for r in got] == brute_templates(urls, rules)


EMPTY = [
    lambda d: contamination(d, d.select(F.col("doc_id").alias("item_id"), "text")), lambda d: ngram_join(d), lambda d: suffix_dedup(d), lambda d: line_run_dedup(d), lambda d: scan_secrets(d), lambda d: pack(d),
    lambda d: near_vectors(d.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"), F.lit(1).alias("label"))),
    lambda d: url_template_filter(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), Q.RULES),
]


@pytest.mark.parametrize("operator", EMPTY)
def test_empty_tables(docs, operator):
    assert operator(docs.select("doc_id", "text").limit(0)).count() == 0


def auc(score, label):
    """The share of pairs that stand in the right order, equal scores counting half."""
    import pandas as pd

    rank = pd.Series(score).rank().to_numpy()
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize("query,column,least", [(Q.op2_pu_quality, "quality", 0.95), (Q.op4_toxicity_grammar, "toxic", 0.75)])
def test_held_out_accuracy(spark, query, column, least):
    sf = SF.replace("0.001", "0.01")
    got = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", column).toPandas()
    assert got["score"].between(0, 1).all() and auc(got["score"].to_numpy(), got[column].to_numpy()) > least


@pytest.mark.parametrize("model", [pu_quality, score_toxicity])
def test_scores_without_labels(spark, docs, model):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = model(docs, labels, F.lit(True)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert model(docs.limit(0), labels, F.lit(True)).count() == 0


def test_held_out_is_crc(spark):
    import zlib

    rows = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("m", Q.crc_mod(5)).collect()
    assert all(r["m"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_sql(spark, duck, name):
    got = Q.queries()[name](spark, SF).toPandas()
    want = duck.sql(Q.ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype("int64").to_numpy().tolist()))
    assert rows(got) == rows(want)

import collections
import itertools
import random

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import queries as Q
from quillspark.llm.common import stage
from quillspark.llm.toxicity import Grammar

from ..conftest import SF


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, step in P.STAGES:
        out = stage(step(spark, docs, SF))
        left = {r[0] for r in out.select("doc_id").collect()}
        assert left <= ids
        if name != "packing":
            assert out.columns == P.COLUMNS and out.count() == len(left)
        if name == "near_duplicates":
            sets = {}
            for r in docs.collect():
                w = (r["text"] or "").encode().lower().split()
                sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
            seen = collections.defaultdict(list)
            for i in sorted(left):
                shared = collections.Counter(j for s in sets[i] for j in seen[s])
                assert not any(100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n) for j, n in shared.items())
                for s in sets[i]:
                    seen[s].append(i)
        if name == "decontaminate":
            items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(t in (r["text"] or "") for r in out.collect() for t in items)
        ids, docs = left, out
    assert left == ids


RNG = random.Random(21)
WORDS = ["".join(RNG.choice("bcdfgaeiou") for _ in range(RNG.randint(3, 8))) for _ in range(500)]
CLASH = ", score int, component_id long, id string, item_id long, n_removed int, kind string, v long"


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


BASE, LINE, ITEM = prose(80), prose(24), prose(30)
#: (id, text): null ids and texts, empty and long texts, copies, near copies, repeated ids with equal and with other texts, shared lines, leaks, toxic texts.
ROWS = [
    (None, BASE), (None, None), (1, None), (2, ""), (3, " \n "), (4, "one"), (5, BASE), (6, BASE), (7, BASE + " tail"), (5, BASE), (8, prose(50)), (8, prose(12)), (9, prose(20) + "\n" + LINE), (10, LINE + "\n" + prose(9)), (11, LINE), (12, LINE + "\n" + LINE),
    (13, prose(9) + " " + ITEM + " " + prose(9)), (14, ITEM[:60] + "zz" + ITEM[61:]), (15, prose(8000)), (16, "you are an idiot and scum and trash, you moron"), (17, prose(9)), (17, "you idiot and moron and scum, you pathetic trash"), (18, "he said nothing about it"), (19, prose(30) + "\r\n" + prose(5)),
]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A table with columns that clash with those of the operators, and a folder with no labels and two benchmark items."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, prose(25))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(i, t, "xx", "web", None if t is None else len(t), 1, 2, "c", 3, 4, "k", 5) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + CLASH).repartition(3), folder


def table(df):
    assert df.columns == P.COLUMNS
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def without(ids):
    return collections.Counter(x for x in ROWS if x[0] not in ids)


def test_toxicity_stage(spark, small):
    docs, folder = small
    g = Grammar()
    toxic = {i for i, t in ROWS if i is not None and g.probability(g.weigh([(t or "").encode()]))[0] >= 0.7}
    assert toxic == {16, 17} and table(P.toxicity(spark, docs, folder)) == without(toxic)
    real = spark.read.parquet(f"{SF}/documents.parquet")
    bad = {r[0] for r in Q.op4_toxicity_grammar(spark, SF).where("predicted = 1").select("doc_id").collect()}
    assert {r[0] for r in P.toxicity(spark, real, SF).select("doc_id").collect()} == {r[0] for r in real.select("doc_id").collect()} - bad


def test_line_dedup_stage(spark, small):
    docs, folder = small
    order = {(r["doc_id"], r["text"]): (r["doc_id"], r["v"]) for r in docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("v")).collect()}
    texts = {order[x]: x[1] for x in ROWS if x[0] is not None}
    first, want = collections.defaultdict(list), {}
    for d in sorted(texts):
        lines = (texts[d] or "").split("\n")
        dead = [False] * len(lines)
        for a, x in enumerate(lines):
            for j, b, other in first[x.strip()]:
                n = sum(1 for _ in itertools.takewhile(lambda p: p[0].strip() == p[1].strip(), zip(lines[a:], other[b:], strict=False)))
                if sum(len(y.split()) for y in lines[a : a + n]) >= 20:
                    dead[a : a + n] = [True] * n
            first[x.strip()].append((d, a, lines))
        want[d] = "\n".join(x for x, gone in zip(lines, dead, strict=True) if not gone) if any(dead) else texts[d]
    keep = lambda x: x[0] is None or want[order[x]] == x[1] or want[order[x]].strip()
    got = P.line_dedup(spark, docs, folder)
    assert table(got) == collections.Counter((x[0], x[1] if x[0] is None else want[order[x]]) for x in ROWS if keep(x))
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.collect())


def test_near_duplicates_stage(spark, small):
    docs, folder = small
    sets = collections.defaultdict(list)
    for i, t in ROWS:
        w = (t or "").encode().lower().split()
        if i is not None and w:
            sets[i].append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    low = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sorted(sets), 2):
            if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                low[a] = low[b] = min(low[a], low[b])
    assert table(P.near_duplicates(spark, docs, folder)) == without({i for i, k in low.items() if i != k})


def test_decontaminate_stage(spark, small):
    docs, folder = small

    def distance(p, t):
        row = np.arange(len(p) + 1)
        best, steps, letters = len(p), np.arange(len(p) + 1), np.array(list(p))
        for c in t:
            row = np.minimum.accumulate(np.concatenate(([0], np.minimum(row[1:] + 1, row[:-1] + (letters != c)))) - steps) + steps
            best = min(best, int(row[-1]))
        return best

    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r["text"]]
    leaks = {i for i, t in ROWS if i is not None and any(distance(p, " ".join((t or "").lower().split())) <= int(0.08 * len(p)) for p in items)}
    assert leaks == {13, 14} and table(P.decontaminate(spark, docs, folder)) == without(leaks)


def test_packing_stage(spark, small):
    docs, folder = small
    got = P.packing(spark, docs, folder).collect()
    tokens, rows = collections.Counter(), collections.Counter()
    for i, t in ROWS:
        tokens[i] += len((t or "").split())
        rows[i] += max(1, -(-len((t or "").split()) // 2048))
    assert {i: sum(r["n_tokens"] for r in got if r["doc_id"] == i) for i in rows} == dict(tokens)
    assert collections.Counter(r["doc_id"] for r in got) == rows
    lengths = collections.Counter(r["n_tokens"] for r in got if r["n_tokens"])
    xs = sorted(lengths)
    assert len(xs) > 12
    cost = lambda cuts: sum((min(c for c in cuts if c >= x) - x) * n for x, n in lengths.items())
    least = min(cost((*inner, xs[-1])) for inner in itertools.combinations(xs[:-1], 11))
    assert sum(r["padding"] for r in got if r["n_tokens"]) == least
    slots = [(r["bucket"], r["cell"], r["batch"], r["slot"]) for r in got if r["n_tokens"]]
    assert len(slots) == len(set(slots))


@pytest.mark.parametrize("name,step", P.STAGES)
def test_stages_on_empty_tables(spark, small, name, step):
    docs, folder = small
    assert step(spark, docs.limit(0), folder).count() == 0

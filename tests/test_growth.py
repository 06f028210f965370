"""Steps whose cost must grow no faster than their input: what they read, build and hold."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.kernel import cells, markdown
from quillspark.kernel.tree import FIELDS, rows_of
from quillspark.operators import lines as L
from quillspark.operators import nodes as N
from quillspark.operators import render as R
from quillspark.plans import catalog, flows, registry, small, variety  # noqa: F401  (registers its queries)
from quillspark.sources.text import read_table

from .conftest import SF


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


# F8
def test_css_entries_are_computed_once(spark):
    x = spark.createDataFrame([(1, "a: 1; b: 2; A: 3")], "k int, css string")
    got = x.select(C.css_text(C.merge_css(C.parse_css(F.col("css")), C.parse_css(F.lit("c:4")))).alias("t"))
    assert got.first().t == "a: 3; b: 2; c: 4"
    assert optimized(got).count("regexp_extract(") <= 3
    assert "Repartition" in optimized(catalog.QUERIES["css_map"](spark, SF))


# F11
def test_tex_of_one_file_is_read_by_many_tasks(spark):
    docs = read_table(spark, SF, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("\\a\r\nb %c\nd").alias("text"))
    t = L.tex_tokens(docs).withColumn("task", F.spark_partition_id())
    assert t.select("task").distinct().count() > 1
    assert [(r.type, r.line, r.col) for r in t.where("doc_id = 1 and type in ('word', 'comment')").orderBy("ord").collect()] == [("word", 2, 1), ("comment", 2, 3), ("word", 3, 1)]


# F16
def test_words_are_counted_without_a_join(spark):
    assert "Join" not in optimized(flows.words_of_english_alone(spark, SF))


# F9
def test_only_odd_clusters_are_taken_apart(spark):
    texts = ["", "abc", "ab\u0301cd", "a\u0301", "x\U0001f1e9\U0001f1eaabc\U0001f469\u200d\U0001f467z", "\u4f60a\u597dbc\u2764\ufe0f", "ab\r\ncd\te", "é\u0301éé", "#\ufe0f\u20e3ab12#\ufe0f"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.display_width(F.col("t")).alias("w"), C.count_graphemes(F.col("t")).alias("n"), F.size(C.graphemes(F.col("t"))).alias("all"), C._ends_of_runs(F.lit("abcdef" * 99)).alias("ends"))
    for r in d.collect():
        assert r.n == r["all"] and r.w == cells.display_width(r.t) and r.ends == "af"


# F7, F13, F15
def test_bodies_leave_in_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * 100_000] * 49 + [None])], names=["doc", "text"])
    got = list(R._bodies(batch, lambda t: (t or "") + "!"))
    assert max(sum(map(len, b.column(1).to_pylist())) for b in got) <= N.CHUNK_CHARS
    assert [d for b in got for d in b.column(0).to_pylist()] == list(range(50)) and got[-1].column(1).to_pylist()[-1] == "!"


# F20
def test_rows_hold_wanted_fields_alone():
    root = N.tree_of("# H\n\n- [x] a *b*\n- c\n\n1. d\n")
    keep = [0, 4, 5, 9]
    assert rows_of(root, keep, ("item",)) == [tuple(r[i] for i in keep) for r in rows_of(root) if r[5] == "item"] and len(rows_of(root)[0]) == len(FIELDS)


# F4, F6, F10, F12, F14, F17, F18, F19, F21
@pytest.mark.parametrize("name", ["neighbours", "subtree_range_join", "list_items_ranked", "nested_list_merge", "list_depths", "leaves_added", "task_items_extended", "stats_orders", "direct_texts"])
def test_documents_are_parsed_once_for_few_columns(spark, monkeypatch, name):
    asked, plain = [], N.parse_nodes
    monkeypatch.setattr(N, "parse_nodes", lambda docs, **o: asked.append(o.get("columns", ())) or plain(docs, **o))
    plan = optimized(catalog.QUERIES[name](spark, SF))
    assert len(asked) == 1 and 0 < len(asked[0]) < 12
    assert len(re.findall(r"MapInArrow run\(doc#", plan)) <= (name in ("task_items_extended", "stats_orders"))


# F3, F5
def test_a_place_is_judged_once(monkeypatch):
    seen, plain = [], markdown.starts_block
    monkeypatch.setattr(markdown, "starts_block", lambda u: seen.append(u) or plain(u))
    assert len(markdown.wrap("ab cd - efg 1. hij " * 40, 20)) > 20
    assert len(seen) <= 240


# F2
def test_plain_signs_are_counted_without_clusters(spark, monkeypatch):
    monkeypatch.setattr(cells, "clusters", lambda s: pytest.fail(s))
    assert cells.display_width("上下。Ａaé") == 10
    signs = optimized(flows.fmt_wrap_cjk(spark, SF))
    assert not re.search(r"Filter[^\n]*translate", signs)


# F1 of round 4
def test_all_orders_of_a_customer_are_one_list(spark, tmp_path):
    """However far apart their keys are, in one document; an order without a customer or a key is one too."""
    orders = [(1, k) for k in (*range(0, 40_000, 1_000), 10**9)] + [(2, 7), (2, 4_007), (3, 5), (3, None), (None, 1), (None, 9_999)]
    spark.createDataFrame(orders, "o_custkey long, o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted((tuple(r) for r in flows.nested_list_merge(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((c, i, i, n - i + 1) for c, n in ((1, 41), (2, 2), (3, 2), (None, 2)) for i in range(1, n + 1)), key=str)


def test_pairs_of_a_deep_tree_leave_in_pieces(monkeypatch):
    runs = []
    monkeypatch.setattr(N, "CHUNK_PAIRS", 1_000)
    monkeypatch.setattr(N, "_merged", lambda nodes, marks, run, names: runs.append(run))
    N.ancestors(None, None), N.descendants(None, None)
    rows = [(1, i, *ends) for i in range(400) for ends in ((399, None), (None, 399))]
    table = pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["doc_id", "node_id", "mark_end", "subtree_end"])
    for run, of, want in zip(runs, ("of_id", "root_id"), ([(i, j) for i in range(400) for j in range(i)], [(i, j) for j in range(400) for i in range(j + 1)]), strict=True):
        got = [b for b in run(iter(table.to_batches(max_chunksize=150)))]
        assert max(b.num_rows for b in got) < 1_400
        pairs = [p for b in got for p in zip(b.column(of).to_pylist(), b.column("node_id").to_pylist(), strict=True)]
        assert sorted(pairs) == sorted(want)

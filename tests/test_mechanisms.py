"""Table functions, one file a document, keyed sessions, orders with positions, sketches, aggregates, and merges of intervals."""

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import tables as T
from quillspark.operators import aggregates as A
from quillspark.operators import nodes as N
from quillspark.operators import ordering as O
from quillspark.operators import sketches as K
from quillspark.sources import rendered as R
from quillspark.sources import text as X
from quillspark.sources.text import FILES, FORMATS, register_format
from quillspark.streaming import sessions as E
from quillspark.streaming import streams as S

DOCS = [(1, "# H *x*\n\n- a\n  - b\n\n[u](v)"), (2, None), (3, ""), (3, "again"), (None, "n")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


# --- table functions ---------------------------------------------------------------


def test_md_nodes_equals_the_node_table(spark, docs):
    T.register(spark)
    wanted = ["node_id", "kind", "level", "alignments", "is_leaf", "text_content"]
    got = spark.sql(f"SELECT d.doc_id, n.* FROM {{docs}} d, LATERAL md_nodes(text, columns => '{','.join(wanted)}') n", docs=docs)
    assert got.columns == ["doc_id", *wanted]
    assert sorted(map(str, got.collect())) == sorted(map(str, N.parse_nodes(docs).select("doc_id", *wanted).collect()))
    assert spark.sql("SELECT * FROM md_nodes('- [x] a', kinds => 'item', extended => true)").select("checked", "kind").collect() == [(True, "item")]
    assert spark.sql("SELECT * FROM md_nodes('# a')").columns == [n for n, _ in N.FIELDS]


@pytest.mark.parametrize("call", ["md_nodes('a', columns => 'none')", "md_nodes('a', columns => '')", "md_nodes(TABLE(SELECT 'a'))", "md_assembled(TABLE(SELECT 'a'))"])
def test_bad_calls_fail_when_analysed(spark, call):
    T.register(spark)
    with pytest.raises(Exception, match="unknown columns|takes a"):
        spark.sql(f"SELECT * FROM {call}")


def test_options_must_be_constant(spark, docs):
    T.register(spark)
    with pytest.raises(Exception, match="must be a constant"):
        spark.sql("SELECT * FROM {docs} d, LATERAL md_nodes(text, kinds => d.text) n", docs=docs)


def test_md_assembled_is_a_document_for_each_key(spark):
    T.register(spark)
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "# a"), (2, 1, None), (None, 1, "> c")], "k long, o int, t string")
    got = spark.sql("SELECT * FROM md_assembled(TABLE(SELECT k, t, o FROM {rows}) PARTITION BY k ORDER BY o, columns => 'kind,text_content')", rows=rows).where("kind in ('heading', 'paragraph', 'block_quote')")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "heading", "a"), (1, "paragraph", "b"), (None, "block_quote", "c"), (None, "paragraph", "c")], key=str)


def test_md_cells(spark):
    T.register(spark)
    got = spark.sql("SELECT * FROM md_cells('| a | b |\n|---|---|\n| *c* | |\n\ntext\n\n| d |\n|---|')").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, True, "a"), (0, 0, 1, True, "b"), (0, 1, 0, False, "*c*"), (0, 1, 1, False, ""), (1, 0, 0, True, "d")]


# --- one file a document ------------------------------------------------------------------

NAMES = ["plain", "a/b.c", "~2", "", None, "ü %20", "..", "_x", "plain", "x\x00y", "%", "%0"]


def below(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs)


def test_names_come_back(spark, tmp_path):
    R.register(spark)
    rows = spark.createDataFrame([(n, f"body {i}", i) for i, n in enumerate(NAMES)], "name string, body string, other int").coalesce(2)
    path = f"file://{tmp_path}/out"
    rows.write.format("rendered").option("format", "commonmark").mode("append").save(path)
    got = R.read_documents(spark, path).collect()
    assert sorted(((r["name"], r["body"]) for r in got), key=str) == sorted(((n, f"body {i}") for i, n in enumerate(NAMES)), key=str)
    assert {(r["format"], r["mime"]) for r in got} == {("commonmark", "text/markdown")}


def test_overwrite_keeps_what_it_replaces(spark, tmp_path, docs):
    path = str(tmp_path / "site")
    R.write_documents(docs, path, "html")
    first = below(path)
    R.write_documents(docs.where("doc_id = 1"), path, "latex")
    assert [(r["name"], r["format"]) for r in R.read_documents(spark, path).collect()] == [("1", "latex")]
    assert sorted(f.split("/", 2)[2] for f in below(path) if f.startswith("_backup")) == first
    R.write_documents(docs.where("doc_id = 3"), path, "xml", backup=False)
    assert sorted(r["name"] for r in R.read_documents(spark, path).collect()) == ["3", "3"]
    R.write_documents(docs.where("doc_id = 1"), path, "html", mode="append")
    assert sorted(r["name"] for r in R.read_documents(spark, path).collect()) == ["1", "3", "3"]
    assert not any("_attempts" in f for f in below(path)) and not os.path.exists(f"{path}/_attempts")


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "site")
    R.write_documents(spark.createDataFrame([(1, "kept")], "doc_id long, text string"), path, "html")
    before = below(path)
    R.register(spark)
    names = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 39, F.repeat(F.lit("long"), 100)).otherwise(F.col("id").cast("string")).alias("name"), F.lit("b").alias("body"))
    with pytest.raises(Exception, match="over 200 bytes"):
        names.write.format("rendered").mode("overwrite").save(path)
    assert below(path) == before and not os.path.exists(f"{path}/_attempts")


def test_writes_that_cannot_work(spark, tmp_path, docs):
    R.register(spark)
    with pytest.raises(Exception, match="missing"):
        spark.range(1).write.format("rendered").mode("append").save(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="no format"):
        R.write_documents(docs, str(tmp_path / "x.none"))
    with pytest.raises(ValueError, match="unknown format"):
        R.write_documents(docs, str(tmp_path / "x"), "none")
    assert R.read_documents(spark, str(tmp_path / "nothing")).count() == 0


def test_format_by_extension_and_of_ones_own(spark, tmp_path, docs):
    path = str(tmp_path / "out.tex")
    R.write_documents(docs.where("doc_id = 1"), path)
    assert [r["format"] for r in R.read_documents(spark, path).collect()] == ["latex"]
    assert X.file_type("a/b.HTML") == ("html", "text/html") and X.file_type("a.d/b") == (None, "application/octet-stream") and X.file_type("x.png") == (None, "image/png")
    register_format("shout", lambda root, **o: "LOUD", "loud", "text/x-loud")
    try:
        assert X.file_type("q.loud") == ("shout", "text/x-loud")
        R.write_documents(docs, str(tmp_path / "l"), "shout")
        assert len([f for f in below(tmp_path / "l") if f.endswith(".loud")]) == len(DOCS)
    finally:
        del FORMATS["shout"], FILES["shout"]


def test_rewrite_in_place(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    texts = {"a.md": "* x\n* y\n", "sub/b.markdown": "﻿H\n=\n", "c.md": "plain", "d.txt": "* x\n"}
    for name, t in texts.items():
        (tmp_path / name).write_text(t)
    done = {os.path.relpath(r["path"], tmp_path): r["changed"] for r in R.rewrite_files(spark, str(tmp_path)).collect()}
    assert done == {"a.md": True, "sub/b.markdown": True, "c.md": False}
    assert (tmp_path / "a.md").read_text() == "- x\n- y" and (tmp_path / "a.md.bak").read_text() == texts["a.md"]
    assert "H" in (tmp_path / "sub/b.markdown").read_text() and (tmp_path / "d.txt").read_text() == texts["d.txt"]
    assert below(tmp_path) == sorted([*texts, "a.md.bak", "sub/b.markdown.bak"])
    assert not any(r["changed"] for r in R.rewrite_files(spark, str(tmp_path), backup=None).collect())
    (tmp_path / "e.md").write_bytes(b"\xff\xfe")
    (tmp_path / "f.md").write_text("* z\n")
    with pytest.raises(Exception, match="decode"):
        R.rewrite_files(spark, str(tmp_path))
    assert (tmp_path / "f.md").read_text() == "* z\n" and not any(f.endswith(".new") for f in below(tmp_path))


# --- keyed sessions --------------------------------------------------------------------------

AT = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
EVENTS = "user_id long, ts timestamp, value double"


def put(spark, path, rows):
    spark.createDataFrame([(u, None if m is None else AT(m), v) for u, m, v in rows], EVENTS).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)


def test_sessions_come_once_and_late_rows_are_kept(spark, tmp_path):
    path = str(tmp_path / "e")
    put(spark, path, [(1, 0, 1.0), (1, 10, 2.0), (2, 5, 1.0), (None, 5, 9.0), (3, None, 9.0)])
    put(spark, path, [(1, 300, 4.0), (2, 25, None)])  # 25 is late by the clock, but not by the watermark of the batch before
    put(spark, path, [(1, 20, 8.0), (2, 301, 1.0), (1, 290, 0.5)])  # the watermark stands at 180 minutes
    E.closing_row(spark, AT(301), schema=spark.read.parquet(path).schema).coalesce(1).write.mode("append").parquet(path)
    done, late = E.run_sessions(E.sessions_once(S.stream_table(spark, path, files=1)))
    minutes = lambda r: (r["key"], *(int((r[c] - AT(0)).total_seconds() // 60) for c in ("start", "end")), r["n"], r["total"])
    assert sorted(minutes(r) for r in done.where("key <> '-1'").collect()) == [("1", 0, 10, 2, 3.0), ("1", 290, 300, 2, 4.5), ("2", 5, 25, 2, 1.0), ("2", 301, 301, 1, 1.0)]
    assert [minutes(r) for r in late.collect()] == [("1", 20, 20, 1, 8.0)]


def test_sessions_without_rows(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.createDataFrame([], EVENTS).write.parquet(path)
    done, late = E.run_sessions(E.sessions_once(S.stream_table(spark, path)))
    assert done.count() == late.count() == 0


def test_folding_is_order_free():
    rng = random.Random(1)
    for _ in range(50):
        rows = [(rng.randint(0, 200), 1.0) for _ in range(rng.randint(1, 25))]
        whole = E.fold_sessions([], rows, 10)
        state = []
        for k in range(0, len(rows), 4):
            state = E.fold_sessions(state, rows[k : k + 4], 10)
        assert state == whole and sum(s[2] for s in whole) == len(rows)
        assert all(b[0] - a[1] >= 10 for a, b in zip(whole, whole[1:], strict=False))


# --- orders, offsets, sketches, aggregates ---------------------------------------------------------


def test_positions_and_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "b", "b", None]), rng.randint(0, 3), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v long, position long").withColumnRenamed("position", "i").repartition(5)
    got = O.running(df, "k", F.col("v").desc(), "i", sums={"before": F.col("v")}, ranges=7).orderBy("position").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1], r[2]))
    total = 0
    for place, (r, w) in enumerate(zip(got, want, strict=True)):
        assert (r["k"], r["v"], r["i"], r["position"], r["before"]) == (*w, place, total)
        total += w[1]
    same = O.running(spark.range(100).select(F.lit(1).alias("x")), "x", ranges=5)
    assert sorted(r["position"] for r in same.collect()) == list(range(100))
    assert O.running(df.limit(0), "k").count() == 0
    assert [(r["i"], r["position"]) for r in O.top(df, 3, "i").orderBy("position").collect()] == [(0, 0), (1, 1), (2, 2)]


def test_equal_keys_spread_over_ranges(spark):
    held = O.ordered(spark.range(4000).select(F.lit("one").alias("k"), "id"), "k", ranges=8)
    sizes = [r["count"] for r in held.groupBy("range_no").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500


def test_source_offsets_and_places(spark):
    rows = [("b", "two\nlines\n"), ("a", "one"), ("c", None), ("d", "x")]
    s = X.with_offsets(spark.createDataFrame(rows, "name string, text string"))
    whole = "\n".join(t or "" for _, t in sorted(rows, key=lambda r: r[0]))
    got = {r["name"]: (r["line_offset"], r["char_offset"]) for r in s.collect()}
    assert got == {"a": (0, 0), "b": (1, 4), "c": (3, 15), "d": (3, 16)} and whole[16] == "x"
    places = X.source_at(s, spark.createDataFrame([(0,), (3,), (4,), (14,), (15,), (16,), (17,), (99,)], "place long"))
    assert {r["place"]: (r["name"], r["char"]) for r in places.collect()} == {0: ("a", 0), 3: ("a", 3), 4: ("b", 0), 14: ("b", 10), 15: ("c", 0), 16: ("d", 0), 17: ("d", 1), 99: (None, None)}


def test_quantiles_keep_their_bound(spark):
    rng = random.Random(3)
    values = [rng.choice([-1, 1, 1]) * rng.lognormvariate(0, 4) for _ in range(2000)] + [0.0] * 50 + [None, float("nan")]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "g int, v double")
    at = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    parts = K.quantile_counts(df, "v", ["g"], 0.02)
    got = {r["quantile"]: r["estimate"] for r in K.quantiles(parts.withColumn("all", F.lit("x")).drop("g").withColumnRenamed("all", "k"), ["k"], at, 0.02).collect()}
    exact = sorted(v for v in values if v is not None and v == v)
    for q in at:
        true = exact[int(q * (len(exact) - 1))]
        assert abs(got[q] - true) <= 0.0201 * abs(true)
    assert K.quantiles(parts.limit(0), ["g"], at).count() == 0


def test_distinct_of_unions(spark):
    df = spark.range(6000).select((F.col("id") % 3).alias("day"), (F.col("id") % 1500).alias("u"))
    days = K.distinct_sketch(df, "u", ["day"])
    got = K.distinct_estimates(days.withColumn("all", F.lit(1)), ["all"]).collect()
    assert len(got) == 1 and abs(got[0]["distinct"] - 1500) < 100 and got[0]["n"] == 6000


def test_aggregates_of_ones_own(spark):
    rows = [("en", "a b a"), ("en", None), ("de", "x"), (None, "n n"), ("en", "b c b"), ("de", ""), ("fr", None)] * 40
    df = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    for most in (1, 200_000):
        got = A.aggregate(df, F.col("lang"), F.col("text"), A.WordCounts(2), most=most, spread=2)
        assert sorted(map(tuple, got.collect()), key=str) == sorted([("en", 1, "b", 120), ("en", 2, "a", 80), ("de", 1, "x", 40), (None, 1, "n", 80)], key=str)
    assert A.aggregate(df.limit(0), F.col("lang"), F.col("text"), A.WordCounts()).count() == 0


# --- merges of intervals -------------------------------------------------------------------------------


def test_merges_equal_the_interval_joins(spark):
    texts = ["> - a\n>   - b *c **d***\n>\n> e\n\n# f", "- a\n  - b\n    - c\n      - d [e](f)\n\n1. x", "", "p"]
    n = N.parse_nodes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for marks in (n, n.where("kind in ('list', 'item', 'strong', 'document')"), n.limit(0)):
            rows = n.collect()
            on = marks.select("doc_id", "node_id", "subtree_end", "depth").collect()
            want = sorted((m["node_id"], r["doc_id"], r["node_id"], r["kind"]) for m in on for r in rows if r["doc_id"] == m["doc_id"] and m["node_id"] <= r["node_id"] <= m["subtree_end"])
            got = N.descendants(n, marks)
            assert got.columns == ["root_id", *n.columns] and sorted((r["root_id"], r["doc_id"], r["node_id"], r["kind"]) for r in got.collect()) == want
            want = sorted((m["node_id"], m["depth"] - r["depth"], r["doc_id"], r["node_id"], r["kind"]) for m in on for r in rows if r["doc_id"] == m["doc_id"] and r["node_id"] < m["node_id"] <= r["subtree_end"])
            assert sorted((r["of_id"], r["distance"], r["doc_id"], r["node_id"], r["kind"]) for r in N.ancestors(n, marks).collect()) == want
            cut = {(r["doc_id"], r["node_id"]) for m in on for r in rows if r["doc_id"] == m["doc_id"] and m["node_id"] <= r["node_id"] <= m["subtree_end"]}
            assert sorted((r["doc_id"], r["node_id"]) for r in N.without_subtrees(n, marks).collect()) == sorted((r["doc_id"], r["node_id"]) for r in rows if (r["doc_id"], r["node_id"]) not in cut)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        n.unpersist()


def test_a_document_of_200000_nodes(spark):
    """One flat document: an interval join within it would compare 10**10 pairs."""
    flat = spark.range(200_000).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("node_id"), F.when(F.col("id") == 0, 199_999).otherwise(F.col("id")).cast("int").alias("subtree_end"), F.when(F.col("id") > 0, 1).otherwise(0).alias("depth"))
    marks = flat.where("node_id > 0")
    began = time.time()
    assert N.ancestors(flat, marks).count() == N.descendants(flat, marks).count() == 199_999
    assert N.without_subtrees(flat, marks.where("node_id % 2 = 0")).count() == 100_001
    assert time.time() - began < 60

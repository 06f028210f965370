"""Operators on node rows: nulls, empty tables, and places that do not exist."""

from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.kernel.tree import rows_of
from quillspark.operators import extract as X
from quillspark.operators import nodes as N

DOCS = [(1, "# H\n\n- a\n  - b\n\nend"), (2, None), (3, "")]
LEAVES = "doc_id long, anchor_id int, place string, ord int, kind string, literal string"


def tree(spark, rows=DOCS):
    return N.parse_nodes(spark.createDataFrame(rows, "doc_id long, text string"))


def test_leaves_keep_ids_and_intervals_in_order(spark):
    n = tree(spark)
    added = spark.createDataFrame([(1, 0, "child", 1, "text", "y"), (1, 0, "child", 0, "text", "x"), (1, 4, "after", 0, "text", "z"), (1, 99, "child", 0, "text", "lost"), (9, 0, "child", 0, "text", "lost"), (1, 0, "after", 0, "text", "beside the root")], LEAVES)
    out = {(r.doc_id, r.node_id): r for r in N.with_leaves(n, added).collect()}
    assert len(out) == n.count() + 3
    for (doc, i), r in out.items():
        assert i <= r.subtree_end < sum(d == doc for d, _ in out)
        if r.parent_id is not None:
            up = out[doc, r.parent_id]
            assert up.node_id < i <= r.subtree_end <= up.subtree_end and up.depth + 1 == r.depth
    top = sorted((r.sibling_ord, r.kind, r.literal) for r in out.values() if r.doc_id == 1 and r.parent_id == 0)
    assert [(k, x) for _, k, x in top][-2:] == [("text", "x"), ("text", "y")] and [o for o, _, _ in top] == list(range(len(top)))


def test_no_leaves_change_nothing(spark):
    n = tree(spark)
    assert sorted(map(str, N.with_leaves(n, spark.createDataFrame([], LEAVES)).collect())) == sorted(map(str, n.collect()))


def test_list_depth_is_the_number_of_list_ancestors(spark):
    n = tree(spark, [(1, "- a\n  - b\n    > 1. c\n- d\n\ne\n\n1. f"), (2, None)])
    lists = N.ancestors(n, n).where("kind = 'list'").groupBy("doc_id", F.col("of_id").alias("node_id")).count()
    want = n.join(lists, ["doc_id", "node_id"], "left").select("doc_id", "node_id", F.coalesce("count", F.lit(0)).alias("d"))
    assert sorted(want.collect()) == sorted(N.with_list_depth(n).select("doc_id", "node_id", F.col("list_depth").alias("d")).collect())


def test_statistics_of_nothing_are_zero(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    by = {r.doc_id: r for r in X.document_stats(docs).collect()}
    assert by[3].words == 0 and by[3].headings == 0 and by[3].languages == [] and by[2].headings == 0 and by[2].words is None
    assert X.document_stats(docs.limit(0)).count() == 0


def test_empty_tables(spark):
    n = tree(spark, [(1, "")]).limit(0)
    assert N.first_headings(n).count() == N.direct_text(n).count() == N.following_siblings(n, n).count() == 0
    assert X.as_json(X.links(n), "text").count() == X.tables_csv(X.tables(n)).count() == 0


def test_columns_on_null_and_blank(spark):
    t = F.col("t")
    rows = spark.createDataFrame([(None,), ("",), ("  x\r\n    y",)], "t string").select(C.minimize_indent(t).alias("m"), C.has_strikethrough(t).alias("s"), C.attributes_html(C.attributes(t)).alias("a"), C.inline_style(t).alias("i")).collect()
    assert [r.m for r in rows] == [None, "", "x\n  y"] and rows[0].s is None and rows[1].i is None and {r.a for r in rows} == {None}


def test_math_closes_with_as_many_dollars():
    kinds = lambda text: [(r[5], r[8]) for r in rows_of(N.tree_of(text)) if r[5] == "math"]
    assert kinds("$a$$b$") == [("math", "a$$b")] and kinds("$$a$b$$") == [("math", "a$b")] and kinds("${a$}b$") == [("math", "{a$}b")] and kinds("$a\\$b$") == [("math", "a\\$b")] and kinds("$$$a$$$") == []

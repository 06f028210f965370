"""From documents to the node table, and navigation in it.

``parse_nodes`` is the only Python step; everything after it is relational.
One Arrow pass: a document is parsed where it is read, or, where few files
would make few tasks, dealt out before (:func:`spread`).
"""

from __future__ import annotations

from collections.abc import Collection
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernel.blocks import parse
from ..kernel.tree import FIELDS, Node, rows_of

_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
CHUNK_NODES = 20_000
#: Characters of texts whose results leave a task's Python at once.
CHUNK_CHARS = 1 << 20
#: Pairs of a merge that leave a task's Python at once: a deep tree makes many of few rows.
CHUNK_PAIRS = 1 << 18


def within_limits(t: Column, max_bytes: int | None = None, max_line: int | None = None) -> Column:
    """Whether a text is inside the input limits; use its negation for a quarantine table."""
    ok = F.lit(True)
    if max_bytes is not None:
        ok = ok & (F.octet_length(t) <= max_bytes)
    if max_line is not None:
        ok = ok & ~F.exists(F.split(t, "\n"), lambda x: F.octet_length(x) > max_line)
    return F.coalesce(ok, F.lit(True))


def tree_of(text: str | None, extended: bool | Collection[str] = False, **options: Any) -> Node:
    """The tree of a text; ``extended`` names extensions (:data:`quillspark.kernel.extended.EXTENSIONS`), True means all."""
    root = parse(text or "", **options)
    if extended:
        from ..kernel.extended import EXTENSIONS, extend

        extend(root, EXTENSIONS if extended is True else extended)
    return root


def within(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bytes: int | None = None, max_line: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents inside the limits, (id_col, bytes, longest_line, reason) of those outside), so that no text is lost from sight.

    ``max_bytes`` bounds a text, ``max_line`` its longest line, both in bytes.
    The parser is linear in both, but one text is one task's.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    longest = F.array_max(F.transform(F.split(t, "\n"), F.octet_length))
    over = [(F.octet_length(t) > F.lit(max_bytes), "text") if max_bytes is not None else None, (longest > F.lit(max_line), "line") if max_line is not None else None]
    reason = F.coalesce(*(F.when(c, F.lit(x)) for c, x in filter(None, over)), F.lit(None).cast("string"))
    inside = docs.where(within_limits(F.col(text_col), max_bytes, max_line))
    outside = docs.where(~within_limits(F.col(text_col), max_bytes, max_line))
    return inside, outside.select(id_col, F.octet_length(t).alias("bytes"), longest.alias("longest_line"), reason.alias("reason"))


def spread(rows: DataFrame) -> DataFrame:
    """Deal the rows out where fewer tasks would read them than the cluster runs at once.

    A table of one row group is read by one task, however large its texts are;
    one round-robin shuffle of the texts costs less than parsing them there.
    Streams, rows that come from no files, and tables that many tasks read, stay
    as they are.
    """
    if rows.isStreaming:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 0 < len(rows.inputFiles()) < cores else rows


def parse_nodes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", extended: bool | Collection[str] = False, smart: bool = False, shortcodes: dict[str, str] | None = None, kinds: tuple[str, ...] = (), columns: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, node columns): the tree of every document, pre-order ids and nested intervals.

    With ``kinds`` only nodes of those leave the kernel, with ``columns`` only
    those columns of theirs.
    """
    wanted = [(i, f) for i, f in enumerate(FIELDS) if not columns or f[0] in columns]
    if len(wanted) < len(set(columns)):
        raise ValueError(f"unknown columns {sorted(set(columns) - {n for n, _ in FIELDS})}")
    keep, fields = [i for i, _ in wanted], [f for _, f in wanted]
    only = frozenset(kinds)
    rows = spread(docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")))
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches):
        for b in batches:
            key, out, chars = [], [], 0

            def flush(key, out, like=b.schema.field(0).type):
                cols = [pa.array([r[i] for r in out], _ARROW[t]) for i, (_, t) in enumerate(fields)]
                return pa.RecordBatch.from_arrays([pa.array(key, like), *cols], names=["doc", *(n for n, _ in fields)])

            for k, text in zip(b.column(0), b.column(1), strict=True):
                text = text.as_py()
                got = rows_of(tree_of(text, extended, smart=smart, shortcodes=shortcodes), keep, only)
                key += [k.as_py()] * len(got)
                out += got
                chars += len(text or "")
                if len(out) >= CHUNK_NODES or chars >= CHUNK_CHARS:
                    if out:
                        yield flush(key, out)
                    key, out, chars = [], [], 0
            if out:
                yield flush(key, out)

    return rows.mapInArrow(run, f"doc {kind}, " + ", ".join(f"{n} {t}" for n, t in fields)).withColumnRenamed("doc", id_col)


# --- navigation ------------------------------------------------------------------


def children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    p = parents.select("doc_id", F.col("node_id").alias("parent_id"))
    return nodes.join(p, ["doc_id", "parent_id"], "left_semi")


def _merged(nodes: DataFrame, marks: DataFrame, run, names: list[tuple[str, str]]) -> DataFrame:
    """The structural merge: ``run`` sees each document's marks and nodes in pre-order, a mark before its node.

    A document's rows are together and sorted, so one pass with a stack of the
    intervals that are open, no longer than the tree is deep, meets every
    (outer, inner) pair it returns and no other.  Rows are (doc_id, node_id,
    mark end or null, node columns); ``names`` are the columns that ``run`` puts
    before those of nodes.
    """
    rest = [c for c in nodes.columns if c not in ("doc_id", "node_id")]
    kinds = dict(nodes.dtypes)
    at = nodes.select("doc_id", "node_id", F.lit(None).cast("int").alias("mark_end"), *rest)
    on = marks.select("doc_id", "node_id", F.col("subtree_end").alias("mark_end"), *(F.lit(None).cast(kinds[c]).alias(c) for c in rest))
    both = on.unionByName(at).repartition("doc_id").sortWithinPartitions("doc_id", "node_id", F.col("mark_end").asc_nulls_last())
    extra = ", ".join(f"{n} {t}" for n, t in names)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", "node_id", *rest))
    return both.mapInArrow(run, f"{extra}, {schema}").select(*(n for n, _ in names), *nodes.columns)


def _columns(b: pa.RecordBatch) -> tuple[list, list, list]:
    return b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()


def descendants(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, node columns) of each root's subtree, the root included; a merge of nested intervals, linear in what it reads and returns.

    Roots that repeat return their subtree as often.
    """

    def run(batches):
        doc, last, open_ = None, [], []

        def flush(b, root, row):
            got = b.take(pa.array(row, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(root, pa.int32()), *(got.column(i) for i in range(got.num_columns) if i != 2)], names=["root_id", *(n for i, n in enumerate(b.schema.names) if i != 2)])

        for b in batches:
            root, row = [], []
            for i, (d, n, end) in enumerate(zip(*_columns(b), strict=True)):
                if d != doc:
                    doc, last, open_ = d, [], []
                while last and last[-1] < n:
                    last.pop()
                    open_.pop()
                if end is not None:
                    last.append(end)
                    open_.append(n)
                else:
                    root += open_
                    row += [i] * len(open_)
                    if len(row) >= CHUNK_PAIRS:
                        yield flush(b, root, row)
                        root, row = [], []
            yield flush(b, root, row)

    return _merged(nodes, roots, run, [("root_id", "int")])


def ancestors(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(of_id, distance, node columns) of the proper ancestors of each node; distance 1 is the parent.  The same merge as in :func:`descendants`."""

    def run(batches):
        doc, last, open_, kept = None, [], [], None  # nodes around this place: last ids of their subtrees, and their rows; kept: those of batches before

        def flush(b, of_id, far, row):
            got = b.take(pa.array(row, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(of_id, pa.int32()), pa.array(far, pa.int32()), *(got.column(i) for i in range(got.num_columns) if i != 2)], names=["of_id", "distance", *(n for i, n in enumerate(b.schema.names) if i != 2)])

        for b in batches:
            ends = b.column(b.schema.get_field_index("subtree_end")).to_pylist()
            before = kept.num_rows if kept is not None else 0
            both = pa.concat_batches([kept, b]) if before else b
            of_id, far, row = [], [], []
            for i, (d, n, mark) in enumerate(zip(*_columns(b), strict=True), before):
                if d != doc:
                    doc, last, open_ = d, [], []
                while last and last[-1] < n:
                    last.pop()
                    open_.pop()
                if mark is None:
                    last.append(ends[i - before])
                    open_.append(i)
                else:
                    of_id += [n] * len(open_)
                    far += range(len(open_), 0, -1)
                    row += open_
                    if len(row) >= CHUNK_PAIRS:
                        yield flush(both, of_id, far, row)
                        of_id, far, row = [], [], []
            yield flush(both, of_id, far, row)
            kept, open_ = both.take(pa.array(open_, pa.int64())), [*range(len(open_))]  # of batches before, only the rows that are still open are kept

    return _merged(nodes, of, run, [("of_id", "int"), ("distance", "int")])


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Adds prev_id, next_id, first_child, last_child and n_children."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("sibling_ord")
    kids = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.min("node_id").alias("first_child"), F.max("node_id").alias("last_child"), F.count("*").alias("n_children"))
    out = nodes.withColumn("prev_id", F.lag("node_id").over(w)).withColumn("next_id", F.lead("node_id").over(w))
    return out.join(kids, ["doc_id", "node_id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def following_siblings(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(of_id, node columns) of the siblings after each node."""
    return _siblings(nodes, of).where("sibling_ord > of_ord").drop("of_ord")


def preceding_siblings(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(of_id, node columns) of the siblings before each node."""
    return _siblings(nodes, of).where("sibling_ord < of_ord").drop("of_ord")


def _siblings(nodes: DataFrame, of: DataFrame) -> DataFrame:
    x = of.select("doc_id", "parent_id", F.col("node_id").alias("of_id"), F.col("sibling_ord").alias("of_ord"))
    return nodes.join(x, ["doc_id", "parent_id"])


def with_has_children(nodes: DataFrame) -> DataFrame:
    """Adds has_children: in pre-order a subtree that ends after its root holds others."""
    return nodes.withColumn("has_children", F.col("subtree_end") > F.col("node_id"))


def with_list_depth(nodes: DataFrame) -> DataFrame:
    """Adds list_depth: how many lists enclose each node, counted by two running sums.

    The lists around a node are those that began before it less those that
    ended before it, so no node meets its ancestors in a join.
    """
    begins = F.when(F.col("kind") == "list", 1).otherwise(0)
    w = Window.partitionBy("doc_id").orderBy("node_id")
    before = nodes.withColumn("begun", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    ends = nodes.where("kind = 'list'").groupBy("doc_id", (F.col("subtree_end") + 1).alias("node_id")).agg(F.count("*").alias("ends"))
    out = before.join(ends, ["doc_id", "node_id"], "left").withColumn("ended", F.sum(F.coalesce("ends", F.lit(0))).over(w))
    return out.withColumn("list_depth", (F.coalesce("begun", F.lit(0)) - F.col("ended")).cast("int")).drop("begun", "ends", "ended")


def direct_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, text): the texts that are children of a node themselves, in order."""
    t = nodes.where("kind = 'text'").groupBy("doc_id", F.col("parent_id").alias("node_id"))
    return t.agg(F.array_sort(F.collect_list(F.struct("sibling_ord", "literal"))).alias("t")).select("doc_id", "node_id", F.array_join(F.transform("t", lambda x: x["literal"]), "").alias("text"))


def with_leaves(nodes: DataFrame, added: DataFrame) -> DataFrame:
    """The node table with new leaves: ``added`` has (doc_id, anchor_id, place, ord, kind, literal).

    ``place`` "child" appends to the anchor, "after" puts the leaf behind it as
    a sibling; leaves of one place stand by ord.  Ids and intervals are numbered
    anew by windows over each document; anchors that do not exist add nothing.
    """
    at = nodes.select("doc_id", F.col("node_id").alias("anchor_id"), F.col("parent_id").alias("anchor_parent"), F.col("subtree_end").alias("anchor_end"), F.col("depth").alias("anchor_depth"))
    child = F.col("place") == "child"
    new = added.join(at, ["doc_id", "anchor_id"]).where(child | F.col("anchor_parent").isNotNull())
    new = new.select("doc_id", F.col("anchor_end").alias("slot"), (F.col("anchor_depth") + child.cast("int")).alias("depth"), F.when(child, F.col("anchor_id")).otherwise(F.col("anchor_parent")).alias("parent_id"), F.col("anchor_id").alias("by"), "ord", "kind", "literal", F.lit(False).alias("is_block"), F.lit(True).alias("is_leaf"))
    old = nodes.withColumns({"slot": F.col("node_id"), "by": F.lit(-1), "ord": F.lit(-1)})
    # behind an old node come what is added below it, the deepest first, and of one parent the leaf that follows a sibling before the one that is appended
    order = [F.col("slot"), F.col("node_id").isNull(), F.col("depth").desc(), F.col("by").desc(), F.col("ord")]
    both = old.unionByName(new, allowMissingColumns=True).withColumn("new_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)
    grown = new.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("grown"))
    sums = both.where("node_id is not null").join(grown, ["doc_id", "node_id"], "left").select("doc_id", "node_id", "subtree_end", "new_id", F.sum(F.coalesce("grown", F.lit(0))).over(Window.partitionBy("doc_id").orderBy("node_id")).alias("upto"), F.coalesce("grown", F.lit(0)).alias("grown"))
    last = sums.select("doc_id", F.col("node_id").alias("subtree_end"), F.col("upto").alias("upto_end"))
    shift = sums.join(last, ["doc_id", "subtree_end"]).select("doc_id", "node_id", F.col("new_id").alias("to_id"), (F.col("new_id") + F.col("subtree_end") - F.col("node_id") + F.col("upto_end") - F.col("upto") + F.col("grown")).cast("int").alias("to_end"))
    parents = shift.select("doc_id", F.col("node_id").alias("parent_id"), F.col("to_id").alias("to_parent"))
    out = both.join(shift, ["doc_id", "node_id"], "left").join(parents, ["doc_id", "parent_id"], "left")
    out = out.withColumns({"node_id": F.col("new_id").cast("int"), "subtree_end": F.coalesce("to_end", "new_id").cast("int"), "parent_id": F.col("to_parent").cast("int")})
    place = Window.partitionBy("doc_id", "parent_id").orderBy("node_id")
    return out.withColumn("sibling_ord", F.row_number().over(place) - 1).select(*nodes.columns)


def without_subtrees(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Unlink: the rows outside the roots' subtrees.

    In pre-order a node is inside one exactly if the furthest end among the roots
    up to it reaches it: a running maximum over one window, no join by interval.
    """
    cut = roots.groupBy("doc_id", "node_id").agg(F.max("subtree_end").alias("cut_end"))
    w = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    reach = nodes.join(cut, ["doc_id", "node_id"], "left").withColumn("reach", F.max("cut_end").over(w))
    return reach.where("reach is null or reach < node_id").select(*nodes.columns)


def governed_by_heading(nodes: DataFrame) -> DataFrame:
    """Adds heading_id: the last heading before or at each node, an as-of join by window."""
    w = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("heading_id", F.last(F.when(F.col("kind") == "heading", F.col("node_id")), ignorenulls=True).over(w))


def first_headings(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, level, text): the first top-level heading of the document, of any level."""
    h = F.struct("node_id", "level", F.col("text_content").alias("text"))
    return nodes.where("kind = 'heading' and depth = 1").groupBy("doc_id").agg(F.min_by(h, "node_id").alias("h")).select("doc_id", "h.*")


def titles(nodes: DataFrame) -> DataFrame:
    """(doc_id, title): the text of the first level-1 heading of the document."""
    return nodes.where("kind = 'heading' and level = 1 and depth = 1").groupBy("doc_id").agg(F.min_by("text_content", "node_id").alias("title"))

"""URL filter by a path-template tree (operator 1).

Per host, URLs form a tree of path segments.  Segments that vary become
wildcards, sibling branches that do not differ statistically are merged, and a
template is rejected when it has blocked labels and its purity, smoothed
towards the corpus prior, is high.  Everything is DataFrame algebra over counts: the tree is kept
as aggregated (host, path shape) rows, so the only full-table steps are one
partial aggregation and one join back.  The tree is generalised level by level
down to its deepest path; a level works on the paths that reach it.

Defined cases: a null url, or one without ``://``, has empty host and path; an
empty path is the root template; repeated urls count with their multiplicity;
an empty table gives an empty result; columns of the input other than the id
and the url are ignored, whatever their names; of rules that fit, the longest
wins, and of equally long ones the later in the order of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule ``(host/path, verdict)`` that fits, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def shape_of(segment: Column) -> Column:
    """A segment with its numeric or identifier-like part replaced by a class; the extension stays."""
    s = F.regexp_replace(segment, r"^[0-9]+(?=$|\.)", "<n>")
    s = F.regexp_replace(s, r"^(?=[^.]*[0-9])[0-9a-fA-F-]{8,}(?=$|\.)", "<x>")
    return F.regexp_replace(s, r"^(?=[^.<]*[0-9])[^.<]{6,}(?=$|\.)", "<a>")


def url_template_filter(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    min_children: int = 16,
    variable_ratio: float = 0.25,
    z_merge: float = 1.96,
    smoothing: float = 5.0,
    max_purity: float = 0.8,
) -> DataFrame:
    """Judge every url: (id, host, path, rule, verdict, template, purity, n_template).

    ``rules`` decide where they fit and are the labels the purities are learned
    from.  A segment position below a node is variable when it has at least
    ``min_children`` values and more than ``variable_ratio`` values per url;
    otherwise sibling values whose share of blocked labels is within
    ``z_merge`` standard errors of their pooled share are merged, as are
    unlabelled siblings.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), verdict.alias("ruled"))
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    base = base.withColumn("shape", F.array_join(F.transform(parts, shape_of), "/"))
    tree = base.groupBy("host", "shape").agg(
        F.count("*").alias("n"),
        F.count("ruled").alias("labelled"),
        F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"),
    )
    tree = stage(tree.withColumn("template", F.lit("")).withColumn("segs", F.split("shape", "/")))
    # at a level, paths that end there count as one more child, without a name
    done, depth = None, 0
    while tree is not None:
        tree = stage(_generalise(tree, depth, min_children, variable_ratio, z_merge))
        depth += 1
        ended = tree.where(F.size("segs") < depth)
        done = ended if done is None else done.union(ended)
        tree = tree.where(F.size("segs") >= depth)
        if tree.isEmpty():
            tree = None
    tree = done
    sums = tree.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")))
    got = tree.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    prior = ((got["b"] or 0) + 1) / ((got["l"] or 0) + 2)
    pure = sums.select("host", "template", F.col("n").alias("n_template"), "blocked", ((F.col("blocked") + smoothing * prior) / (F.col("labelled") + smoothing)).alias("purity"))
    marked = tree.select("host", "shape", "template").join(pure, ["host", "template"])
    out = base.join(marked, ["host", "shape"], "left")
    learned = F.when((F.col("purity") >= max_purity) & (F.col("blocked") > 0), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "template", "purity", "n_template")


def _generalise(tree: DataFrame, depth: int, min_children: int, ratio: float, z: float) -> DataFrame:
    """Name the tree's segments at one depth: literal, wildcard, or the name of a merged branch."""
    seg = F.coalesce(F.get("segs", F.lit(depth)), F.lit(""))
    kids = tree.withColumn("seg", seg).groupBy("host", "template", "seg").agg(F.sum("n").alias("kn"), F.sum("labelled").alias("kl"), F.sum("blocked").alias("kb"))
    node = kids.groupBy("host", "template").agg(F.sum("kn").alias("pn"), F.count("*").alias("k"), F.sum("kl").alias("pl"), F.sum("kb").alias("pb"))
    share = F.col("pb") / F.greatest("pl", F.lit(1))
    error = F.sqrt(share * (1 - share) / F.greatest("kl", F.lit(1)))
    name = (
        F.when(F.col("seg") == "", "")
        .when((F.col("k") >= min_children) & (F.col("k") > ratio * F.col("pn")), "*")
        .when(F.col("seg").startswith("<") | (F.col("k") == 1), F.col("seg"))
        .when(F.col("kl") == 0, "{unlabelled}")
        .when((F.col("kl") < F.col("pl")) & (F.abs(F.col("kb") / F.col("kl") - share) <= z * error), "{alike}")
        .otherwise(F.col("seg"))
    )
    named = kids.join(node, ["host", "template"]).select("host", "template", "seg", name.alias("name"))
    grown = F.when(F.col("name") == "", F.col("template")).otherwise(F.concat("template", F.lit("/"), "name"))
    return tree.withColumn("seg", seg).join(named, ["host", "template", "seg"]).select("host", "shape", "n", "labelled", "blocked", grown.alias("template"), "segs")

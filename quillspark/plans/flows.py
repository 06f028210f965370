"""Queries that rest on a mechanism of their own: table functions, data sources, keyed state, sketches, total orders, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import tables as T
from ..operators import aggregates as A
from ..operators import extract as V
from ..operators import nodes as N
from ..operators import ordering as O
from ..operators import sketches as K
from ..operators.render import format_documents
from ..operators.staging import scratch, stage
from ..sources import rendered as R
from ..sources import text as X
from ..sources.text import read_table
from ..streaming import sessions as E
from ..streaming import streams as S
from .registry import documents, query

# --- table functions in SQL ---------------------------------------------------------------

#: All letters, digits and marks of a text, of any script, in one line behind a "w".
_LINE = "concat('w ', trim(regexp_replace(coalesce(text, ''), '[^{letters}]+', ' '{all})))"
_SPARK_LINE = _LINE.format(letters=r"\\p{L}\\p{M}\\p{N}", all="")
_DUCK_LINE = _LINE.format(letters=r"\p{L}\p{M}\p{N}", all=", 'g'")


@query(f"""WITH t AS (SELECT doc_id, lang, source, rtrim({_DUCK_LINE}) AS line FROM documents)
SELECT doc_id, 'heading' AS kind, 2 AS level, md5(source) AS text FROM t UNION ALL SELECT doc_id, 'paragraph', NULL, md5(line) FROM t UNION ALL SELECT doc_id, 'item', NULL, md5(lang) FROM t UNION ALL SELECT doc_id, 'item', NULL, md5(source) FROM t""")
def sql_md_nodes(spark, sf):
    """The parser as a table function: headings, items and the paragraph that each text makes, by LATERAL in SQL."""
    T.register(spark)
    docs = N.spread(documents(spark, sf)).selectExpr("doc_id", f"concat('## ', source, '\\n\\n', rtrim({_SPARK_LINE}), '\\n\\n- ', lang, '\\n- ', source, '\\n') as md")
    return spark.sql("SELECT d.doc_id, n.kind, n.level, md5(n.text_content) AS text FROM {docs} d, LATERAL md_nodes(d.md, kinds => 'heading,paragraph,item', columns => 'kind,level,depth,text_content') n WHERE n.kind <> 'paragraph' OR n.depth = 1", docs=docs)


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS slide, role AS heading FROM conversations")
def sql_md_assembled(spark, sf):
    """Documents assembled from the turns of a conversation by a partitioned table argument, no list of turns collected."""
    T.register(spark)
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("## "), "role", F.lit("\n\n"), C.normalize_ws(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " "))).alias("text"))
    rows = spark.sql("SELECT * FROM md_assembled(TABLE(SELECT conv_id, text, turn FROM {turns}) PARTITION BY conv_id ORDER BY turn, kinds => 'heading', columns => 'node_id,text_content')", turns=turns)
    return rows.select("conv_id", F.expr("cast(row_number() over (partition by conv_id order by node_id) as int)").alias("slide"), F.col("text_content").alias("heading"))


@query("SELECT n_regionkey, count(*) AS cells, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def sql_md_cells(spark, sf):
    T.register(spark)
    line = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |"))
    n = read_table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))).alias("l"))
    md = n.select("n_regionkey", F.concat(F.lit("| k | n |\n|---|---|\n"), F.array_join(F.transform("l", lambda x: x["l"]), "\n")).alias("md"))
    return spark.sql("SELECT n_regionkey, count(*) AS cells, array_join(transform(array_sort(collect_list(struct(c.row, c.cell))), x -> x.cell), ',') AS names FROM {md}, LATERAL md_cells(md) c WHERE NOT c.header AND c.col = 1 GROUP BY n_regionkey", md=md)


# --- one file for each document ---------------------------------------------------------------

@query(f"""SELECT doc_id, 'html' AS format, 'text/html' AS mime, '<h2>' || source || '</h2>' || chr(10) || '<p>' || line || '</p>' AS body FROM (SELECT doc_id, source, rtrim({_DUCK_LINE}) AS line FROM documents)""")
def files_written_and_read(spark, sf):
    """Every document rendered to a file of its own by the data source, read back, and joined to its table."""
    d = documents(spark, sf)
    path = scratch(spark, "quillspark-files")
    docs = d.selectExpr("doc_id", f"concat('## ', source, '\\n\\n', rtrim({_SPARK_LINE}), '\\n') as text")
    R.write_documents(docs, path, "html")
    files = R.read_documents(spark, path)
    return d.select("doc_id").join(files.select(F.col("name").cast("long").alias("doc_id"), "format", "mime", "body"), "doc_id")


# --- keyed state --------------------------------------------------------------------------------

_LATE = "event_id % 97 = 0"


@query(f"""WITH e AS (SELECT user_id, ts, value, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE AS fresh FROM events WHERE user_id IS NOT NULL),
s AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT 'session' AS kind, CAST(user_id AS VARCHAR) AS key, min(ts) AS start, max(ts) AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k
UNION ALL SELECT 'late', CAST(user_id AS VARCHAR), ts - INTERVAL 90 DAY, ts - INTERVAL 90 DAY, 1, round(value, 4) FROM events WHERE {_LATE}""")
def sessions_with_late_rows(spark, sf):
    """Sessions of every user by keyed state, each emitted once; rows planted 90 days behind come out as late, all of them."""
    e = read_table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    path = scratch(spark, "quillspark-events")
    e.write.parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    e.where(_LATE).withColumn("ts", F.expr("ts - interval 90 days")).coalesce(1).write.mode("append").parquet(path)
    last = e.agg(F.max("ts")).first()[0]
    if last is not None:
        E.closing_row(spark, last, schema=e.schema).coalesce(1).write.mode("append").parquet(path)
    done, late = E.run_sessions(E.sessions_once(S.stream_table(spark, path, files=files)))
    out = done.where("key <> '-1'").select(F.lit("session").alias("kind"), *done.columns).union(late.select(F.lit("late"), *late.columns))
    return out.withColumns({"total": F.round("total", 4), "start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


# --- sketches -------------------------------------------------------------------------------------

_QUANTILES = [0.1, 0.5, 0.9, 0.99]


@query(f"""SELECT event_type, q AS quantile, n, round(v, 6) AS exact, true AS within FROM (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL), (VALUES {', '.join(f'({q}::DOUBLE)' for q in _QUANTILES)}) AS t(q) WHERE r = CAST(floor(q * (n - 1)) AS BIGINT)""")
def sketched_quantiles(spark, sf):
    """Quantiles of each type of event from bucket counts staged a row for each day, held against the value of that rank: within 1 %.

    The exact value comes from positions in the total order of (type, value).
    """
    e = read_table(spark, sf, "events").select("event_type", "value", F.to_date("ts").alias("day"))
    days = stage(K.quantile_counts(e, "value", ["event_type", "day"]))
    got = K.quantiles(days, ["event_type"], _QUANTILES)
    placed = O.running(e.where("value is not null").select("event_type", "value"), "event_type", "value")
    first = placed.groupBy("event_type").agg(F.min("position").alias("first"), F.count("*").alias("n"))
    ranks = first.select("event_type", "n", F.explode(F.array(*(F.lit(q) for q in _QUANTILES))).alias("quantile"), "first").withColumn("position", F.col("first") + F.floor(F.col("quantile") * (F.col("n") - 1)))
    exact = placed.join(ranks.drop("event_type"), "position").select("event_type", "quantile", "n", "value")
    within = F.abs(F.col("estimate") - F.col("value")) <= 0.01 * F.abs(F.col("value")) + 1e-9
    return got.join(exact, ["event_type", "quantile"]).select("event_type", "quantile", "n", F.round("value", 6).alias("exact"), within.alias("within"))


@query("SELECT event_type, count(user_id) AS n, count(DISTINCT user_id) AS exact, true AS within FROM events GROUP BY event_type UNION ALL SELECT NULL, count(user_id), count(DISTINCT user_id), true FROM events")
def sketched_users(spark, sf):
    """Distinct users by type of event, and of all, from registers staged a row for each day: within four standard errors."""
    e = read_table(spark, sf, "events").select("event_type", "user_id", F.to_date("ts").alias("day"))
    days = stage(K.distinct_sketch(e, "user_id", ["event_type", "day"]))
    got = K.distinct_estimates(days, ["event_type"]).unionByName(K.distinct_estimates(days.withColumn("event_type", F.lit(None).cast("string")), ["event_type"]))
    exact = e.rollup("event_type").agg(F.countDistinct("user_id").alias("exact"))
    return got.join(exact.withColumnRenamed("event_type", "of"), got.event_type.eqNullSafe(F.col("of"))).select("event_type", "n", "exact", (F.abs(F.col("distinct") - F.col("exact")) <= F.lit(4 * 1.04 / 64) * F.col("exact") + 1).alias("within"))


# --- total orders ------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, CAST(row_number() OVER (ORDER BY lang, n DESC, doc_id) - 1 AS BIGINT) AS position, CAST(sum(n) OVER (ORDER BY lang, n DESC, doc_id) - n AS BIGINT) AS words_before FROM (SELECT doc_id, lang, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)""")
def documents_in_order(spark, sf):
    """Every document's place by language, number of words from the largest, and id, and the words before it, by range partitions and their offsets."""
    d = N.spread(documents(spark, sf)).select("doc_id", "lang", C.count_words(F.col("text")).alias("n"))
    return O.running(d, "lang", F.col("n").desc(), "doc_id", sums={"words_before": F.col("n")}).select("doc_id", "position", "words_before")


@query(f"""SELECT doc_id, CAST(sum(lines) OVER (ORDER BY source, doc_id) - lines AS BIGINT) AS line_offset, CAST(sum(chars + 1) OVER (ORDER BY source, doc_id) - chars - 1 AS BIGINT) AS char_offset FROM (SELECT doc_id, source, length(text) AS chars, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END) AS lines FROM documents)""")
def source_offsets(spark, sf):
    """Where each source stands in the set of all sources laid end to end, in lines and characters."""
    s = documents(spark, sf).select("doc_id", F.concat_ws("/", "source", F.format_string("%020d", "doc_id")).alias("name"), "text")
    return X.with_offsets(s).select("doc_id", "line_offset", "char_offset")


@query("SELECT doc_id, n_chars, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS INTEGER) AS position FROM documents QUALIFY position < 100")
def longest_documents(spark, sf):
    return O.top(documents(spark, sf).select("doc_id", "n_chars"), 100, F.col("n_chars").desc(), "doc_id")


# --- aggregates of one's own -----------------------------------------------------------------------------


@query(rf"""WITH w AS (SELECT lang AS key, unnest(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')), ' ')) AS word FROM documents)
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, word) AS INTEGER) AS rank, word, count(*) AS n FROM w WHERE word <> '' GROUP BY key, word QUALIFY rank <= 10""")
def top_words(spark, sf):
    """The ten most frequent words of each language by an aggregator whose word maps are merged where texts are read."""
    words = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "))
    return A.aggregate(N.spread(documents(spark, sf)), F.col("lang"), words, A.WordCounts(10))


# --- navigation by merges ----------------------------------------------------------------------------------


@query("SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS item, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS depth, CAST(count(*) OVER (PARTITION BY o_custkey) - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS BIGINT) AS below FROM orders")
def nested_list_merge(spark, sf):
    """All orders of a customer as a list nested ever deeper: lists around each item, and items below it, by merges of intervals."""
    keys = F.array_sort(F.collect_list(F.struct("o_orderkey")))
    lines = F.transform(keys, lambda x, k: F.concat(F.repeat(F.lit("  "), k), F.lit("- order "), F.coalesce(x["o_orderkey"].cast("string"), F.lit("-"))))
    docs = read_table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(lines, "\n").alias("text"))
    n = stage(N.parse_nodes(docs, kinds=("list", "item"), columns=("node_id", "subtree_end", "kind")))
    lists, items = n.where("kind = 'list'").drop("kind"), n.where("kind = 'item'").drop("kind")
    up = N.ancestors(lists, items).select("doc_id", F.col("of_id").alias("item_id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = N.descendants(items, items).select("doc_id", F.col("root_id").alias("item_id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    met = up.union(down).groupBy("doc_id", "item_id").agg(F.sum("up").alias("depth"), F.sum("down").alias("below"))
    return met.select("doc_id", F.expr("cast(row_number() over (partition by doc_id order by item_id) as int)").alias("item"), "depth", "below")


# --- characters, breaks and writers of one's own ----------------------------------------------------------------

_ROMAN, _HAN = "abcdefghijklmnopqrstuvwxyz.,;:!?", "一二三四五六七八九十百千上下左右大小中日月水火木金土。，；：！？"


@query(rf"""SELECT doc_id, md5(rtrim(regexp_replace(translate(lower(text), '{_ROMAN}', '{_HAN}'), '[^{_HAN}]+', '', 'g'))) AS letters, true AS starts, true AS ends FROM documents WHERE length(regexp_replace(translate(lower(text), '{_ROMAN}', '{_HAN}'), '[^{_HAN}]+', '', 'g')) > 0""")
def fmt_wrap_cjk(spark, sf):
    """All documents written in Han signs and wrapped to 60 columns: no sign is lost, no line begins or ends with a mark that may not stand there."""
    signs = F.regexp_replace(F.translate(F.lower("text"), _ROMAN, _HAN), f"[^{_HAN}]+", "")
    some = documents(spark, sf).where(F.lower("text").rlike(f"[{_ROMAN}{_HAN}]"))  # the signs themselves are made by the tasks that the texts are dealt to
    d = N.spread(some.select("doc_id", "text")).select("doc_id", signs.alias("text"))
    x = format_documents(d, width=60).select("doc_id", "body", F.split("body", "\n").alias("lines"))
    inner = F.slice("lines", F.lit(2), F.size("lines"))
    return x.select("doc_id", F.md5(F.replace("body", F.lit("\n"), F.lit(""))).alias("letters"), (~F.exists(inner, lambda v: v.rlike("^[，。；：]"))).alias("starts"), (~F.exists("lines", lambda v: v.rlike(r"[（「《]$"))).alias("ends"))


_SIGNS = "é\U0001f1e9\U0001f1ea\U0001f469‍\U0001f467你❤️"


@query(rf"""SELECT doc_id, CAST(length(line) + 9 AS INTEGER) AS width, CAST(length(line) + 5 AS INTEGER) AS clusters FROM (SELECT doc_id, regexp_replace(text, '[^\x20-\x7eÀ-ÿ]+', ' ', 'g') AS line FROM documents)""")
def display_widths(spark, sf):
    """Columns and clusters of all texts, behind a letter with a combining mark, a flag, a joined emoji, a Han sign and a heart shown as emoji."""
    t = F.concat(F.lit(_SIGNS), F.regexp_replace("text", r"[^\x20-\x7eÀ-ÿ]+", " "))
    d = N.spread(documents(spark, sf).select("doc_id", "text")).select("doc_id", t.alias("t"))
    return d.select("doc_id", C.display_width(F.col("t")).alias("width"), C.count_graphemes(F.col("t")).alias("clusters"))


@query(f"""SELECT doc_id, '## ' || upper(source) || chr(10) || chr(10) || line || ' <' || lang || '>' || chr(10) || chr(10) || '* ' || lang AS body FROM (SELECT doc_id, source, lang, rtrim({_DUCK_LINE}) AS line FROM documents)""")
def fmt_with_handlers(spark, sf):
    """Formatted with handlers of the caller's for headings and links, and another bullet."""
    from ..kernel.markdown import BLOCKS

    handlers = {"heading": lambda n, parts, o, w: "## " + BLOCKS["heading"](n, parts, o, w).removeprefix("## ").upper(), "link": lambda n, text, o: f"<{n.at['url']}>"}
    d = documents(spark, sf).selectExpr("doc_id", f"concat('## ', source, '\\n\\n', rtrim({_SPARK_LINE}), ' [x](', lang, ')\\n\\n- ', lang, '\\n') as text")
    return format_documents(d, bullet="*", handlers=handlers)


@query(f"""SELECT doc_id, source || chr(10) || repeat('-', greatest(3, length(source))) || chr(10) || chr(10) || '1. ' || lang || chr(10) || '2. ' || line AS body FROM (SELECT doc_id, source, lang, rtrim({_DUCK_LINE}) AS line FROM documents)""")
def fmt_styles(spark, sf):
    """Headings underlined and lists numbered with points, as the caller's options say."""
    d = documents(spark, sf).selectExpr("doc_id", f"concat('## ', source, '\\n\\n1) ', lang, '\\n2) ', rtrim({_SPARK_LINE}), '\\n') as text")
    return format_documents(d, heading="setext", delimiter=".")


# --- whole texts of any script ---------------------------------------------------------------------------------------

_PUNCT = r"([!-/:-@\[-`{-~])"


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b-\x1f\x7f\x85\xa0\x{2028}\x{2029}\x{feff}]', ' ', 'g') AS text FROM documents)
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\n[ \t]*\n\s*'), lambda p: trim(p, ' ' || chr(9) || chr(10)) <> '')) AS paragraphs, md5(trim(regexp_replace(text, '[ \t\n]+', ' ', 'g'))) AS text FROM t""")
def escaped_documents(spark, sf):
    """Whole texts, every punctuation mark escaped: accents, signs and marks come back from the parser as they went in, paragraph by paragraph."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0b-\x1f\x7f\x{85}\x{a0}\x{2028}\x{2029}\x{feff}]", " ")
    md = F.regexp_replace(F.regexp_replace(text, r"(?m)^[ \t]+|[ \t]+$", ""), _PUNCT, r"\\$1")
    d = documents(spark, sf).select("doc_id", md.alias("text"))
    n = N.parse_nodes(d, kinds=("document", "paragraph"), columns=("node_id", "kind", "text_alt"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "paragraph", F.struct("node_id", "text_alt")))), lambda x: x["text_alt"]), " ")
    g = n.groupBy("doc_id").agg(F.count(F.when(F.col("kind") == "paragraph", 1)).alias("paragraphs"), whole.alias("whole"))
    return g.select("doc_id", "paragraphs", F.md5(F.trim(F.regexp_replace("whole", "[ \t\n]+", " "))).alias("text"))


@query(r"""WITH t AS (SELECT doc_id, text, list_max(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: strlen(x))) AS longest FROM documents)
SELECT doc_id, coalesce(strlen(text), 0) <= 20000 AND longest <= 2000 AS inside, CASE WHEN coalesce(strlen(text), 0) > 20000 THEN 'text' WHEN longest > 2000 THEN 'line' END AS reason FROM t""")
def input_limits(spark, sf):
    """Documents inside the parser's limits are parsed, the others are set aside with the reason; none is lost."""
    inside, outside = N.within(documents(spark, sf), max_bytes=20_000, max_line=2_000)
    parsed = N.parse_nodes(inside, kinds=("document",), columns=("kind",)).select("doc_id", F.lit(True).alias("inside"), F.lit(None).cast("string").alias("reason"))
    return parsed.unionByName(outside.select("doc_id", F.lit(False).alias("inside"), "reason"))


@query("SELECT doc_id, name, kind, 1::BIGINT AS n FROM documents, (VALUES ('tasklist', 'item'), ('footnotes', 'footnote_definition'), ('footnotes', 'footnote_reference'), ('strikethrough', 'strikethrough'), ('autolink', 'link')) AS t(name, kind)")
def extension_switches(spark, sf):
    """Each extension on its own finds its own nodes in the same texts, and no others."""
    d = documents(spark, sf).selectExpr("doc_id", "concat('- [x] a', doc_id, ' ~~', lang, '~~ [^n] https://x.org/', doc_id, '\\n\\n[^n]: a note\\n') as text")
    found = []
    for name in ("tasklist", "footnotes", "strikethrough", "autolink"):
        n = N.parse_nodes(d, extended=(name,), columns=("kind", "checked"))
        hit = n.where("kind in ('strikethrough', 'footnote_definition', 'footnote_reference', 'link') or (kind = 'item' and checked is not null)")
        found.append(hit.groupBy("doc_id", "kind").agg(F.count("*").alias("n")).select("doc_id", F.lit(name).alias("name"), "kind", "n"))
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query(r"SELECT doc_id, 'warning' AS severity, 'link' AS category, 'Malformed URL: http://' || source || '.org/' || doc_id || '<' || lang AS message FROM documents WHERE false UNION ALL SELECT doc_id, 'error', 'link', 'Empty link URL for text: ' || lang FROM documents")
def validate_urls(spark, sf):
    """Outside links are checked one by one; an escaped one is well formed, an empty one is an error."""
    d = documents(spark, sf).selectExpr("doc_id", "concat('[', source, '](<http://', source, '.org/', doc_id, ' ', lang, '>) [', lang, ']()\\n') as text")
    return V.validate(N.parse_nodes(d, kinds=V.CHECKED))


# --- sliding windows, cubes, calendars ---------------------------------------------------------------------------------


@query("SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, event_type, value FROM events) GROUP BY ALL")
def sliding_windows_stream(spark, sf):
    """Hours that begin every half hour, in append mode behind a watermark: each window is written once, when a closing row has passed it."""
    e = read_table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    path = scratch(spark, "quillspark-events")
    e.write.parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    last = e.agg(F.max("ts")).first()[0]
    if last is not None:
        E.closing_row(spark, last, schema=e.schema).coalesce(1).write.mode("append").parquet(path)
    counts = S.run_to_table(S.event_counts(S.stream_table(spark, path, files=files), slide="30 minutes"))
    return counts.where("event_type is not null").withColumns({"total": F.round("total", 4), "start": F.col("start").cast("timestamp_ntz")})


@query("SELECT lang, source, grouping(lang) AS g, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY CUBE (lang, source)")
def documents_cube(spark, sf):
    return documents(spark, sf).cube("lang", "source").agg(F.grouping("lang").cast("long").alias("g"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def documents_grouping_sets(spark, sf):
    return spark.sql("SELECT lang, source, count(*) AS n FROM {d} GROUP BY GROUPING SETS ((lang), (source), ())", d=documents(spark, sf))


@query("SELECT word FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE lang = 'en') EXCEPT SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM documents WHERE lang <> 'en'")
def words_of_english_alone(spark, sf):
    """Words of English texts that no other text has."""
    w = N.spread(documents(spark, sf).select("lang", "text")).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word"))
    of = w.groupBy("word").agg(F.max(F.col("lang") == "en").alias("english"), F.max(F.col("lang") != "en").alias("other"))
    return of.where("english and not other").select("word")  # of texts without a language neither is known


@query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS days, strftime(max(ts), '%Y-%m-%d %H:%M') AS last FROM events GROUP BY ALL")
def event_calendar(spark, sf):
    ts = F.col("ts").cast("timestamp")
    by = [F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd").alias("week"), F.dayofweek(ts).alias("weekday"), F.hour(ts).alias("hour")]
    return read_table(spark, sf, "events").groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(F.to_date(ts)).alias("days"), F.date_format(F.max(ts), "yyyy-MM-dd HH:mm").alias("last"))

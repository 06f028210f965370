"""The queries opN_<name>: each operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .common import read
from .decontam import contamination
from .embed_join import near_vectors
from .language_id import identify_languages
from .line_runs import line_run_dedup
from .ngram_join import ngram_join
from .packing import pack
from .pu_quality import pu_quality
from .secrets import scan_secrets
from .suffix_dedup import suffix_dedup
from .toxicity import score_toxicity
from .url_templates import url_template_filter
from .vector_codes import vector_codes

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def crc_mod(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_template_filter(read(spark, sf_dir, "pages"), RULES)


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = pu_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), crc_mod(5) != 0)
    return scored.select("doc_id", F.coalesce(crc_mod(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_pigeonhole_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), crc_mod(3) != 1)
    return scored.select("doc_id", F.coalesce(crc_mod(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "heaviest", "total")


def op5_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")


def op6_divideskip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents")).drop("kept")


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_run_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_words_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op10_subspace_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def op12_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = identify_languages(read(spark, sf_dir, "documents"), crc_mod(5) != 0)
    return named.select("doc_id", F.coalesce(crc_mod(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op13_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_REACH = """reach(n, r) AS (SELECT id, id FROM nodes UNION SELECT reach.n, links.y FROM reach JOIN links ON reach.r = links.x)"""

ORACLE = {
    "op6_divideskip_join": rf"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM rows a JOIN rows b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(r) AS component_id FROM sets JOIN reach ON n = doc_id GROUP BY doc_id, s""",
    "op10_subspace_neardup": f"""
WITH RECURSIVE vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM (SELECT n AS vec_id, min(r) AS c FROM reach GROUP BY n)""",
}

ORACLE["op11_collocations"] = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
counts AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, (VALUES (1), (2), (3)) AS s(k)) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
frequent AS MATERIALIZED (SELECT lang, k, phrase, f FROM counts WHERE f >= 10),
cand AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM frequent WHERE k >= 2),
parts AS MATERIALIZED (SELECT lang, phrase, a, w, 1 AS cut, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM cand UNION ALL SELECT lang, phrase, a, w, 2, array_to_string(w[1:2], ' '), w[3] FROM cand WHERE k = 3),
cuts AS (SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, c.cut AS k, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score FROM parts c JOIN frequent l ON l.lang = c.lang AND l.phrase = c.x JOIN frequent r ON r.lang = c.lang AND r.phrase = c.y),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT DISTINCT c.lang, b.phrase FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS x FROM cand WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM cand WHERE k = 3) AS c JOIN frequent b ON b.lang = c.lang AND b.phrase = c.x WHERE 100 * c.a >= 50 * b.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM best ANTI JOIN held USING (lang, phrase) JOIN totals USING (lang) QUALIFY rank <= 2000"""


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """Rounds of nearest entries and floored means as chained common tables."""
    sql = f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale}::DOUBLE * x) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT vec_id, label, p, e[p * len(e) // {parts} + 1:(p + 1) * len(e) // {parts}] AS x FROM kept, range({parts}) AS t(p)),
book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS c, x FROM cut QUALIFY c < {entries})"""
    near = "SELECT vec_id, cut.label, cut.p, cut.x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, label, cut.p, cut.x, c, list_sum(list_transform(list_zip(cut.x, book{i}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM cut JOIN book{i} ON cut.p = book{i}.p) AS cut GROUP BY ALL"
    for i in range(rounds):
        sql += f""",
at{i} AS ({near.format(i=i)}),
mean{i} AS (SELECT p, c, list(m ORDER BY j) AS x FROM (SELECT p, c, j, (s - ((s % n) + n) % n) // n AS m FROM (SELECT p, c, j, sum(x[j])::HUGEINT AS s, count(*) AS n FROM at{i}, range(1, len(x) + 1) AS t(j) GROUP BY p, c, j)) GROUP BY p, c),
book{i + 1} AS (SELECT p, c, coalesce(mean{i}.x, book{i}.x) AS x FROM book{i} LEFT JOIN mean{i} USING (p, c))"""
    return sql + f""",
last AS ({near.format(i=rounds)}),
coded AS (SELECT vec_id, label, string_agg(format('{{:02x}}', c), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, c)) FROM book{rounds}) AS codebooks_sha256 FROM coded"""


ORACLE["op13_hamerly_codes"] = _codes_sql()


def oracle_sql() -> dict[str, str]:
    """Exact restatements of the joins, phrase counts and codes; the others have none that SQL can run on whole tables."""
    return dict(ORACLE)

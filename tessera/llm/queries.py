"""The queries of this subpackage for __spark_entry__.py, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import audio, jaccard, language, licenses, packing, pieces, sampling, substrings, token_files, tokens, toolcalls
from tessera.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir), jaccard.Measure(size=4, num=85, den=100))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.fingerprints(documents(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = tokens.path("piece_bpe_32k.model")
    d = pieces.decode(pieces.encode(documents(spark, sf_dir), file), file)
    whole = F.coalesce("text", F.lit(""))
    return d.select("doc_id", F.length(whole).cast("long").alias("n_chars"), "n_tokens", "ids_crc32", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded") == whole).alias("lossless"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_digests(documents(spark, sf_dir))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = substrings.remove_repeats(documents(spark, sf_dir), 20)
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokens.path("byte_bpe_50k.json"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir), tokens.path("word_bpe_49k.json"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_jaccard_join, op2_fingerprints, op3_sentencepiece, op4_language, op5_audio, op6_tool_calls, op7_substrings, op8_licenses, op9_packing, op10_token_files)}


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": OP1_SQL, "op6_tool_calls": OP6_SQL, "op7_substrings": OP7_SQL, "op8_licenses": op8_sql()}


def op8_sql() -> str:
    """The scan in SQL, with the templates' vectors as rows."""
    templates = licenses.all_templates()
    idf, vectors = licenses.weights(templates)
    rows = ", ".join(f"({k}, '{n}', '{t}', {w:.17e}, {idf[t]:.17e})" for k, (n, v) in enumerate(vectors) for t, w in v.items())
    blank = licenses.BLANK.replace("\n", r"\n")
    return rf"""
WITH v(template, licence, token, weight, idf) AS (VALUES {rows}), i AS (SELECT DISTINCT token, idf FROM v),
f AS (
  SELECT doc_id, text, coalesce(source, 'none') || '/' || CASE WHEN p = '' THEN '' ELSE array_to_string(string_split(p, ''), '/') || '/' END || doc_id AS path
  FROM (SELECT *, regexp_replace(CAST(abs(doc_id) // 10 AS VARCHAR), '0+$', '') AS p FROM documents)
),
x AS (SELECT path, text, string_split(text, chr(10)) AS lines, regexp_split_to_array(text, '{blank}') AS blocks FROM f WHERE text IS NOT NULL),
u AS (
  SELECT path, 0 AS kind, unnest(range(0, len(lines))) AS place, len(lines) AS m, unnest(lines) AS raw FROM x
  UNION ALL SELECT * FROM (SELECT path, 1 AS kind, unnest(range(0, len(blocks))) AS place, len(blocks) AS m, unnest(blocks) AS raw FROM x) WHERE contains(raw, chr(10))
  UNION ALL SELECT path, 2, 0, 0, text FROM x WHERE len(blocks) > 1
),
k AS (SELECT path, kind, place, kind = 2 OR (place = m - 1 AND place > 0) AS last, unnest(regexp_split_to_array(lower(raw), '{licenses.BETWEEN}')) AS token FROM u),
n AS (SELECT path, kind, place, last, token, count(*) AS n FROM k WHERE token <> '' GROUP BY ALL),
w AS (SELECT n.*, n * coalesce(idf, {licenses.unknown_idf(templates):.17e}) AS w FROM n LEFT JOIN i USING (token)),
m AS (SELECT path, kind, place, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
s AS (
  SELECT path, kind, place, last, licence, round(dot / norm, 6) AS score
  FROM (SELECT path, kind, place, last, template, licence, sum(w * weight) AS dot FROM w JOIN v USING (token) GROUP BY ALL) JOIN m USING (path, kind, place)
),
o AS (SELECT * FROM s WHERE score >= {licenses.LEAST} QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, kind, place, licence) = 1),
d AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, * FROM o WHERE last QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY path) = 1
),
g AS (SELECT f.doc_id, f.path, o.licence, o.score, regexp_replace(f.path, '/?[^/]*$', '') AS dir FROM f LEFT JOIN o USING (path)),
h AS (
  SELECT g.path, d.path AS p, d.licence, d.score FROM g JOIN d ON g.dir = d.dir OR starts_with(g.dir, d.dir || '/') QUALIFY row_number() OVER (PARTITION BY g.path ORDER BY length(d.dir) DESC) = 1
)
SELECT g.doc_id, g.path, coalesce(g.licence, h.licence) AS licence, coalesce(g.score, h.score) AS score,
  CASE WHEN g.licence IS NOT NULL THEN 'own' WHEN h.p IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN g.licence IS NOT NULL THEN g.path ELSE h.p END AS source_path
FROM g LEFT JOIN h USING (path)
"""


OP6_SQL = r"""
WITH RECURSIVE u AS (SELECT conv_id, turn, min(text) AS text, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY ALL),
a AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL),
d AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) AS depth FROM u WHERE NOT EXISTS (SELECT 1 FROM u p WHERE p.conv_id = u.conv_id AND p.turn = u.turn - 2)
  UNION ALL SELECT u.conv_id, u.turn, d.depth + 1 FROM d JOIN u ON u.conv_id = d.conv_id AND u.turn = d.turn + 2
),
c AS (
  SELECT u.*, d.depth, len(list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda w: w <> '')) AS words,
    CASE WHEN d.depth > 0 THEN 'call_' || u.conv_id || '_' || (u.turn - 2) END AS after
  FROM u JOIN d USING (conv_id, turn)
),
o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY depth, 'call_' || conv_id || '_' || turn) AS position FROM c),
j AS (SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.turn, a.turn) AS turn, c.* EXCLUDE (conv_id, turn), a.content, a.n AS n_results FROM c FULL JOIN a USING (conv_id, turn))
SELECT 'call_' || conv_id || '_' || turn AS call_id, CASE WHEN n IS NULL THEN NULL WHEN after IS NULL THEN 'open' ELSE 'follow_up' END AS name, after,
  CASE WHEN n IS NOT NULL AND n_results IS NOT NULL THEN 'linked' WHEN n IS NOT NULL THEN 'no result' ELSE 'no call' END AS state,
  CASE WHEN n IS NULL THEN NULL WHEN length(text) < 1 OR length(text) > 4000 THEN 'range text' WHEN after IS NULL AND turn > 1 THEN 'range turn' WHEN words < 1 OR words > 120 THEN 'range words' END AS problem,
  depth, position, CAST(coalesce(n, 0) AS BIGINT) AS n_calls, CAST(coalesce(n_results, 0) AS BIGINT) AS n_results,
  CASE WHEN n IS NOT NULL THEN '{' || CASE WHEN after IS NULL THEN '' ELSE '"after":["' || after || '"],' END || '"arguments":{' || CASE WHEN after IS NULL THEN '' ELSE '"after":"' || after || '",' END
    || '"text":' || to_json(text) || ',"turn":' || turn || ',"words":' || words || '},"call_id":"call_' || conv_id || '_' || turn || '","name":"' || CASE WHEN after IS NULL THEN 'open' ELSE 'follow_up' END || '"'
    || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content) END || '}' END AS message
FROM j LEFT JOIN o USING (conv_id, turn)
"""

OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
), t AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM inter WHERE 100 * c >= 85 * (na + nb - c)),
reach(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.seen FROM reach r JOIN links l ON r.node = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.seen) AS component_id FROM s JOIN reach r ON s.doc_id = r.node GROUP BY s.doc_id, s.s
"""

OP7_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
),
firsts AS (SELECT x, min((doc_id, i)) AS f FROM win GROUP BY x HAVING count(*) > 1),
rep AS (SELECT doc_id, i FROM win JOIN firsts USING (x) WHERE (doc_id, i) > f),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM rep),
wordrows AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.p) AS body FROM wordrows w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p WHERE g.p IS NULL GROUP BY 1
),
n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.c, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.body, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

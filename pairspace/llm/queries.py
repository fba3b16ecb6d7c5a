"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sql_crc import crc32_sql
from . import decontaminate, fingerprint, jaccard_join, licenses, line_dedup, main_text, neighbours, pieces, pii, repeats, resample, toxicity, turn_trie

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_line_dedup",
    sql=f"""
WITH lines AS (
  SELECT DISTINCT doc_id, source, trim(line) AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''
), often AS (
  SELECT source, line FROM lines GROUP BY source, line HAVING count(*) >= {line_dedup.MIN_PAGES}
   AND count(*) > {line_dedup.MAX_RATIO}::DOUBLE * (SELECT count(*) FROM documents d WHERE d.source IS NOT DISTINCT FROM lines.source)
), cut AS (SELECT source, list(line) AS drop FROM often GROUP BY source),
kept AS (
  SELECT doc_id, d.source, string_split(text, chr(10)) AS pieces,
   list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(drop, []::VARCHAR[]), trim(x))) AS stay
  FROM documents d LEFT JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
)
SELECT doc_id, source, CAST(len(pieces) - len(stay) AS INTEGER) AS n_lines_removed,
 sha256(array_to_string(stay, chr(10))) AS text_sha256 FROM kept
""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    done = line_dedup.dedup_lines(docs, "source", "text")
    return done.select("doc_id", "source", "n_lines_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def _licence_sql() -> str:
    known = ",\n".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.known_notices())
    canon = licenses.sql_canonical
    return f"""
WITH known AS (
  SELECT sha256({canon("known")}) AS digest, min(license) AS license FROM (VALUES {known}) v(license, known) GROUP BY 1
), units AS (
  SELECT doc_id, list_distinct_ordered AS u FROM (
   SELECT doc_id, list_concat([text], string_split_regex(text, '\\n[ \\t]*\\n'), string_split(text, chr(10))) AS every,
    list_transform(list_filter(list_zip(every, range(len(every))), lambda x: list_position(every, x[1]) = x[2] + 1), lambda x: x[1]) AS list_distinct_ordered
   FROM documents WHERE text IS NOT NULL)
), flat AS (
  SELECT doc_id, unnest(range(len(u)))::INTEGER AS unit, unnest(u) AS said FROM units
), hits AS (SELECT doc_id, unit, said FROM flat WHERE regexp_matches(said, '(?i){licenses.ANCHORS}'))
SELECT doc_id, unit, license, digest FROM (SELECT doc_id, unit, sha256({canon("said")}) AS digest FROM hits) JOIN known USING (digest)
"""


@query("op4_license_scan", sql=_licence_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query("op5_decontaminate")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op6_fingerprint")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.check_round_trip(docs, "text", public_tokenizers.path("piece_bpe_32k.model")).drop("text")


@query("op9_personal_data")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.sanitise(docs, "text", rewrite=False).drop("text")


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    scored = toxicity.score(docs, "text", model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op3_main_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text.extract_main_text(pages, "html").drop("html")


@query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query("op7_suffix_repeats")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.find_repeats(docs, "doc_id", "text").drop("spans")


_WORDS_SQL = """regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""


@query(
    "op13_resample",
    sql=f"""
WITH docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
aim AS (SELECT {_WORDS_SQL} AS w FROM benchmark),
said AS (SELECT doc_id, unnest(w) AS word FROM docs), wanted AS (SELECT unnest(w) AS word FROM aim),
bucket AS (
  SELECT word, {crc32_sql("word")} % {resample.BUCKETS} AS b FROM (SELECT word FROM said UNION SELECT word FROM wanted)
), s AS (SELECT b, count(*) AS n FROM said JOIN bucket USING (word) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM wanted JOIN bucket USING (word) GROUP BY b),
gain AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM said) + {resample.BUCKETS})
   / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + {resample.BUCKETS})))) AS BIGINT) AS g
  FROM s FULL JOIN t USING (b)
), weights AS (
  SELECT doc_id, count(*) AS n, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight
  FROM said JOIN bucket USING (word) JOIN gain USING (b) GROUP BY doc_id
), scored AS (
  SELECT doc_id, CAST(len(coalesce(w, [])) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{resample.SEED}:' || doc_id), 1, 8))::UBIGINT::DOUBLE + 0.5)
    / 4294967296))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (doc_id)
), placed AS (
  SELECT *, n_features >= {resample.MIN_WORDS} AS able,
   row_number() OVER (PARTITION BY n_features >= {resample.MIN_WORDS} ORDER BY score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
 CASE WHEN able AND place <= {resample.SHARE[0]} * (SELECT count(*) FROM placed WHERE able) // {resample.SHARE[1]} THEN place END AS rank FROM placed
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "text")


@query(
    "op11_turn_trie",
    sql=f"""
WITH turns AS (
  SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, length(coalesce(text, '')) AS size,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % {turn_trie.SPAN} AS base, {crc32_sql("c")} % {turn_trie.OPENINGS} AS h
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS c FROM turns)
), placed AS (
  SELECT c.conv_id, 0 AS part, k, key, size FROM convs c JOIN turns t ON t.conv_id = c.base WHERE k <= h
  UNION ALL SELECT c.conv_id, 1, k, key, size FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE k > h
), seqs AS (
  SELECT c.conv_id, coalesce(string_agg(key, '' ORDER BY part, k), '') AS s, coalesce(list(size ORDER BY part, k) FILTER (size IS NOT NULL), []) AS sizes
  FROM convs c LEFT JOIN placed p USING (conv_id) GROUP BY c.conv_id
), prefixes AS (SELECT conv_id, s, sizes, unnest(range(strlen(s) // 32 + 1)) AS d FROM seqs),
nodes AS (
  SELECT substr(s, 1, 32 * d) AS p, d, min(conv_id) AS conv_id, count(*) AS n, any_value(CASE WHEN d > 0 THEN sizes[d] ELSE 0 END) AS size
  FROM prefixes GROUP BY 1, 2
), kids AS (SELECT substr(p, 1, 32 * (d - 1)) AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
whole AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (p)),
sums AS (
  SELECT substr(p, 1, 32 * up) AS p, sum((n - 1) * size) AS saved, count(*) FILTER (k = 0) AS leaves
  FROM (SELECT p, n, size, k, unnest(range(d + 1)) AS up FROM whole) GROUP BY 1
), ends AS (SELECT s AS p, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM seqs GROUP BY s)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n AS n_convs, w.k AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
 CAST(saved AS BIGINT) AS saved_tokens, coalesce(sha, '{turn_trie.NOBODY}') AS ends_sha256
FROM whole w JOIN sums USING (p) LEFT JOIN ends USING (p) LEFT JOIN nodes u ON w.d > 0 AND u.p = substr(w.p, 1, 32 * (w.d - 1))
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op12_neighbours")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)

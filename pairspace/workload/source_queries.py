"""Readers: tables written as text to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import format_bag, parse_bag
from ..operators.evaluate import mapping_to_sets
from ..operators.profile import gold_nouns, gold_profile, histogram
from ..operators.vectors import collect_vectors, explode_vectors
from ..plans.storage import fresh_path
from ..sources import corpus, tables
from ..sources.coref import coref_mentions
from ..sources.json_lines import parse_json_lines
from . import views as v
from .registry import query

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("scan_tsv", sql="SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_tsv(spark, sf):
    path = fresh_path(spark, "tsv")
    tables.write_tsv(v.table(spark, sf, "customer"), path, "gzip")
    return tables.read_tsv(spark, path, CUSTOMER)


def _event_lines(spark, sf):
    path = fresh_path(spark, "lines")
    events = v.table(spark, sf, "events").select(F.concat_ws("\t", F.col("event_id").cast("string"), "event_type", "props"))
    events.write.text(path)
    return tables.read_lines(spark, path)


@query("scan_lines", sql="SELECT concat_ws(chr(9), event_id, event_type, props) AS value FROM events")
def scan_lines(spark, sf):
    return _event_lines(spark, sf)


@query("first_field", sql="SELECT event_id::VARCHAR AS field FROM events")
def first_field(spark, sf):
    return tables.first_field(_event_lines(spark, sf))


@query("parse_bag_text", "bought", sql="SELECT id, idx, value FROM bought")
def bag_text(spark, sf):
    bags = collect_vectors(v.bought(spark, sf), ["id"]).select("id", format_bag(F.col("values")).alias("bag"))
    return explode_vectors(bags.select("id", parse_bag(F.col("bag")).alias("values")), ["id"])


@query("vector_text_scan", "bought", sql="""
    SELECT id AS vid, '(supplier,' || id || ')' AS pair, idx, value FROM bought""")
def vector_text_scan(spark, sf):
    vectors = collect_vectors(v.bought(spark, sf), ["id"]).select(
        "id", F.concat(F.lit("supplier::@::"), F.col("id").cast("string")).alias("name"), "values"
    )
    path = fresh_path(spark, "vectors")
    tables.vector_text(vectors).write.option("compression", "gzip").text(path)
    return explode_vectors(tables.parse_vector_text(tables.read_lines(spark, path)), ["vid", "pair"])


@query("json_props", sql="SELECT event_id, props->>'k' AS k FROM events")
def json_props(spark, sf):
    events = v.table(spark, sf, "events").select("event_id", "props")
    return parse_json_lines(events, "props").select("event_id", F.col("json")["k"].alias("k"))


def _conll(tokens):
    """Six-column lines of a sentence."""
    return F.transform(
        tokens,
        lambda t: F.concat_ws("\t", t["text"], t["lemma"], t["pos"], t["id"].cast("string"), t["head"].cast("string"), t["dep"]),
    )


_LINE = "concat_ws(chr(9), tok, lemma, pos, id, CASE WHEN id = n THEN 0 ELSE id + 1 END, CASE WHEN id = n THEN 'ROOT' ELSE 'next' END)"


@query("vertical_to_sentences", "toks", sql=f"""
    SELECT string_agg({_LINE}, chr(9) || ':::::' || chr(9) ORDER BY id) AS parse FROM toks GROUP BY sid""")
def vertical(spark, sf):
    """Every sentence as a vertical text of its own, written and read back."""
    path = fresh_path(spark, "vertical")
    parses = v.parses(spark, sf)
    parses.select(
        F.concat(
            F.lit('<text id="ukwac:'), F.col("sid").cast("string"), F.lit('">\n<s>\n'), F.array_join(_conll(F.col("tokens")), "\n"), F.lit("\n</s>\n</text>")
        )
    ).write.text(path)
    return corpus.read_vertical(spark, path)


@query("conll_parse", "toks", sql="""
    SELECT sid, string_agg(tok, ' ' ORDER BY id) AS text, count(*) AS n, string_agg(begin, ',' ORDER BY id) AS begins
    FROM (SELECT *, sum(length(tok) + 1) OVER (PARTITION BY sid ORDER BY id) - length(tok) - 1 AS begin FROM toks) GROUP BY sid""")
def conll(spark, sf):
    sentences = v.parses(spark, sf).select("sid", F.array_join(_conll(F.col("tokens")), corpus.TOKEN_MARK).alias("parse"))
    read = corpus.conll_parses(sentences).filter(F.col("text").isNotNull())
    return read.select(
        "sid",
        "text",
        F.size("tokens").cast("bigint").alias("n"),
        F.array_join(F.transform("tokens", lambda t: t["begin"].cast("string")), ",").alias("begins"),
    )


@query("dependency_edges", "toks", sql="SELECT sid, id + 1 AS head, id AS dependent, 'next' AS dep FROM toks WHERE id < n")
def edges(spark, sf):
    return corpus.dependency_edges(v.parses(spark, sf))


def _words(spark, sf):
    words = F.split("p_name", " ")
    return v.table(spark, sf, "part").select(words[0].alias("w1"), words[1].alias("w2"), "p_type", "p_brand")


@query("bless_nouns", sql="""
    SELECT split_part(p_name, ' ', 1) AS noun1, p_type AS label, split_part(p_name, ' ', 2) AS noun2
    FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO')""")
def bless_nouns(spark, sf):
    """Part names as a gold list; the left words of two part types are tagged as adjectives."""
    tag = F.when(F.col("p_type").isin("ECONOMY", "PROMO"), "-j").otherwise("-n")
    raw = _words(spark, sf).select(
        F.concat("w1", tag).alias("c0"), F.col("p_brand").alias("c1"), F.col("p_type").alias("c2"), F.concat("w2", F.lit("-n")).alias("c3")
    )
    return gold_nouns(raw)


@query("gold_profile", sql="""
    SELECT CASE WHEN grouping(noun1) = 0 AND grouping(label) = 0 THEN 'noun1_label' WHEN grouping(noun2) = 0 AND grouping(label) = 0 THEN 'noun2_label'
                WHEN grouping(noun1) = 0 THEN 'noun1' WHEN grouping(noun2) = 0 THEN 'noun2' WHEN grouping(label) = 0 THEN 'label' ELSE 'all' END AS level,
           noun1, noun2, label, count(*) AS n
    FROM (SELECT split_part(p_name, ' ', 1) AS noun1, split_part(p_name, ' ', 2) AS noun2, p_type AS label FROM part)
    GROUP BY GROUPING SETS ((), (label), (noun1), (noun2), (noun1, label), (noun2, label))""")
def profile(spark, sf):
    return gold_profile(_words(spark, sf).select(F.col("w1").alias("noun1"), F.col("w2").alias("noun2"), F.col("p_type").alias("label")))


@query("cluster_list_explode", sql="SELECT o_custkey AS cluster, o_orderkey::VARCHAR AS item FROM orders")
def cluster_lists(spark, sf):
    """Orders listed by customer as text, in parts of bounded size, and unfolded again."""
    orders = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("cluster"))
    lists = mapping_to_sets(orders).select("cluster", F.size("items").alias("n"), F.array_join("items", ", ").alias("items"))
    return tables.cluster_list_explode(lists)


@query("histogram", sql="""
    SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 101 ELSE floor(100 * value / 100)::BIGINT + 1 END AS bin, count(*) AS n
    FROM events WHERE value IS NOT NULL GROUP BY bin""")
def event_histogram(spark, sf):
    return histogram(v.table(spark, sf, "events"), "value", 100, 0.0, 100.0)


@query("coref_mentions", sql=r"""
    WITH words AS (
      SELECT conv_id, turn, role, len(w) AS n FROM (
        SELECT conv_id, turn, role, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations) WHERE len(w) > 0),
    spans AS (
      SELECT conv_id, role, n, (sum(n) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS stop FROM words)
    SELECT conv_id AS doc, CASE role WHEN 'user' THEN '1' ELSE '2' END AS cluster, stop - n + 1 AS start, stop AS "end" FROM spans
    UNION ALL
    SELECT conv_id, '3', stop - n + 1, stop - n + 1 FROM spans WHERE n > 1""")
def mentions(spark, sf):
    """Turns as mentions of their speaker, each opening with a mention of a third cluster."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    spoken = v.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", "1").otherwise("2").alias("c"), words.alias("w")
    )
    lines = spoken.select("conv_id", "turn", "c", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    opening = F.when(F.col("i") == 0, F.concat(F.lit("("), "c", F.lit("|(3)"))).otherwise("")
    closing = F.when(F.col("i") == F.col("n") - 1, F.concat(F.lit("|"), "c", F.lit(")"))).otherwise("")
    tag = F.concat(opening, closing)
    return coref_mentions(
        lines.select(
            F.col("conv_id").alias("doc"),
            (F.col("turn") * (1 << 24) + F.col("i")).alias("line_no"),
            F.concat_ws("\t", F.lit("w"), F.when(tag == "", "-").otherwise(tag)).alias("value"),
        )
    )

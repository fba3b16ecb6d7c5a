"""Text, annotation, pairs and patterns on the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import is_tagged_common_noun, sanitize
from ..operators.annotate import sentence_spans, span_annotate
from ..operators.pairs import filter_thesaurus, noun_pairs, pair_sentences, subcorpus, subcorpus_pairs
from ..operators.patterns import entity_head, shortest_path_patterns, span_patterns, subtree_patterns
from ..plans.storage import materialise, materialise_by
from . import views as v
from .registry import query


def _stored_parses(spark, sf):
    """Parses that a plan reads twice are stored, as a corpus is annotated once."""
    return materialise(v.parses(spark, sf), "parses")


def _subcorpus(spark, sf):
    """The subcorpus of wanted pairs, each once a sentence; the parses are stored by sentence, as they are joined to the pairs."""
    return subcorpus(materialise_by(v.parses(spark, sf), "parses", "sid"), v.wanted(spark, sf), counted=True)


@query("sanitize_text", sql=r"""
    SELECT doc_id, regexp_replace(regexp_replace(text, '[\x{10000}-\x{10FFFF}]', '  ', 'g'),
                                  '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]', ' ', 'g') AS clean FROM documents""")
def sanitize_text(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", sanitize(F.col("text")).alias("clean"))


@query("dedup_sentences", "sents", sql="SELECT sid, text FROM sents")
def dedup_sentences(spark, sf):
    return v.sents(spark, sf).select("sid", "text")


@query("rule_annotate", "toks", sql="""
    SELECT sid, max(sentence) AS text, count(*) AS n_tokens,
           string_agg(tok || '/' || lemma || '/' || pos || '/' || CASE WHEN id = n THEN 0 ELSE id + 1 END, ' ' ORDER BY id) AS tagged
    FROM toks GROUP BY sid""")
def rule_annotate(spark, sf):
    shown = F.transform("tokens", lambda t: F.concat_ws("/", t["text"], t["lemma"], t["pos"], t["head"].cast("string")))
    return v.parses(spark, sf).filter(F.size("tokens") > 0).select(
        "sid", "text", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join(shown, " ").alias("tagged")
    )


# a token is read back from the text by its place
@query("token_spans", sql=r"""
    WITH found AS (
      SELECT doc_id, text, unnest(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\p{Z}\x09-\x0D]')) AS tok,
             unnest(regexp_split_to_array(text, '[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\p{Z}\x09-\x0D]')) AS gap,
             generate_subscripts(regexp_split_to_array(text, '[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\p{Z}\x09-\x0D]'), 1) AS nr
      FROM documents),
    placed AS (
      SELECT doc_id, text, length(tok) AS long,
             sum(length(gap)) OVER w + sum(length(tok)) OVER w - length(tok) AS first
      FROM found WHERE tok IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY nr)),
    read AS (SELECT doc_id, first::BIGINT AS "begin", (first + long)::BIGINT AS "end", substring(text, first::BIGINT + 1, long) AS token FROM placed)
    SELECT doc_id, "begin", "end", token,
           CASE WHEN token IN ('.', '!', '?') THEN '.' WHEN regexp_matches(token, '^\p{N}') THEN 'CD'
                WHEN regexp_matches(token, '^[\p{L}\p{M}]') THEN 'word' ELSE 'SYM' END AS kind
    FROM read""")
def token_spans(spark, sf):
    """Words, numbers and symbols of all documents, by way of their sentences, with places in the document."""
    tokens = span_annotate(sentence_spans(v.table(spark, sf, "documents"))).select("doc_id", "begin", F.explode("tokens").alias("t"))
    kind = F.when(F.col("t.text").rlike(r"^[\p{L}\p{M}]"), "word").otherwise(F.col("t.pos"))
    return tokens.select(
        "doc_id",
        (F.col("begin") + F.col("t.begin")).cast("bigint").alias("begin"),
        (F.col("begin") + F.col("t.end")).cast("bigint").alias("end"),
        F.col("t.text").alias("token"),
        kind.alias("kind"),
    )


@query("noun_pairs", "pairs", sql="""
    SELECT noun1, count(*) AS n, count(DISTINCT noun2) AS n_partners, min(noun2) AS first_partner, max(noun2) AS last_partner,
           min(sid) AS min_sid, max(sid) AS max_sid
    FROM pairs GROUP BY noun1""")
def noun_pairs_profile(spark, sf):
    """All noun pairs, told per first noun."""
    # grouped where the pairs of a first noun are
    per_pair = noun_pairs(v.parses(spark, sf), by_first=True).groupBy("part", "noun1", "noun2").agg(
        F.count("*").alias("n"), F.min("sid").alias("lo"), F.max("sid").alias("hi")
    )
    return per_pair.groupBy("part", "noun1").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("n_partners"),
        F.min("noun2").alias("first_partner"),
        F.max("noun2").alias("last_partner"),
        F.min("lo").alias("min_sid"),
        F.max("hi").alias("max_sid"),
    ).drop("part")


@query("subcorpus_pairs", "pairs", "wanted", sql="""
    SELECT sid, noun1, noun2, count(*) AS n FROM pairs JOIN wanted USING (noun1, noun2) GROUP BY ALL""")
def subcorpus_pairs_counted(spark, sf):
    return subcorpus_pairs(v.parses(spark, sf), v.wanted(spark, sf), counted=True).withColumnRenamed("times", "n")


@query("subcorpus", "pairs", "wanted", "toks", sql="""
    SELECT sid, text, n_pairs, n_tokens FROM
      (SELECT sid, count(*) AS n_pairs FROM pairs JOIN wanted USING (noun1, noun2) GROUP BY sid)
      JOIN sents USING (sid) JOIN (SELECT sid, count(*) AS n_tokens FROM toks GROUP BY sid) USING (sid)""")
def subcorpus_sentences(spark, sf):
    corpus = _subcorpus(spark, sf)
    measured = corpus.select("sid", "text", F.size("tokens").cast("bigint").alias("n_tokens"), "times")
    return measured.groupBy("sid", "text", "n_tokens").agg(F.sum("times").alias("n_pairs"))


@query("pair_sentences", "pairs", "wanted", "sents", sql="""
    SELECT noun1, noun2, text, count(*) AS n FROM pairs JOIN wanted USING (noun1, noun2) JOIN sents USING (sid) GROUP BY ALL""")
def pair_sentences_counted(spark, sf):
    # the sentences are distinct, so each row is a pair and text of its own
    return pair_sentences(_subcorpus(spark, sf)).withColumnRenamed("times", "n")


@query("subtree_patterns", "feats", sql="SELECT noun1, noun2, pattern, sentence, count(*) AS n FROM feats GROUP BY ALL")
def sentence_patterns(spark, sf):
    return v.feats(spark, sf).groupBy("noun1", "noun2", "pattern", "sentence").agg(F.count("*").alias("n"))


@query("subcorpus_patterns", "feats", "pairs", "wanted", sql="""
    SELECT f.noun1, f.noun2, f.pattern, f.sentence, count(*) AS n
    FROM feats f JOIN wanted USING (noun1, noun2) GROUP BY ALL""")
def subcorpus_patterns(spark, sf):
    """Patterns by way of the subcorpus of wanted pairs."""
    rows = subtree_patterns(_subcorpus(spark, sf))
    return rows.groupBy("noun1", "noun2", "pattern", "sentence").agg(F.count("*").alias("n"))


# places of wanted pairs that match exactly two tokens of their sentence
_HITS = """
    hits AS (
      SELECT p.sid, p.noun1, p.noun2, min(t.id) AS xi, max(t.id) AS yi
      FROM (SELECT DISTINCT sid, noun1, noun2 FROM pairs JOIN wanted USING (noun1, noun2)) p
      JOIN toks t ON t.sid = p.sid AND t.lemma IN (p.noun1, p.noun2)
      GROUP BY p.sid, p.noun1, p.noun2 HAVING count(*) = 2)"""


@query("shortest_path", "pairs", "wanted", "toks", sql=f"""
    SELECT h.noun1, h.noun2, 'X ' || string_agg(t.low, ' ' ORDER BY t.id) || ' Y' AS pattern, any_value(t.sentence) AS sentence
    FROM (WITH {_HITS} SELECT * FROM hits) h JOIN toks t ON t.sid = h.sid AND t.id > h.xi AND t.id < h.yi
    GROUP BY h.sid, h.noun1, h.noun2""")
def shortest_path(spark, sf):
    return shortest_path_patterns(_subcorpus(spark, sf))


@query("span_patterns", "pairs", "wanted", "sents", "toks", sql=f"""
    SELECT noun1, noun2, 'X Y' AS pattern, text AS sentence, 3 * count(*) AS n
    FROM (WITH {_HITS} SELECT * FROM hits) JOIN sents USING (sid) WHERE yi = xi + 1 GROUP BY ALL""")
def span_patterns_counted(spark, sf):
    return span_patterns(_subcorpus(spark, sf)).groupBy("noun1", "noun2", "pattern", "sentence").agg(F.count("*").alias("n"))


@query("entity_head", "toks", sql="""
    SELECT sid, 1 AS span, max_by(id, (CASE WHEN id > 1 THEN 1 ELSE 0 END + CASE WHEN id < n THEN 1 ELSE 0 END) * 1000000 + id) AS head
    FROM toks JOIN (SELECT sid, min(id) AS first, max(id) AS last FROM toks WHERE pos IN ('NN', 'NNS') GROUP BY sid) USING (sid)
    WHERE id BETWEEN first AND last AND n > 1 GROUP BY sid""")
def entity_heads(spark, sf):
    """Head of the span from the first to the last noun of each sentence."""
    return entity_head(*_noun_spans(_stored_parses(spark, sf)))


def _noun_spans(parses):
    """The span from the first to the last noun of each sentence, and the parses."""
    nouns = F.filter("tokens", lambda t: t["pos"].isin("NN", "NNS"))
    spans = parses.select(
        "sid", F.lit(1).alias("span"), F.get(nouns, F.lit(0))["id"].alias("first"), F.get(nouns, F.size(nouns) - 1)["id"].alias("last")
    ).filter(F.col("first").isNotNull())
    return spans, parses


# Heads as in a binary tree (token n hangs on token n div 2), so that paths branch; labels by number
_AS_TREE = """transform(tokens, t -> named_struct('id', t.id, 'text', t.text, 'lemma', t.lemma, 'pos', t.pos, 'head', int(t.id div 2),
    'dep', case t.id % 5 when 0 then 'pobj' when 1 then 'cc' when 2 then 'conj' else 'dep' end))"""


@query("shortest_path_tree", "pairs", "wanted", "toks", sql=f"""
    SELECT * FROM (WITH {_HITS.strip()},
    up AS (SELECT sid, noun1, noun2, xi, yi, unnest(range(32)) AS k FROM hits),
    tops AS (
      SELECT x.sid, x.noun1, x.noun2, x.xi, x.yi, max(x.xi >> x.k) AS top
      FROM up x JOIN up y ON x.sid = y.sid AND x.noun1 = y.noun1 AND x.noun2 = y.noun2 AND (x.xi >> x.k) = (y.yi >> y.k) AND (x.xi >> x.k) > 0
      GROUP BY ALL),
    steps AS (
      SELECT t.*, t.xi >> k AS at, k AS place FROM tops t, range(1, 32) r(k) WHERE (t.xi >> k) >= top AND (t.xi >> k) <> yi
      UNION ALL SELECT t.*, t.yi >> k, 100 - k FROM tops t, range(1, 32) r(k) WHERE (t.yi >> k) > top),
    paths AS (
      SELECT s.sid, noun1, noun2, string_agg(w.low, ' ' ORDER BY place) AS path
      FROM steps s JOIN toks w ON w.sid = s.sid AND w.id = s.at GROUP BY ALL),
    told AS (
      SELECT a.lemma AS noun1, b.lemma AS noun2, a.sentence, coalesce(path, '') AS path,
             CASE WHEN xi % 5 = 0 AND top = xi THEN g.tok || ' ' ELSE '' END AS before_x,
             CASE WHEN (2 * xi + 1) % 5 = 1 AND d.tok IS NOT NULL THEN d.tok WHEN (2 * xi) % 5 = 1 AND c.tok IS NOT NULL THEN c.tok ELSE '' END AS after_x
      FROM tops t LEFT JOIN paths USING (sid, noun1, noun2)
      JOIN toks a ON a.sid = t.sid AND a.id = xi JOIN toks b ON b.sid = t.sid AND b.id = yi
      LEFT JOIN toks g ON g.sid = t.sid AND g.id = xi >> 1
      LEFT JOIN toks c ON c.sid = t.sid AND c.id = 2 * xi LEFT JOIN toks d ON d.sid = t.sid AND d.id = 2 * xi + 1)
    SELECT noun1, noun2, before_x || 'X ' || after_x || CASE WHEN path <> '' AND after_x <> '' THEN ' ' ELSE '' END || path || ' Y' AS pattern, sentence
    FROM told WHERE path <> '' OR after_x <> '')""")
def shortest_path_tree(spark, sf):
    """Paths over a common ancestor, with governors by ``pobj`` and ``cc`` words."""
    parses = v.parses(spark, sf).withColumn("tokens", F.expr(_AS_TREE))
    return shortest_path_patterns(subcorpus(materialise_by(parses, "parses", "sid"), v.wanted(spark, sf), counted=True))


@query("entity_head_tree", "toks", sql="""
    SELECT sid, 1 AS span, max_by(id, (CASE WHEN id > 1 THEN 1 ELSE 0 END + CASE WHEN 2 * id <= n THEN 1 ELSE 0 END
                                       + CASE WHEN 2 * id + 1 <= n THEN 1 ELSE 0 END) * 1000000 + id) AS head
    FROM toks JOIN (SELECT sid, min(id) AS first, max(id) AS last FROM toks WHERE pos IN ('NN', 'NNS') GROUP BY sid) USING (sid)
    WHERE id BETWEEN first AND last AND n > 1 GROUP BY sid""")
def entity_heads_tree(spark, sf):
    """The same spans where tokens have up to three dependencies."""
    return entity_head(*_noun_spans(materialise(v.parses(spark, sf).withColumn("tokens", F.expr(_AS_TREE)), "parses")))


_THESAURUS = """
    SELECT split_part(p_name, ' ', 1) || CASE p_size % 3 WHEN 0 THEN '#NN' WHEN 1 THEN '#NNS' ELSE '#NNP' END AS target,
           split_part(p_name, ' ', 2) || CASE p_partkey % 3 WHEN 0 THEN '#NN' WHEN 1 THEN '#NNS' ELSE '#NNP' END AS expansion,
           p_retailprice AS similarity, p_partkey
    FROM part"""


def _thesaurus(spark, sf):
    """Words of part names as a thesaurus, tagged by size and key."""
    def tagged(word, number):
        return F.concat(word, F.element_at(F.array(F.lit("#NN"), F.lit("#NNS"), F.lit("#NNP")), (number % 3 + 1).cast("int")))

    words = F.split("p_name", " ")
    return v.table(spark, sf, "part").select(
        tagged(words[0], F.col("p_size")).alias("target"),
        tagged(words[1], F.col("p_partkey")).alias("expansion"),
        F.col("p_retailprice").alias("similarity"),
        "p_partkey",
    )


@query("te_regex_filter", sql=f"""
    SELECT * FROM ({_THESAURUS}) WHERE regexp_full_match(target, '[a-zA-Z][\\S]+#NNS?') AND regexp_full_match(expansion, '[a-zA-Z][\\S]+#NNS?')""")
def te_regex_filter(spark, sf):
    return _thesaurus(spark, sf).filter(is_tagged_common_noun(F.col("target")) & is_tagged_common_noun(F.col("expansion")))


@query("thesaurus_topn", sql=f"""
    SELECT target, expansion, similarity FROM (
      SELECT target, expansion, similarity, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, expansion) AS rk
      FROM (SELECT regexp_extract(target, '(.*)#.*', 1) AS target, regexp_extract(expansion, '(.*)#.*', 1) AS expansion, similarity
            FROM ({_THESAURUS})
            WHERE regexp_full_match(target, '[a-zA-Z][\\S]+#NNS?') AND regexp_full_match(expansion, '[a-zA-Z][\\S]+#NNS?'))
      WHERE target <> expansion AND NOT regexp_matches(target, '[0-9.+@]') AND NOT regexp_matches(expansion, '[0-9.+@]'))
    WHERE rk <= 50""")
def thesaurus_topn(spark, sf):
    return filter_thesaurus(_thesaurus(spark, sf).drop("p_partkey"), 50)

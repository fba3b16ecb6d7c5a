"""Counts, dictionaries, association scores and feature vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.association import association_scores, flip_jobim, jobim_rotate, prune_contexts, sorted_lmi
from ..operators.counts import (
    pair_dictionary,
    pair_frequencies,
    pair_pattern_frequencies,
    pairs_of_patterns,
    pattern_dictionary,
    pattern_frequencies,
    patterns_of_pairs,
    sentence_frequencies,
    store_frequencies,
)
from ..operators.cluster_prep import pair_pattern_entries
from ..operators.vectors import collect_vectors, context_vectors, explode_vectors, feature_vectors, reindex
from ..plans.numbering import dense_ids
from . import views as v
from .registry import query, r6
from .sql import view


@query("freq_sentence", "feats", sql="""
    SELECT sentence, count(*) AS freq, count(DISTINCT (noun1, noun2)) AS num_pairs FROM feats GROUP BY sentence""")
def freq_sentence(spark, sf):
    return sentence_frequencies(v.feats(spark, sf))


@query("freq_pair", "feats", sql="""
    SELECT noun1, noun2, count(*) AS freq, count(DISTINCT pattern) AS num_patterns, 0 AS part, string_agg(DISTINCT pattern, ' | ' ORDER BY pattern) AS patterns
    FROM feats GROUP BY noun1, noun2""")
def freq_pair(spark, sf):
    """Rows, distinct patterns and the set of patterns per pair."""
    return pair_frequencies(v.feats(spark, sf), sets=True).withColumn("patterns", F.array_join("patterns", " | "))


@query("freq_pair_set", "pair_pattern", sql="""
    SELECT noun1, noun2, 0 AS part, string_agg(pattern, ' | ' ORDER BY pattern) AS patterns FROM pair_pattern GROUP BY noun1, noun2""")
def freq_pair_set(spark, sf):
    return patterns_of_pairs(v.stored_feats(spark, sf)).withColumn("patterns", F.array_join("patterns", " | "))


@query("freq_pattern", "feats", "pair_pattern", sql="""
    SELECT pattern, freq, num_pairs, 0 AS part, pairs FROM
      (SELECT pattern, count(*) AS freq, count(DISTINCT (noun1, noun2)) AS num_pairs FROM feats GROUP BY pattern) JOIN
      (SELECT pattern, string_agg(noun1 || ',' || noun2, ' | ' ORDER BY noun1, noun2) AS pairs FROM pair_pattern GROUP BY pattern) USING (pattern)""")
def freq_pattern(spark, sf):
    """Rows, distinct pairs and the set of pairs per pattern."""
    pairs = F.transform("pairs", lambda p: F.concat_ws(",", p["noun1"], p["noun2"]))
    return pattern_frequencies(v.feats(spark, sf), sets=True).withColumn("pairs", F.array_join(pairs, " | "))


@query("freq_pattern_set", "pair_pattern", sql="""
    SELECT pattern, 0 AS part, string_agg(noun1 || ',' || noun2, ' | ' ORDER BY noun1, noun2) AS pairs FROM pair_pattern GROUP BY pattern""")
def freq_pattern_set(spark, sf):
    pairs = F.transform("pairs", lambda p: F.concat_ws(",", p["noun1"], p["noun2"]))
    return pairs_of_patterns(v.stored_feats(spark, sf)).withColumn("pairs", F.array_join(pairs, " | "))


@query("freq_pair_pattern", "pair_pattern", sql="SELECT * FROM pair_pattern")
def freq_pair_pattern(spark, sf):
    return pair_pattern_frequencies(v.feats(spark, sf))


view("pair_dict", "pair_pattern", sql="""
    SELECT row_number() OVER (ORDER BY freq DESC, noun1, noun2) AS id, noun1, noun2, freq, num_patterns
    FROM (SELECT noun1, noun2, sum(freq)::BIGINT AS freq, count(*) AS num_patterns FROM pair_pattern GROUP BY ALL)
    WHERE freq > 0 AND num_patterns > 2""")
view("pattern_dict", "pair_pattern", sql="""
    SELECT row_number() OVER (ORDER BY freq DESC, pattern) AS id, pattern, freq, num_pairs
    FROM (SELECT pattern, sum(freq)::BIGINT AS freq, count(*) AS num_pairs FROM pair_pattern GROUP BY ALL)
    WHERE freq > 0 AND num_pairs > 3""")


@query("pair_dict", "pair_dict", sql="SELECT * FROM pair_dict")
def pair_dict(spark, sf):
    return pair_dictionary(v.feats(spark, sf), 0, 2)


@query("pattern_dict", "pattern_dict", sql="SELECT * FROM pattern_dict")
def pattern_dict(spark, sf):
    return pattern_dictionary(v.feats(spark, sf), 0, 3)


@query("dense_ids", sql="""
    SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS id, o_orderkey, o_totalprice FROM orders""")
def order_ids(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return dense_ids(orders, [F.desc("o_totalprice"), "o_orderkey"])


@query("frequencies_stored", "feats", "pair_pattern", sql="""
    SELECT 'pair_pattern' AS output, concat_ws('|', noun1, noun2, pattern) AS item, freq, NULL::BIGINT AS n FROM pair_pattern
    UNION ALL SELECT 'pair', concat_ws('|', noun1, noun2), sum(freq)::BIGINT, count(*) FROM pair_pattern GROUP BY noun1, noun2
    UNION ALL SELECT 'pattern', pattern, sum(freq)::BIGINT, count(*) FROM pair_pattern GROUP BY pattern
    UNION ALL SELECT 'sentence', sentence, count(*), count(DISTINCT (noun1, noun2)) FROM feats GROUP BY sentence""")
def frequencies_stored(spark, sf):
    """The four outputs of one pass, one below the other."""
    stored, _ = store_frequencies(v.feats(spark, sf))
    shown = [
        stored[name].select(F.lit(name).alias("output"), F.concat_ws("|", *keys).alias("item"), "freq", (F.col(n) if n else F.lit(None).cast("bigint")).alias("n"))
        for name, keys, n in (
            ("pair_pattern", ["noun1", "noun2", "pattern"], None),
            ("pair", ["noun1", "noun2"], "num_patterns"),
            ("pattern", ["pattern"], "num_pairs"),
            ("sentence", ["sentence"], "num_pairs"),
        )
    ]
    return shown[0].unionByName(shown[1]).unionByName(shown[2]).unionByName(shown[3])


@query("feature_counter", "feats", sql="""
    SELECT count(*) AS features, count(*) FILTER (WHERE noun1 IS NULL OR noun2 IS NULL OR pattern IS NULL OR sentence IS NULL) AS incomplete FROM feats""")
def feature_counter(spark, sf):
    """What the pass over the features counted on its way."""
    _, counters = store_frequencies(v.feats(spark, sf))
    return spark.range(1).select(*[F.lit(n).cast("bigint").alias(name) for name, n in counters.items()])


@query("jobim_rotate", "jobim", sql="SELECT jo, bim, cnt FROM jobim")
def jobim(spark, sf):
    return v.jobim(spark, sf)


@query("flip_jobim", "jobim", sql="SELECT bim AS jo, jo AS bim, cnt FROM jobim")
def jobim_flipped(spark, sf):
    return flip_jobim(v.jobim(spark, sf))


@query("association_scores", "scores", sql="""
    SELECT jo, bim, cnt, round(pmi, 6) AS pmi, round(npmi, 6) AS npmi, round(lmi, 6) AS lmi FROM scores""")
def association(spark, sf):
    return v.scores(spark, sf).select("jo", "bim", "cnt", r6("pmi"), r6("npmi"), r6("lmi"))


@query("association_star", "star_scores", sql="""
    SELECT jo, bim, cnt, round(pmi, 6) AS pmi, round(npmi, 6) AS npmi, round(lmi, 6) AS lmi FROM star_scores""")
def association_star(spark, sf):
    return association_scores(v.star(spark, sf)).select("jo", "bim", "cnt", r6("pmi"), r6("npmi"), r6("lmi"))


@query("association_separate", "star_scores_separate", sql="""
    SELECT jo, bim, cnt, round(pmi, 6) AS pmi, round(npmi, 6) AS npmi, round(lmi, 6) AS lmi FROM star_scores_separate""")
def association_separate(spark, sf):
    scores = association_scores(v.star(spark, sf), totals="separate")
    return scores.select("jo", "bim", "cnt", r6("pmi"), r6("npmi"), r6("lmi"))


view("pruned", "scores", sql="""
    SELECT jo, bim, cnt, round(lmi, 6) AS lmi
    FROM (SELECT *, row_number() OVER (PARTITION BY jo ORDER BY round(lmi, 6) DESC, bim) AS rk FROM scores) WHERE rk <= 1000""")


def _pruned(spark, sf):
    # rounded first, so that equal scores tie on both engines
    return prune_contexts(v.scores(spark, sf).select("jo", "bim", "cnt", r6("lmi")), 1000)


@query("topn_contexts", "pruned", sql="SELECT jo, bim, cnt, lmi FROM pruned")
def topn_contexts(spark, sf):
    return _pruned(spark, sf)


@query("top3_contexts", "scores", sql="""
    SELECT jo, bim, lmi FROM (
      SELECT jo, bim, round(lmi, 6) AS lmi, row_number() OVER (PARTITION BY jo ORDER BY round(lmi, 6) DESC, bim) AS rk FROM scores)
    WHERE rk <= 3""")
def top3_contexts(spark, sf):
    return prune_contexts(v.scores(spark, sf).select("jo", "bim", r6("lmi")), 3)


@query("sorted_lmi", "star_scores", sql="SELECT jo, bim, round(lmi, 6) AS lmi FROM star_scores ORDER BY jo, lmi DESC, bim")
def sorted_scores(spark, sf):
    return sorted_lmi(association_scores(v.star(spark, sf)).select("jo", "bim", r6("lmi")))


view("ctx", "star_scores", sql="""
    SELECT dense_rank() OVER (ORDER BY jo) AS id, jo, dense_rank() OVER (ORDER BY bim) AS idx, round(lmi, 6) AS value FROM star_scores""")


@query("ctx_vectors", "ctx", sql="""
    SELECT id, jo, 0 AS part, string_agg(idx, ',' ORDER BY idx) AS idxs, round(sum(value), 4) AS total, count(*) AS n FROM ctx GROUP BY id, jo""")
def ctx_vectors(spark, sf):
    entries = context_vectors(association_scores(v.star(spark, sf)).select("jo", "bim", r6("lmi")), "lmi")
    vectors = collect_vectors(entries, ["id", "jo"])
    return vectors.select(
        "id",
        "jo",
        "part",
        F.array_join(F.transform("values", lambda e: e["idx"].cast("string")), ",").alias("idxs"),
        F.round(F.aggregate("values", F.lit(0.0), lambda acc, e: acc + e["value"]), 4).alias("total"),
        F.size("values").cast("bigint").alias("n"),
    )


@query("explode_vectors", "ctx", sql="SELECT jo, idx, value FROM ctx")
def vectors_exploded(spark, sf):
    entries = context_vectors(association_scores(v.star(spark, sf)).select("jo", "bim", r6("lmi")), "lmi")
    return explode_vectors(collect_vectors(entries, ["jo"]), ["jo"])


view("entries0", "pair_pattern", "pair_dict", "pattern_dict", sql="""
    SELECT pp.noun1, pp.noun2, pp.pattern, pp.freq AS cnt
    FROM pair_pattern pp SEMI JOIN pair_dict d ON d.noun1 = pp.noun1 AND d.noun2 = pp.noun2
    SEMI JOIN pattern_dict q ON q.pattern = pp.pattern WHERE pp.freq > 1""")
view("entries", "entries0", sql="""
    SELECT * FROM entries0 SEMI JOIN
      (SELECT noun1, noun2 FROM entries0 GROUP BY ALL HAVING count(*) > 1) k USING (noun1, noun2)""")
view("fvectors", "entries", sql="""
    SELECT dense_rank() OVER (ORDER BY noun1, noun2) AS id, dense_rank() OVER (ORDER BY pattern) AS idx, noun1, noun2, pattern, cnt
    FROM entries""")


def _feature_vectors(spark, sf):
    features = v.stored_feats(spark, sf)
    return feature_vectors(features, pair_dictionary(features, 0, 2), pattern_dictionary(features, 0, 3), 1, 1)


@query("feature_vectors", "fvectors", sql="SELECT id, idx, cnt FROM fvectors")
def feature_vector_entries(spark, sf):
    return _feature_vectors(spark, sf).vectors


@query("feature_pairs", "fvectors", "pair_dict", sql="""
    SELECT DISTINCT f.id, f.noun1, f.noun2, d.freq, d.num_patterns FROM fvectors f JOIN pair_dict d USING (noun1, noun2)""")
def feature_pairs(spark, sf):
    return _feature_vectors(spark, sf).pairs


@query("feature_patterns", "fvectors", "pattern_dict", sql="""
    SELECT DISTINCT f.idx AS id, f.pattern, d.freq, d.num_pairs FROM fvectors f JOIN pattern_dict d USING (pattern)""")
def feature_patterns(spark, sf):
    return _feature_vectors(spark, sf).patterns


@query("reindex", "pair_pattern", "pair_dict", "pattern_dict", "fvectors", sql="""
    SELECT d.id AS pair_id, f.idx AS idx, pp.freq AS cnt
    FROM pair_pattern pp JOIN pair_dict d ON d.noun1 = pp.noun1 AND d.noun2 = pp.noun2
    JOIN pattern_dict q ON q.pattern = pp.pattern
    LEFT JOIN (SELECT DISTINCT pattern, idx FROM fvectors) f ON f.pattern = pp.pattern""")
def reindexed(spark, sf):
    """Entries of the unpruned dictionaries under their new pattern numbers, null where pruned."""
    features = v.stored_feats(spark, sf)
    pairs, patterns = pair_dictionary(features, 0, 2), pattern_dictionary(features, 0, 3)
    made = feature_vectors(features, pairs, patterns, 1, 1)
    entries = (
        pair_pattern_frequencies(features)
        .join(patterns.select(F.col("id").alias("idx"), "pattern"), "pattern")
        .join(pairs.select(F.col("id").alias("pair_id"), "noun1", "noun2"), ["noun1", "noun2"])
        .select("pair_id", "idx", F.col("freq").alias("cnt"))
    )
    return reindex(entries, made.index_map)


@query("pair_pattern_entries", "scores", "pair_dict", "pattern_dict", sql="""
    SELECT d.id AS pair_id, q.id AS pattern_id, round(lmi, 6) AS lmi
    FROM (SELECT *, regexp_replace(bim, '::@::', ',') AS pair FROM scores) s
    JOIN (SELECT id, noun1 || ',' || noun2 AS pair FROM pair_dict) d ON d.pair = s.pair
    JOIN pattern_dict q ON q.pattern = s.jo WHERE round(lmi, 6) >= 20""")
def pair_pattern(spark, sf):
    """Scored pair contexts of patterns, under the numbers of both dictionaries."""
    features = v.stored_feats(spark, sf)
    scored = association_scores(jobim_rotate(features)).select(
        F.col("jo").alias("pattern"), F.regexp_replace("bim", "::@::", ",").alias("pair"), r6("lmi")
    )
    pairs = pair_dictionary(features, 0, 2).select("id", F.concat_ws(",", "noun1", "noun2").alias("pair"))
    patterns = pattern_dictionary(features, 0, 3).select("id", "pattern")
    return pair_pattern_entries(scored, pairs, patterns, 20.0)

"""Clustering preparation and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster_prep as prep
from ..operators import evaluate as ev
from ..operators import matching, whispers
from ..plans.storage import fresh_path, materialise
from ..sources import ordered, tables
from . import views as v
from .registry import query, r6
from .sql import view


def _both(spark, sf):
    return v.truth(spark, sf), v.pred(spark, sf)


def _scores(df):
    return df.select(*[r6(c) for c in df.columns])


_PRF = """
    SELECT round(p_num, 6) AS p_num, round(p_den, 6) AS p_den, round(r_num, 6) AS r_num, round(r_den, 6) AS r_den,
           round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1
    FROM (SELECT *, CASE WHEN p_den > 0 THEN p_num / p_den ELSE 0 END AS p, CASE WHEN r_den > 0 THEN r_num / r_den ELSE 0 END AS r
          FROM ({body}))"""

_B_CUBED = """
    SELECT (SELECT sum(n * n / p_size::DOUBLE) FROM {cells} JOIN {p_sizes} USING (p)) AS p_num,
           (SELECT count(*)::DOUBLE FROM {pred}) AS p_den,
           (SELECT sum(n * n / t_size::DOUBLE) FROM {cells} JOIN {t_sizes} USING (t)) AS r_num,
           (SELECT count(*)::DOUBLE FROM {truth}) AS r_den"""


@query("b_cubed", "cells", "p_sizes", "t_sizes", sql=_PRF.format(
    body=_B_CUBED.format(cells="cells", p_sizes="p_sizes", t_sizes="t_sizes", pred="pred", truth="truth")))
def b_cubed(spark, sf):
    return _scores(ev.b_cubed(*_both(spark, sf)))


@query("muc", "cells", "p_sizes", "t_sizes", sql=_PRF.format(body="""
    SELECT (SELECT sum(n) - count(*) FROM cells)::DOUBLE AS p_num, (SELECT sum(p_size - 1) FROM p_sizes)::DOUBLE AS p_den,
           (SELECT sum(n) - count(*) FROM cells)::DOUBLE AS r_num, (SELECT sum(t_size - 1) FROM t_sizes)::DOUBLE AS r_den"""))
def muc(spark, sf):
    return _scores(ev.muc(*_both(spark, sf)))


@query("pairwise", "cells", "p_sizes", "t_sizes", sql=_PRF.format(body="""
    SELECT (SELECT sum(n * (n - 1) / 2) FROM cells)::DOUBLE AS p_num, (SELECT sum(p_size * (p_size - 1) / 2) FROM p_sizes)::DOUBLE AS p_den,
           (SELECT sum(n * (n - 1) / 2) FROM cells)::DOUBLE AS r_num, (SELECT sum(t_size * (t_size - 1) / 2) FROM t_sizes)::DOUBLE AS r_den"""))
def pairwise(spark, sf):
    return _scores(ev.pairwise(*_both(spark, sf)))


view("item_pairs", "truth", "pred", sql="""
    SELECT a.item AS i, b.item AS j, ta.cluster = tb.cluster AS same_t, pa.cluster = pb.cluster AS same_p
    FROM (SELECT item FROM truth UNION SELECT item FROM pred) a JOIN (SELECT item FROM truth UNION SELECT item FROM pred) b ON a.item < b.item
    LEFT JOIN truth ta ON ta.item = a.item LEFT JOIN truth tb ON tb.item = b.item
    LEFT JOIN pred pa ON pa.item = a.item LEFT JOIN pred pb ON pb.item = b.item""")


@query("pairwise_negative", "item_pairs", sql=_PRF.format(body="""
    SELECT count(*) FILTER (WHERE NOT same_t AND NOT same_p)::DOUBLE AS p_num, count(*) FILTER (WHERE NOT same_p)::DOUBLE AS p_den,
           count(*) FILTER (WHERE NOT same_t AND NOT same_p)::DOUBLE AS r_num, count(*) FILTER (WHERE NOT same_t)::DOUBLE AS r_den
    FROM item_pairs"""))
def pairwise_negative(spark, sf):
    return _scores(ev.pairwise_negative(*_both(spark, sf)))


view("total", "cells", sql="SELECT sum(n)::DOUBLE AS total FROM cells")
view("mi", "cells", "a_sizes", "b_sizes", "total", sql="""
    SELECT (SELECT sum(n / total * ln(n * total / (a * b))) FROM cells JOIN a_sizes USING (t) JOIN b_sizes USING (p), total) AS mi,
           (SELECT -sum(a / total * ln(a / total)) FROM a_sizes, total) AS h_t,
           (SELECT -sum(b / total * ln(b / total)) FROM b_sizes, total) AS h_p""")


@query("v_measure", "mi", sql="""
    SELECT round(h, 6) AS homogeneity, round(c, 6) AS completeness, round(2 * h * c / (h + c), 6) AS v_measure
    FROM (SELECT mi / h_t AS h, mi / h_p AS c FROM mi)""")
def v_measure(spark, sf):
    return _scores(ev.v_measure(*_both(spark, sf)))


@query("adjusted_rand", "cells", "a_sizes", "b_sizes", sql="""
    SELECT round((x - ta * pb / everything) / ((ta + pb) / 2 - ta * pb / everything), 6) AS adjusted_rand FROM (
      SELECT (SELECT sum(n * (n - 1) / 2) FROM cells)::DOUBLE AS x, (SELECT sum(a * (a - 1) / 2) FROM a_sizes)::DOUBLE AS ta,
             (SELECT sum(b * (b - 1) / 2) FROM b_sizes)::DOUBLE AS pb, (SELECT sum(n) * (sum(n) - 1) / 2 FROM cells)::DOUBLE AS everything)""")
def adjusted_rand(spark, sf):
    return _scores(ev.adjusted_rand(*_both(spark, sf)))


view("emi", "a_sizes", "b_sizes", "total", sql="""
    SELECT sum(ma * mb * k / total * ln(k * total / (a * b)) * exp(
             lgamma(a + 1) + lgamma(b + 1) + lgamma(total - a + 1) + lgamma(total - b + 1) - lgamma(total + 1)
             - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(total - a - b + k + 1))) AS emi
    FROM (SELECT *, unnest(range(greatest(1, a + b - total)::BIGINT, least(a, b)::BIGINT + 1))::DOUBLE AS k FROM
      (SELECT a::DOUBLE AS a, count(*) AS ma FROM a_sizes GROUP BY a), (SELECT b::DOUBLE AS b, count(*) AS mb FROM b_sizes GROUP BY b), total)""")


@query("adjusted_mutual_info", "mi", "emi", sql="""
    SELECT round(mi, 6) AS mi, round(emi, 6) AS emi, round((mi - emi) / ((h_t + h_p) / 2 - emi), 6) AS adjusted_mutual_info FROM mi, emi""")
def adjusted_mutual_info(spark, sf):
    return _scores(ev.adjusted_mutual_info(*_both(spark, sf)))


@query("adjusted_mutual_info_max", "mi", "emi", sql="""
    SELECT round(mi, 6) AS mi, round(emi, 6) AS emi, round((mi - emi) / (greatest(h_t, h_p) - emi), 6) AS adjusted_mutual_info FROM mi, emi""")
def adjusted_mutual_info_max(spark, sf):
    return _scores(ev.adjusted_mutual_info(*_both(spark, sf), average="max"))


@query("ceaf_mention")
def ceaf_mention(spark, sf):
    return _scores(matching.ceaf(*_both(spark, sf), similarity="overlap"))


@query("ceaf_entity")
def ceaf_entity(spark, sf):
    return _scores(matching.ceaf(*_both(spark, sf), similarity="dice"))


# customers by region and by segment: few clusters on both sides, so SQL can try all matchings
view("by_region", sql="""
    SELECT c_custkey AS item, r_name AS cluster FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
view("by_segment", sql="SELECT c_custkey AS item, c_mktsegment AS cluster FROM customer")
view("region_cells", "by_region", "by_segment", sql="""
    SELECT dense_rank() OVER (ORDER BY t) AS t, dense_rank() OVER (ORDER BY p) AS p, n, n / (any_t + any_p)::DOUBLE AS dice FROM (
      SELECT a.cluster AS t, b.cluster AS p, count(*) AS n,
             (SELECT count(*) FROM by_region x WHERE x.cluster = a.cluster) AS any_t, (SELECT count(*) FROM by_segment x WHERE x.cluster = b.cluster) AS any_p
      FROM by_region a JOIN by_segment b USING (item) GROUP BY a.cluster, b.cluster)""")
_BEST = """
    SELECT max(total) FROM (
      WITH RECURSIVE m AS (
        SELECT 0::BIGINT AS i, []::BIGINT[] AS used, 0::DOUBLE AS total
        UNION ALL SELECT i + 1, list_append(used, p), total + {weight} FROM m JOIN region_cells ON t = i + 1 AND NOT list_contains(used, p))
      SELECT * FROM m)"""


def _regions(spark, sf):
    customer, nation, region = (v.table(spark, sf, n) for n in ("customer", "nation", "region"))
    homes = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    by_region = homes.select(F.col("c_custkey").alias("item"), F.col("r_name").alias("cluster"))
    return by_region, customer.select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("cluster"))


@query("ceaf_mention_regions", "region_cells", sql=_PRF.format(body=f"""
    SELECT s AS p_num, (SELECT count(*)::DOUBLE FROM by_segment) AS p_den, s AS r_num, (SELECT count(*)::DOUBLE FROM by_region) AS r_den
    FROM (SELECT ({_BEST.format(weight='n')}) AS s)"""))
def ceaf_mention_regions(spark, sf):
    return _scores(matching.ceaf(*_regions(spark, sf), similarity="overlap"))


@query("ceaf_entity_regions", "region_cells", sql=_PRF.format(body=f"""
    SELECT s AS p_num, (SELECT count(DISTINCT cluster) / 2 FROM by_segment) AS p_den, s AS r_num, (SELECT count(DISTINCT cluster) / 2 FROM by_region) AS r_den
    FROM (SELECT ({_BEST.format(weight='dice')}) AS s)"""))
def ceaf_entity_regions(spark, sf):
    return _scores(matching.ceaf(*_regions(spark, sf), similarity="dice"))


view("tw_lost", "truth", "pred", sql="SELECT item, 'lost ' || item AS cluster FROM truth WHERE item NOT IN (SELECT item FROM pred)")
view("tw_known", "truth", "pred", sql="SELECT item, cluster FROM pred WHERE item IN (SELECT item FROM truth)")
view("tw_extra", "truth", "pred", sql="""
    SELECT item, cluster FROM pred WHERE item NOT IN (SELECT item FROM truth)
    AND cluster IN (SELECT cluster FROM pred GROUP BY cluster HAVING count(*) > 1)""")
view("tw_p_truth", "tw_extra", sql="SELECT item, cluster FROM truth UNION ALL SELECT item, 'extra ' || item FROM tw_extra")
view("tw_p_pred", "tw_lost", "tw_known", "tw_extra", sql="""
    SELECT * FROM tw_known UNION ALL SELECT * FROM tw_extra UNION ALL SELECT * FROM tw_lost""")
view("tw_r_pred", "tw_lost", "tw_known", sql="SELECT * FROM tw_known UNION ALL SELECT * FROM tw_lost")


def _cells_of(name, truth, pred):
    view(name, truth, pred, sql=f"""
        SELECT t.cluster AS t, p.cluster AS p, count(*) AS n FROM {truth} t JOIN {pred} p ON t.item = p.item GROUP BY ALL""")


_cells_of("tw_p_cells", "tw_p_truth", "tw_p_pred")
_cells_of("tw_r_cells", "truth", "tw_r_pred")


@query("twinless_b_cubed", "tw_p_cells", "tw_r_cells", "t_sizes", sql=_PRF.format(body="""
    SELECT (SELECT sum(n * n / s::DOUBLE) FROM tw_p_cells JOIN (SELECT cluster AS p, count(*) AS s FROM tw_p_pred GROUP BY cluster) USING (p)) AS p_num,
           (SELECT count(*)::DOUBLE FROM tw_p_pred) AS p_den,
           (SELECT sum(n * n / t_size::DOUBLE) FROM tw_r_cells JOIN t_sizes USING (t)) AS r_num,
           (SELECT count(*)::DOUBLE FROM truth) AS r_den"""))
def twinless_b_cubed(spark, sf):
    return _scores(ev.twinless_b_cubed(*_both(spark, sf)))


@query("twinless_ceaf")
def twinless_ceaf(spark, sf):
    return _scores(matching.twinless_ceaf(*_both(spark, sf)))


@query("mapping_to_sets", "pred", sql="""
    SELECT cluster, 0 AS part, string_agg(item, ',' ORDER BY item) AS items FROM pred GROUP BY cluster""")
def mapping_to_sets(spark, sf):
    return ev.mapping_to_sets(v.pred(spark, sf)).withColumn("items", F.array_join("items", ","))


@query("sets_to_mapping", "pred", sql="SELECT item, cluster FROM pred")
def sets_to_mapping(spark, sf):
    return ev.sets_to_mapping(ev.mapping_to_sets(v.pred(spark, sf)))


@query("mention_setops", "truth", "pred", sql="""
    SELECT item, 'truth' AS side FROM truth WHERE item NOT IN (SELECT item FROM pred)
    UNION ALL SELECT item, 'pred' FROM pred WHERE item NOT IN (SELECT item FROM truth)""")
def mention_setops(spark, sf):
    return ev.mention_setops(*_both(spark, sf))


@query("cluster_similarity", "cells", "p_sizes", "t_sizes", sql="""
    SELECT t, p, n AS overlap, round(n / (t_size + p_size)::DOUBLE, 6) AS dice FROM cells JOIN p_sizes USING (p) JOIN t_sizes USING (t)""")
def cluster_similarity(spark, sf):
    return ev.cluster_similarity(*_both(spark, sf)).select("t", "p", "overlap", r6("dice"))


@query("confusion_pct", "cells", "a_sizes", sql="SELECT t, p, n, round(n / a, 6) AS share FROM cells JOIN a_sizes USING (t)")
def confusion_pct(spark, sf):
    return ev.confusion_pct(*_both(spark, sf)).select("t", "p", "n", r6("share"))


@query("cluster_size_hist", "p_sizes", sql="SELECT p_size AS size, count(*) AS n_clusters FROM p_sizes GROUP BY p_size")
def cluster_size_hist(spark, sf):
    return ev.cluster_size_hist(v.pred(spark, sf))


@query("cluster_size_thresholds", sql="""
    SELECT count(*) AS n_clusters, count(*) FILTER (WHERE n >= 5) AS at_least_5, count(*) FILTER (WHERE n >= 10) AS at_least_10,
           count(*) FILTER (WHERE n >= 15) AS at_least_15, count(*) FILTER (WHERE n >= 20) AS at_least_20
    FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)""")
def cluster_size_thresholds(spark, sf):
    """Orders clustered by customer."""
    orders = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("cluster"))
    return ev.cluster_size_thresholds(orders)


@query("gold_overlap", "truth", "pred", sql="SELECT item AS pair, cluster AS label FROM truth WHERE item IN (SELECT item FROM pred)")
def gold_overlap(spark, sf):
    truth, pred = _both(spark, sf)
    gold = truth.select(F.col("item").alias("pair"), F.col("cluster").alias("label"))
    return ev.gold_overlap(gold, pred.select(F.col("item").alias("pair")))


@query("predicted_overlap", "truth", "pred", sql="SELECT DISTINCT item, cluster FROM pred WHERE item IN (SELECT item FROM truth)")
def predicted_overlap(spark, sf):
    truth, pred = _both(spark, sf)
    return ev.predicted_overlap(pred.withColumnRenamed("item", "pair"), truth.select(F.col("item").alias("pair")))


@query("drop_small_clusters", "pred", "p_sizes", sql="SELECT item, cluster FROM pred JOIN p_sizes ON cluster = p WHERE p_size > 20")
def drop_small_clusters(spark, sf):
    return ev.drop_small_clusters(v.pred(spark, sf), 20)


view("large_cells", "cells", "b_sizes", sql="SELECT t AS label, p AS cluster, n FROM cells JOIN b_sizes USING (p) WHERE b > 20")


@query("label_cluster_coverage", "large_cells", "a_sizes", sql="""
    SELECT t AS label, a AS n_items, coalesce(m, 0) AS n_in_large, coalesce(c, 0) AS n_large_clusters FROM a_sizes
    LEFT JOIN (SELECT label, sum(n)::BIGINT AS m, count(*) AS c FROM large_cells GROUP BY label) ON label = t""")
def label_cluster_coverage(spark, sf):
    return ev.label_cluster_coverage(*_overlap(spark, sf), larger_than=20)


@query("label_cluster_counts", "large_cells", sql="SELECT * FROM large_cells")
def label_cluster_counts(spark, sf):
    return ev.label_cluster_counts(*_overlap(spark, sf), larger_than=20)


def _overlap(spark, sf):
    truth, pred = _both(spark, sf)
    gold = truth.select(F.col("item").alias("pair"), F.col("cluster").alias("label"))
    overlap = ev.gold_overlap(gold, pred.select(F.col("item").alias("pair")))
    labels = overlap.select(F.col("pair").alias("item"), "label")
    return labels, ev.predicted_overlap(pred.withColumnRenamed("item", "pair"), overlap)


PRUNE = 10.0
# a top-k feature of the operator: so many rows of each pair
NEIGHBOURS = 51

view("kept_sims", "ranked_sims", sql=f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_pair ORDER BY pos) AS nth FROM ranked_sims)
    WHERE nth <= {NEIGHBOURS} AND similarity >= {PRUNE} AND NOT regexp_matches(l_pair, '[^a-zA-Z:@]')
      AND NOT regexp_matches(r_pair, '[^a-zA-Z:@]') AND l_pair <> r_pair""")
view("pair_ids", "kept_sims", sql="""
    SELECT row_number() OVER (ORDER BY min(place)) AS id, pair FROM (
      SELECT l_pair AS pair, pos * 2 AS place FROM kept_sims UNION ALL SELECT r_pair, pos * 2 + 1 FROM kept_sims) GROUP BY pair""")


def _ids(spark, sf):
    sims = prep.with_positions(v.sims(spark, sf))
    return sims, prep.pair_ids(prep.kept_similarities(sims, PRUNE, NEIGHBOURS))


@query("pair_ids", "pair_ids", sql="SELECT id, pair FROM pair_ids")
def pair_ids(spark, sf):
    return _ids(spark, sf)[1]


view("graph", "pair_ids", "ranked_sims", sql="""
    SELECT nid1, nid2, arg_max(s, pos) AS similarity FROM (
      SELECT a.id AS nid1, b.id AS nid2, trunc(similarity)::INT AS s, pos FROM ranked_sims JOIN pair_ids a ON a.pair = l_pair JOIN pair_ids b ON b.pair = r_pair
      UNION ALL
      SELECT b.id, a.id, trunc(similarity)::INT, pos FROM ranked_sims JOIN pair_ids a ON a.pair = l_pair JOIN pair_ids b ON b.pair = r_pair)
    GROUP BY nid1, nid2""")


@query("symmetrize", "graph", sql="SELECT nid1, nid2, similarity FROM graph")
def symmetrize(spark, sf):
    return prep.symmetrize(*_ids(spark, sf))


@query("graph_export", "graph", sql="""
    SELECT row_number() OVER (ORDER BY nid1, nid2) AS line_no, concat_ws(chr(9), nid1, nid2, similarity) AS value FROM graph""")
def graph_export(spark, sf):
    """The lines of the sorted graph file, numbered as they stand in it."""
    sims, ids = _ids(spark, sf)
    ids = materialise(ids, "pair-ids")
    edges, _ = ordered.write_graph(prep.symmetrize(sims, ids), ids, fresh_path(spark, "graph"))
    return ordered.numbered_records(spark, edges)


@query("pair_dictionary_read", "pair_ids", sql="SELECT id, pair FROM pair_ids")
def pair_dictionary_read(spark, sf):
    """The dictionary of the graph, written sorted and read again."""
    _, ids = _ids(spark, sf)
    path = fresh_path(spark, "dictionary")
    ordered.write_sorted(ids, path, ["id"], F.concat_ws("\t", F.col("id").cast("string"), "pair"))
    return tables.read_dictionary(spark, path)


ROUNDS = 6


def _whisper_views(name, edges, src, dst, weight):
    """One view for each round over the labels of the round before."""
    view(f"{name}_0", edges, sql=f"SELECT node, node AS label FROM (SELECT {src} AS node FROM {edges} UNION SELECT {dst} FROM {edges})")
    for r in range(1, ROUNDS + 1):
        view(f"{name}_{r}", edges, f"{name}_{r - 1}", sql=f"""
            SELECT l.node, CASE WHEN best IS NOT NULL AND substr(md5(l.node || ':{r}:0'), 1, 1) < '8' THEN best ELSE label END AS label
            FROM {name}_{r - 1} l LEFT JOIN (
              SELECT node, label AS best FROM (
                SELECT {src} AS node, label, row_number() OVER (PARTITION BY {src} ORDER BY sum({weight}) DESC, label) AS nth
                FROM {edges} JOIN {name}_{r - 1} ON {dst} = node WHERE {src} <> {dst} AND {weight} > 0 GROUP BY {src}, label)
              WHERE nth = 1) b ON b.node = l.node""")


_whisper_views("whisper", "graph", "nid1", "nid2", "similarity")


@query("chinese_whispers", f"whisper_{ROUNDS}", sql=f"SELECT node, label FROM whisper_{ROUNDS}")
def chinese_whispers(spark, sf):
    return whispers.chinese_whispers(prep.symmetrize(*_ids(spark, sf)), ROUNDS)


"""Measures that compare two clusterings of items.

A clustering is ``(item, cluster)`` with each item in one cluster. All
measures start from the contingency table, whose size is the number of
overlapping cluster pairs; item pairs are never formed. Every measure returns
one row; the remaining numbers are scalar subqueries beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import COLLECT_CHUNK, gather


# tasks over which pairs of distinct cluster sizes are dealt out
SIZE_BLOCKS = 64


def contingency(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """``(t, p, n)``: common items per pair of clusters."""
    t = truth.select("item", F.col("cluster").alias("t"))
    p = pred.select("item", F.col("cluster").alias("p"))
    return t.join(p, "item").groupBy("t", "p").agg(F.count("*").alias("n"))


def cluster_sizes(clustering: DataFrame, name: str = "cluster", size: str = "size") -> DataFrame:
    return clustering.groupBy(F.col("cluster").alias(name)).agg(F.count("*").alias(size))


def _pairs_of(n: Column) -> Column:
    """Number of pairs among ``n`` things, in double precision."""
    return n.cast("double") * (n - 1).cast("double") / 2.0


def _total(df: DataFrame, value: Column) -> Column:
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).cast("double")).scalar()


def _rows(df: DataFrame) -> Column:
    return df.agg(F.count("*").cast("double")).scalar()


def prf(scores: DataFrame) -> DataFrame:
    """Add precision, recall and F1; 0 where a denominator is 0."""
    p = F.coalesce(F.try_divide("p_num", "p_den"), F.lit(0.0))
    r = F.coalesce(F.try_divide("r_num", "r_den"), F.lit(0.0))
    return scores.withColumns({"precision": p, "recall": r}).withColumn(
        "f1",
        F.coalesce(
            F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)
        ),
    )


def _cells_with_sizes(truth: DataFrame, pred: DataFrame) -> DataFrame:
    return (
        contingency(truth, pred)
        .join(cluster_sizes(truth, "t", "t_size"), "t")
        .join(cluster_sizes(pred, "p", "p_size"), "p")
    )


def _sum_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0)).cast("double")


def b_cubed(truth: DataFrame, pred: DataFrame) -> DataFrame:
    n = F.col("n").cast("double")
    return prf(
        _cells_with_sizes(truth, pred)
        .agg(_sum_or_zero(n * n / F.col("p_size")).alias("p_num"), _sum_or_zero(n * n / F.col("t_size")).alias("r_num"))
        .select("p_num", _rows(pred).alias("p_den"), "r_num", _rows(truth).alias("r_den"))
    )


def muc(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Links kept: per cluster, aligned items less the clusters they fall into."""
    cells = contingency(truth, pred)
    kept = cells.agg((_sum_or_zero(F.col("n")) - F.count("*")).alias("p_num"))
    return prf(
        kept.select(
            "p_num",
            _total(cluster_sizes(pred), F.col("size") - 1).alias("p_den"),
            F.col("p_num").alias("r_num"),
            _total(cluster_sizes(truth), F.col("size") - 1).alias("r_den"),
        )
    )


def pairwise(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs of items that share a cluster."""
    shared = contingency(truth, pred).agg(_sum_or_zero(_pairs_of(F.col("n"))).alias("p_num"))
    return prf(
        shared.select(
            "p_num",
            _total(cluster_sizes(pred), _pairs_of(F.col("size"))).alias("p_den"),
            F.col("p_num").alias("r_num"),
            _total(cluster_sizes(truth), _pairs_of(F.col("size"))).alias("r_den"),
        )
    )


def pairwise_negative(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs of items that do not share a cluster, in closed form."""
    cells = contingency(truth, pred)
    t_common = cells.groupBy("t").agg(F.sum("n").alias("size"))
    p_common = cells.groupBy("p").agg(F.sum("n").alias("size"))
    sums = cells.agg(
        _pairs_of(F.coalesce(F.sum("n"), F.lit(0))).alias("common"),
        _sum_or_zero(_pairs_of(F.col("n"))).alias("agreed"),
    ).withColumns(
        {
            "t_pairs": _total(t_common, _pairs_of(F.col("size"))),
            "p_pairs": _total(p_common, _pairs_of(F.col("size"))),
        }
    )
    disagreed = F.col("t_pairs") + F.col("p_pairs") - 2 * F.col("agreed")
    num = (F.col("common") - F.col("agreed") - disagreed).alias("p_num")

    def negatives(clustering: DataFrame) -> Column:
        sizes = cluster_sizes(clustering)
        return sizes.agg(
            _pairs_of(F.coalesce(F.sum("size"), F.lit(0))) - _sum_or_zero(_pairs_of(F.col("size")))
        ).scalar()

    return prf(
        sums.select(num).select(
            "p_num", negatives(pred).alias("p_den"), F.col("p_num").alias("r_num"), negatives(truth).alias("r_den")
        )
    )


def _information(truth: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One row ``(mi, h_t, h_p, total)`` over common items, and both size tables."""
    cells = contingency(truth, pred)
    a = cells.groupBy("t").agg(F.sum("n").alias("a"))
    b = cells.groupBy("p").agg(F.sum("n").alias("b"))
    total = F.col("total")

    n_all = cells.agg(F.sum("n").cast("double")).scalar()

    def h(sizes: DataFrame, size: str) -> Column:
        share = F.col(size) / F.col("total")
        return sizes.withColumn("total", n_all).agg(F.coalesce(-F.sum(share * F.ln(share)), F.lit(0.0))).scalar()

    mi = (
        cells.join(a, "t")
        .join(b, "p")
        .withColumn("total", n_all)
        .agg(
            F.coalesce(
                F.sum(
                    F.col("n") / total * F.ln(F.col("n") * total / (F.col("a").cast("double") * F.col("b").cast("double")))
                ),
                F.lit(0.0),
            ).alias("mi")
        )
    )
    row = mi.select(
        F.greatest("mi", F.lit(0.0)).alias("mi"),
        h(a, "a").alias("h_t"),
        h(b, "b").alias("h_p"),
        F.coalesce(n_all, F.lit(0.0)).alias("total"),
    )
    return row, a, b


def v_measure(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """``(homogeneity, completeness, v_measure)`` over the common items."""
    row, _, _ = _information(truth, pred)
    return row.select(
        F.when(F.col("h_t") > 0, F.col("mi") / F.col("h_t")).otherwise(1.0).alias("homogeneity"),
        F.when(F.col("h_p") > 0, F.col("mi") / F.col("h_p")).otherwise(1.0).alias("completeness"),
    ).withColumn(
        "v_measure",
        F.coalesce(
            F.try_divide(
                2 * F.col("homogeneity") * F.col("completeness"), F.col("homogeneity") + F.col("completeness")
            ),
            F.lit(0.0),
        ),
    )


def adjusted_rand(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """``adjusted_rand`` over the common items."""
    cells = contingency(truth, pred)
    a = cells.groupBy("t").agg(F.sum("n").alias("size"))
    b = cells.groupBy("p").agg(F.sum("n").alias("size"))
    sums = cells.agg(
        _sum_or_zero(_pairs_of(F.col("n"))).alias("both"),
        _pairs_of(F.coalesce(F.sum("n"), F.lit(0))).alias("all"),
    ).withColumns({"ta": _total(a, _pairs_of(F.col("size"))), "pb": _total(b, _pairs_of(F.col("size")))})
    expected = F.coalesce(F.try_divide(F.col("ta") * F.col("pb"), F.col("all")), F.lit(0.0))
    return sums.select(
        F.coalesce(
            F.try_divide(F.col("both") - expected, (F.col("ta") + F.col("pb")) / 2.0 - expected), F.lit(1.0)
        ).alias("adjusted_rand")
    )


def log_factorial(n: Column) -> Column:
    """``ln(n!)`` by Stirling's series, shifted by eight so that it holds for small ``n``."""
    x = n.cast("double") + 1.0
    shift = F.lit(1.0)
    for k in range(8):
        shift = shift * (x + float(k))
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * z * z * z * z * z * z * z)
    half_log_two_pi = 0.9189385332046727
    return (z - 0.5) * F.ln(z) - z + half_log_two_pi + series - F.ln(shift)


def expected_mutual_information(a: DataFrame, b: DataFrame, n_all: Column) -> Column:
    """Expected mutual information of two clusterings with the given cluster sizes.

    Works on pairs of distinct sizes with their multiplicity, dealt out over blocks. Of a pair, the overlaps are hypergeometric:
    the likeliest one's probability is computed, and those of the others from their neighbours, both ways, in one expression. It
    ends forty standard deviations and forty overlaps away, where nothing is left that a double could hold next to the sum.
    """
    sizes_a = a.groupBy("a").agg(F.count("*").alias("m_a")).withColumn("block", F.pmod(F.xxhash64("a"), F.lit(SIZE_BLOCKS)))
    sizes_b = b.groupBy("b").agg(F.count("*").alias("m_b")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SIZE_BLOCKS - 1).cast("long"))))
    pairs = sizes_a.join(sizes_b, "block").select(
        "m_a", "m_b", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), n_all.cast("double").alias("total")
    )
    a_, b_, total = F.col("a"), F.col("b"), F.col("total")
    lowest, highest = F.greatest(F.lit(1.0), a_ + b_ - total), F.least(a_, b_)
    mean = a_ * b_ / total
    spread = F.sqrt(mean * (total - a_) / total * (total - b_) / F.greatest(total - 1, F.lit(1.0)))
    mode = F.greatest(lowest, F.least(highest, F.floor((a_ + 1) * (b_ + 1) / (total + 2)).cast("double")))
    reach = F.ceil(40 * spread + 40)
    placed = pairs.withColumns({"mode": mode, "low": F.greatest(lowest, mode - reach), "high": F.least(highest, mode + reach)})
    k = F.col("mode")
    log_p = (
        log_factorial(a_) + log_factorial(b_) + log_factorial(total - a_) + log_factorial(total - b_)
        - log_factorial(total) - log_factorial(k) - log_factorial(a_ - k) - log_factorial(b_ - k)
        - log_factorial(total - a_ - b_ + k)
    )
    placed = placed.withColumn("p", F.exp(log_p))

    def gain(n: Column) -> Column:
        return n / total * (F.ln(n) + F.ln(total) - F.ln(a_) - F.ln(b_))

    def summed(first: Column, last: Column, step: int, ratio) -> Column:
        """Sum of probability times gain from next to the mode on; ``ratio(n)`` leads from n's neighbour to n."""
        empty = F.array().cast("array<bigint>")
        places = F.when((last - first) * step >= 0, F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long"))).otherwise(empty)
        start = F.struct(F.lit(0.0).alias("sum"), F.col("p").alias("p"))

        def add(state: Column, n: Column) -> Column:
            p = state["p"] * ratio(n.cast("double"))
            return F.struct((state["sum"] + p * gain(n.cast("double"))).alias("sum"), p.alias("p"))

        return F.aggregate(places, start, add)["sum"]

    up = summed(k + 1, F.col("high"), 1, lambda n: (a_ - n + 1) * (b_ - n + 1) / (n * (total - a_ - b_ + n)))
    down = summed(k - 1, F.col("low"), -1, lambda n: (n + 1) * (total - a_ - b_ + n + 1) / ((a_ - n) * (b_ - n)))
    of_pair = F.col("p") * gain(k) + up + down
    return placed.agg(F.coalesce(F.sum(F.col("m_a") * F.col("m_b") * of_pair), F.lit(0.0))).scalar()


def adjusted_mutual_info(truth: DataFrame, pred: DataFrame, average: str = "arithmetic") -> DataFrame:
    """``(mi, emi, adjusted_mutual_info)`` over the common items; ``average`` is ``arithmetic`` or ``max``."""
    if average not in ("arithmetic", "max"):
        raise ValueError("average must be 'arithmetic' or 'max'")
    row, a, b = _information(truth, pred)
    n_all = a.agg(F.sum("a")).scalar()
    norm = (F.col("h_t") + F.col("h_p")) / 2.0 if average == "arithmetic" else F.greatest("h_t", "h_p")
    full = row.withColumns(
        {"emi": expected_mutual_information(a, b, n_all), "n_t": _rows(a), "n_p": _rows(b)}
    )
    trivial = (F.col("n_t") == F.col("n_p")) & (F.col("n_t") <= 1)
    return full.select(
        "mi",
        "emi",
        F.when(trivial, 1.0)
        .otherwise(F.try_divide(F.col("mi") - F.col("emi"), norm - F.col("emi")))
        .alias("adjusted_mutual_info"),
    )


def twinless_adjustment(truth: DataFrame, pred: DataFrame) -> dict[str, DataFrame]:
    """The four clusterings that stand in for ``truth`` and ``pred``.

    For both numbers, true items without a prediction become predicted
    singletons. For precision, predicted items without truth are dropped when
    they stand alone and become true singletons otherwise; for recall they
    are dropped.
    """
    t = truth.select("item", F.col("cluster").cast("string").alias("t"))
    sized = pred.join(cluster_sizes(pred), "cluster").select("item", F.col("cluster").cast("string").alias("p"), "size")
    items = t.join(sized, "item", "full_outer")
    has_t, has_p = F.col("t").isNotNull(), F.col("p").isNotNull()
    only_true = F.concat(F.lit("only true: "), F.col("item").cast("string"))
    only_pred = F.concat(F.lit("only predicted: "), F.col("item").cast("string"))
    counted = items.filter(has_t | (F.col("size") > 1))
    known = items.filter(has_t)
    return {
        "p_truth": counted.select("item", F.when(has_t, F.col("t")).otherwise(only_pred).alias("cluster")),
        "p_pred": counted.select("item", F.when(has_p, F.col("p")).otherwise(only_true).alias("cluster")),
        "r_truth": t.withColumnRenamed("t", "cluster"),
        "r_pred": known.select("item", F.when(has_p, F.col("p")).otherwise(only_true).alias("cluster")),
    }


def _combine(p_scores: DataFrame, r_scores: DataFrame) -> DataFrame:
    return prf(
        p_scores.select(
            "p_num",
            "p_den",
            r_scores.select("r_num").scalar().alias("r_num"),
            r_scores.select("r_den").scalar().alias("r_den"),
        )
    )


def twinless_b_cubed(truth: DataFrame, pred: DataFrame) -> DataFrame:
    s = twinless_adjustment(truth, pred)
    return _combine(b_cubed(s["p_truth"], s["p_pred"]), b_cubed(s["r_truth"], s["r_pred"]))


def mapping_to_sets(clustering: DataFrame, chunk: int = COLLECT_CHUNK) -> DataFrame:
    """``(cluster, part, items)``; a large cluster comes in several parts."""
    return gather(clustering, ["cluster"], F.col("item"), F.col("item"), "items", chunk)


def sets_to_mapping(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("items").alias("item"), "cluster")


def mention_setops(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Items on one side only, ``(item, side)``: the symmetric difference."""
    t = truth.select("item", F.lit(1).alias("in_truth"))
    p = pred.select("item", F.lit(1).alias("in_pred"))
    return (
        t.join(p, "item", "full_outer")
        .filter(F.col("in_truth").isNull() | F.col("in_pred").isNull())
        .select("item", F.when(F.col("in_pred").isNull(), "truth").otherwise("pred").alias("side"))
    )


def cluster_similarity(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """``(t, p, overlap, dice)`` of every two clusters that share an item."""
    return _cells_with_sizes(truth, pred).select(
        "t", "p", F.col("n").alias("overlap"), (F.col("n") / (F.col("t_size") + F.col("p_size"))).alias("dice")
    )


def gold_overlap(gold: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Gold rows whose pair is in the dictionary."""
    return gold.join(dictionary.select("pair"), "pair", "left_semi")


def predicted_overlap(clustering: DataFrame, overlap: DataFrame) -> DataFrame:
    """``(item, cluster)`` of clustered pairs that are in the overlap."""
    return (
        clustering.join(overlap.select("pair"), "pair", "left_semi")
        .select(F.col("pair").alias("item"), "cluster")
        .distinct()
    )


def drop_small_clusters(clustering: DataFrame, min_size: int = 0) -> DataFrame:
    """Items of clusters with more than ``min_size`` members."""
    large = cluster_sizes(clustering).filter(F.col("size") > min_size)
    return clustering.join(large, "cluster", "left_semi").select("item", "cluster")


def confusion_pct(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """``(t, p, n, share)``: confusion matrix with rows normalised to 1."""
    cells = contingency(truth, pred)
    rows = cells.groupBy("t").agg(F.sum("n").alias("row_n"))
    return cells.join(rows, "t").select("t", "p", "n", (F.col("n") / F.col("row_n")).alias("share"))


def cluster_size_hist(clustering: DataFrame) -> DataFrame:
    """``(size, n_clusters)``"""
    return cluster_sizes(clustering).groupBy("size").agg(F.count("*").alias("n_clusters"))


def cluster_size_thresholds(clustering: DataFrame, steps=(5, 10, 15, 20)) -> DataFrame:
    """Number of clusters in all and of clusters with at least so many members."""
    return cluster_sizes(clustering).agg(
        F.count("*").alias("n_clusters"), *[F.count_if(F.col("size") >= s).alias(f"at_least_{s}") for s in steps]
    )


def label_cluster_coverage(labels: DataFrame, pred: DataFrame, larger_than: int = 5) -> DataFrame:
    """``(label, n_items, n_in_large, n_large_clusters)``

    ``labels`` is ``(item, label)``; large clusters have more than
    ``larger_than`` predicted members.
    """
    counts = label_cluster_counts(labels, pred, larger_than)
    inside = counts.groupBy("label").agg(F.sum("n").alias("n_in_large"), F.count("*").alias("n_large_clusters"))
    return (
        labels.groupBy("label")
        .agg(F.count("*").alias("n_items"))
        .join(inside, "label", "left")
        .select(
            "label",
            "n_items",
            F.coalesce("n_in_large", F.lit(0)).alias("n_in_large"),
            F.coalesce("n_large_clusters", F.lit(0)).alias("n_large_clusters"),
        )
    )


def label_cluster_counts(labels: DataFrame, pred: DataFrame, larger_than: int = 5) -> DataFrame:
    """``(label, cluster, n)``: members of a label per large cluster."""
    large = cluster_sizes(pred).filter(F.col("size") > larger_than)
    return (
        pred.join(large, "cluster", "left_semi")
        .join(labels, "item")
        .groupBy("label", "cluster")
        .agg(F.count("*").alias("n"))
    )

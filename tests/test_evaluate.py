import itertools
import random

import pytest
from pyspark.sql import functions as F
from conftest import rows

from pairspace.operators import evaluate as ev
from pairspace.operators import matching

FIELDS = ["p_num", "p_den", "r_num", "r_den"]


def clustering(spark, sets):
    data = [(i, str(k)) for k, items in sets.items() for i in items]
    return spark.createDataFrame(data, "item string, cluster string")


@pytest.fixture(scope="module")
def both(spark):
    truth = clustering(spark, {1: "abc", 2: "defg"})
    pred = clustering(spark, {1: "ab", 2: "cd", 3: "fghi"})
    return truth, pred


@pytest.mark.parametrize(
    "measure, expected",
    [
        (ev.b_cubed, (4, 8, 2.916667, 7)),
        (ev.twinless_b_cubed, (5.5, 9, 3.166667, 7)),
        (ev.muc, (2, 5, 2, 5)),
        (ev.pairwise, (2, 8, 2, 9)),
        (ev.pairwise_negative, (8, 20, 8, 12)),
        (lambda t, p: matching.ceaf(t, p, "overlap"), (4, 8, 4, 7)),
        (lambda t, p: matching.ceaf(t, p, "dice"), (0.65, 1.5, 0.65, 1.0)),
    ],
)
def test_measures(both, measure, expected):
    assert tuple(measure(*both).select(*FIELDS).first()) == pytest.approx(expected, abs=1e-6)


def test_information_measures(both):
    assert tuple(ev.v_measure(*both).first()) == pytest.approx((0.666667, 0.420620, 0.515804), abs=1e-6)
    assert ev.adjusted_rand(*both).first()[0] == pytest.approx(0.242424, abs=1e-6)
    assert tuple(ev.adjusted_mutual_info(*both).first()) == pytest.approx((0.462098, 0.277259, 0.298792), abs=1e-6)
    assert ev.adjusted_mutual_info(*both, average="max").first()[2] == pytest.approx(0.225042, abs=1e-6)


def test_known_pairwise_values(spark):
    truth, pred = clustering(spark, {1: "abc", 2: "d"}), clustering(spark, {1: "bc", 2: "de"})
    assert tuple(ev.pairwise(truth, pred).select(*FIELDS).first()) == (1, 2, 1, 3)
    assert tuple(ev.pairwise_negative(truth, pred).select(*FIELDS).first()) == (2, 4, 2, 3)


def test_edge_cases(spark, both):
    truth, pred = both
    empty = pred.filter("false")
    assert tuple(ev.b_cubed(truth, empty).select(*FIELDS, "f1").first()) == (0, 0, 0, 7, 0)
    assert tuple(ev.pairwise_negative(truth, empty).select(*FIELDS).first()) == (0, 0, 0, 12)
    assert ev.v_measure(truth, truth).first()[2] == pytest.approx(1)
    assert ev.adjusted_mutual_info(truth, truth).first()[2] == pytest.approx(1)
    one = clustering(spark, {1: "abcdefg"})
    assert ev.adjusted_rand(one, one).first()[0] == 1
    assert ev.adjusted_mutual_info(one, one).first()[2] == 1
    assert ev.v_measure(truth, one).first()[0] == 0


def test_against_enumerated_pairs(spark):
    rng = random.Random(3)
    t = {i: rng.randrange(4) for i in range(30) if rng.random() < 0.9}
    p = {i: rng.randrange(6) for i in range(30) if rng.random() < 0.9}
    truth = spark.createDataFrame(list(t.items()), "item long, cluster long")
    pred = spark.createDataFrame(list(p.items()), "item long, cluster long")

    def pairs(c, same):
        return {x for x in itertools.combinations(sorted(c), 2) if (c[x[0]] == c[x[1]]) == same}

    for measure, same in ((ev.pairwise, True), (ev.pairwise_negative, False)):
        a, b = pairs(t, same), pairs(p, same)
        assert tuple(measure(truth, pred).select(*FIELDS).first()) == (len(a & b), len(b), len(a & b), len(a))
    forward, backward = ev.v_measure(truth, pred).first(), ev.v_measure(pred, truth).first()
    assert (forward[0], forward[1]) == pytest.approx((backward[1], backward[0]))
    assert rows(ev.mention_setops(truth, pred)) == sorted(
        [(i, "truth") for i in set(t) - set(p)] + [(i, "pred") for i in set(p) - set(t)], key=repr
    )


def heaviest(w):
    """Of a table ``{(t, p): w}``, by trying everything."""
    t = sorted({a for a, _ in w})

    def best(i, used):
        if i == len(t):
            return 0.0
        others = [w[t[i], p] + best(i + 1, used | {p}) for p in {b for _, b in w} - used if (t[i], p) in w]
        return max([best(i + 1, used), *others])

    return best(0, frozenset())


def random_table(rng, whole):
    return {
        (i, j): float(rng.choice([1, 1, 2, 3, 7])) if whole else rng.choice([0.5, 0.25, 1 / 3, rng.random() + 0.01])
        for i in range(rng.randrange(1, 6)) for j in range(rng.randrange(1, 7)) if rng.random() < 0.7
    }


def test_auction_in_one_task():
    import pandas as pd

    rng = random.Random(0)
    for k in range(300):
        table = random_table(rng, k % 2 == 0) or {(0, 0): 1.0}
        part = pd.DataFrame([(str(a), str(b), w) for (a, b), w in table.items()], columns=["t", "p", "w"])
        assert matching._solve(part, k % 2 == 0)["total"][0] == pytest.approx(heaviest(table), abs=1e-9)


@pytest.mark.parametrize(("whole", "n"), [(True, 60), (False, 10)])
def test_matching(spark, whole, n):
    """Many tables as one graph, with the components in tasks and in a distributed auction of small blocks."""
    rng = random.Random(9)
    tables = [random_table(rng, whole) for _ in range(n)]
    edges = [(f"t{k} {i}", f"p{k} {j}", w) for k, table in enumerate(tables) for (i, j), w in table.items()]
    expected = sum(map(heaviest, tables))
    df = spark.createDataFrame(edges, "t string, p string, w double")
    assert matching.best_matching(df, whole).first()[0] == pytest.approx(expected, abs=1e-6)
    assert matching.best_matching(df, whole, local_edges=8, block_edges=100).first()[0] == pytest.approx(expected, abs=1e-6)
    assert matching.best_matching(df.limit(0)).first()[0] == 0


def test_sets_and_sizes(spark, both):
    truth, pred = both
    sets = ev.mapping_to_sets(truth)
    assert rows(sets, "cluster", "items") == [("1", ["a", "b", "c"]), ("2", ["d", "e", "f", "g"])]
    assert rows(ev.sets_to_mapping(sets)) == rows(truth)
    assert rows(ev.cluster_size_hist(pred)) == [(2, 2), (4, 1)]
    assert tuple(ev.cluster_size_thresholds(pred, (2, 3)).first()) == (3, 3, 1)
    assert rows(ev.drop_small_clusters(pred, 2), "cluster") == [("3",)] * 4
    labels = truth.withColumnRenamed("cluster", "label")
    assert rows(ev.label_cluster_coverage(labels, pred, 2)) == [("1", 3, 0, 0), ("2", 4, 2, 1)]
    assert rows(ev.label_cluster_counts(labels, pred, 1)) == [("1", "1", 2), ("1", "2", 1), ("2", "2", 1), ("2", "3", 2)]
    assert {(r.t, r.p): (r.n, r.share) for r in ev.confusion_pct(truth, pred).collect()}["2", "3"] == (2, pytest.approx(2 / 3))


def test_expected_mutual_information(spark):
    """Against the sum over all overlaps; the last sizes make the lowest overlap's probability smaller than a double can be."""
    from math import exp, lgamma, log

    def expected(sizes_a, sizes_b):
        n, total = sum(sizes_a), 0.0
        for a in sizes_a:
            for b in sizes_b:
                for k in range(max(1, a + b - n), min(a, b) + 1):
                    lp = lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1)
                    lp -= lgamma(k + 1) + lgamma(a - k + 1) + lgamma(b - k + 1) + lgamma(n - a - b + k + 1)
                    total += k / n * log(k * n / (a * b)) * exp(lp)
        return total

    for sizes_a, sizes_b in (([3, 2, 2, 1], [4, 4]), ([8], [8]), ([1] * 6, [2, 2, 2]), ([7, 1], [1, 7]), ([5000, 4000, 1000], [6000, 4000])):
        a = spark.createDataFrame([(x,) for x in sizes_a], "a long")
        b = spark.createDataFrame([(x,) for x in sizes_b], "b long")
        got = spark.range(1).select(ev.expected_mutual_information(a, b, a.agg(F.sum("a")).scalar()).alias("e")).first().e
        assert got == pytest.approx(expected(sizes_a, sizes_b), rel=1e-7, abs=1e-12)


def test_few_clusters_on_one_side_need_no_auction(spark, monkeypatch):
    """A graph of 12 and 300 clusters is matched in one task after one round of certain matches."""
    import pandas as pd

    rng = random.Random(5)
    edges = [(f"t{i}", f"p{j}", 1.0 / rng.randint(2, 9)) for i in range(300) for j in range(12)]
    df = spark.createDataFrame(edges, "t string, p string, w double")
    assert matching.heaviest_enough(df, 300, 12).count() == 12 * 12
    small = edges[: 12 * 30]
    expected = matching._solve(pd.DataFrame(small, columns=["t", "p", "w"]), False)["total"][0]
    monkeypatch.setattr(matching, "_auctioned", lambda *_: pytest.fail("an auction"))
    assert matching.best_matching(spark.createDataFrame(small, df.schema), local_edges=8).first()[0] == pytest.approx(expected, abs=1e-6)


def test_auction_of_many_clusters(spark):
    rng = random.Random(7)
    table = random_table(rng, True)
    df = spark.createDataFrame([(f"t{i}", f"p{j}", w) for (i, j), w in table.items()], "t string, p string, w double")
    assert matching.best_matching(df, True, local_edges=1, narrow=0).first()[0] == pytest.approx(heaviest(table), abs=1e-6)


def test_shortest_paths_in_one_task():
    import pandas as pd

    rng = random.Random(6)
    for k in range(300):
        table = random_table(rng, k % 2 == 0) or {(0, 0): 1.0}
        part = pd.DataFrame([(str(a), str(b), w) for (a, b), w in table.items()], columns=["t", "p", "w"])
        assert matching._by_paths(part)["total"][0] == pytest.approx(heaviest(table), abs=1e-9)

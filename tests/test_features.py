import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairspace.functions.text import sanitize
from pairspace.functions.vectors import dense_to_sparse, sparse_to_dense
from pairspace.operators import association, counts, similarity, vectors
from pairspace.plans.numbering import dense_ids
from pairspace.plans.skew import gather, shared_group_pairs

FEATURES = [
    ("dog", "cat", "X chased Y", "s1"),
    ("dog", "cat", "X chased a Y", "s1"),
    ("dog", "cat", "X chased Y", "s2"),
    ("cow", "hay", "X chased Y", "s3"),
    ("cow", "hay", "X eats Y", "s3"),
]


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame(FEATURES, "noun1 string, noun2 string, pattern string, sentence string")


def test_frequencies(features):
    tables = counts.frequencies(features)
    assert rows(tables["pair"]) == [("cow", "hay", 2, 2), ("dog", "cat", 3, 2)]
    assert rows(tables["pattern"]) == [("X chased Y", 3, 2), ("X chased a Y", 1, 1), ("X eats Y", 1, 1)]
    assert rows(tables["sentence"]) == [("s1", 2, 1), ("s2", 1, 1), ("s3", 2, 1)]
    assert rows(tables["pair_pattern"])[-1] == ("dog", "cat", "X chased a Y", 1)
    assert [r.patterns for r in counts.patterns_of_pairs(features).filter("noun1 = 'dog'").collect()] == [["X chased Y", "X chased a Y"]]


def test_dictionaries_and_vectors(features):
    pairs = counts.pair_dictionary(features, 0, 1)
    assert rows(pairs, "id", "noun1") == [(1, "dog"), (2, "cow")]
    assert rows(counts.pattern_dictionary(features, 0, 1), "id", "pattern") == [(1, "X chased Y")]
    every = counts.pattern_dictionary(features, 0, 0)
    made = vectors.feature_vectors(features, pairs, every, 0, 1)
    assert rows(made.vectors.groupBy("id").count()) == [(1, 2), (2, 2)]
    assert vectors.feature_vectors(features, pairs, every, 1, 1).vectors.count() == 0
    one = vectors.feature_vectors(features, pairs, every, 1, 0)
    assert rows(one.vectors) == [(1, 1, 2)]
    assert rows(one.pairs, "id", "noun1", "noun2", "freq") == [(1, "dog", "cat", 3)]
    assert rows(one.index_map) == [(1, 1)]


def test_rotation(spark):
    twice = spark.createDataFrame([("dog", "cat", "X chased Y", "s")] * 2, "noun1 string, noun2 string, pattern string, sentence string")
    expected = [
        ("X chased Y", "dog::@::cat", 2.0), ("X chased Y^-1", "cat::@::dog", 2.0), ("cat", "@::X chased Y^-1::dog", 2.0),
        ("cat", "dog::X chased Y::@", 2.0), ("dog", "@::X chased Y::cat", 2.0), ("dog", "cat::X chased Y^-1::@", 2.0),
    ]
    assert rows(association.jobim_rotate(twice)) == sorted(expected, key=repr)
    assert rows(association.jobim_rotate(twice, flipped=True), "bim", "jo", "cnt") == sorted(expected, key=repr)


def test_association(spark):
    jobim = spark.createDataFrame(
        [("dog", "@::chase::cat", 3.0), ("dog", "@::eat::bone", 1.0), ("cat", "@::eat::bone", 2.0), ("cat", "@::chase::mouse", 2.0)],
        "jo string, bim string, cnt double",
    )
    pooled = {(r.jo, r.bim): r for r in association.association_scores(jobim).collect()}
    first = pooled["dog", "@::chase::cat"]
    assert (first.pmi, first.lmi) == pytest.approx((3.0, 9.0)) and first.npmi == pytest.approx(2.120085, abs=1e-6)
    assert pooled["cat", "@::eat::bone"].lmi == pytest.approx(4.830075, abs=1e-6)
    apart = {(r.jo, r.bim): r.pmi for r in association.association_scores(jobim, totals="separate").collect()}
    assert apart["dog", "@::eat::bone"] == pytest.approx(-0.584963, abs=1e-6)
    single = association.association_scores(jobim.limit(1)).first()
    assert single.npmi is None


VECTORS = [(1, 1, 1.0), (1, 2, 2.0), (2, 2, 2.0), (2, 3, 1.0), (3, 3, 4.0)]


@pytest.mark.parametrize("chunk", [1, 2, 1000])
def test_cosine_distances(spark, chunk):
    df = spark.createDataFrame(VECTORS, "id long, idx long, value double")
    got = {(r.row, r.col): r.distance for r in similarity.cosine_distances(df, chunk=chunk).collect()}
    assert got == {(1, 1): pytest.approx(0), (2, 2): pytest.approx(0), (3, 3): 0, (2, 1): pytest.approx(0.2), (3, 2): pytest.approx(0.552786, abs=1e-6)}
    cut = {(r.row, r.col): r.distance for r in similarity.cosine_distances(df, drop_last_index=True, chunk=chunk).collect()}
    assert cut == {(1, 1): pytest.approx(0), (2, 2): pytest.approx(0), (3, 3): 0, (2, 1): pytest.approx(0.105573, abs=1e-6), (3, 2): 0}
    stats = similarity.matrix_stats(df, similarity.cosine_distances(df, chunk=chunk)).first()
    assert (stats.n_pairs, stats.n_features, stats.n_entries) == (3, 3, 5)


def test_hot_group_is_paired_whole(spark):
    df = spark.range(60).select(F.lit(7).alias("g"), F.col("id").alias("m"), (F.col("id") * 2).alias("v"))
    pairs = shared_group_pairs(df, "g", "m", ["v"], chunk=9)
    assert pairs.count() == pairs.select("hi_m", "lo_m").distinct().count() == 60 * 61 // 2
    assert pairs.filter("hi_v != 2 * hi_m or lo_v != 2 * lo_m or hi_m < lo_m").count() == 0


def test_gather_splits_hot_keys_and_keeps_all(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(2).alias("k"), "id")
    got = gather(df, ["k"], F.col("id"), F.col("id"), "ids", chunk=200)
    assert got.filter("k = 1").count() > 1 and got.filter("k = 2").count() == 1
    assert got.select(F.explode("ids")).distinct().count() == 1000


def test_dense_ids(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    assert dense_ids(df, [F.desc("v")]).filter("id != 5000 - v").count() == 0
    assert dense_ids(df.filter("v < 0"), ["v"]).count() == 0


def test_context_vectors_and_reindex(spark):
    jobim = spark.createDataFrame([("b", "y", 1.0), ("a", "x", 2.0), ("b", "x", 3.0)], "jo string, bim string, cnt double")
    assert rows(vectors.context_vectors(jobim), "id", "jo", "idx", "value") == [(1, "a", 1, 2.0), (2, "b", 1, 3.0), (2, "b", 2, 1.0)]
    moved = vectors.reindex(
        spark.createDataFrame([(1, 5), (1, 6)], "k int, idx long"), spark.createDataFrame([(5, 1)], "prev_id long, new_id long")
    )
    assert rows(moved, "k", "idx") == [(1, 1), (1, None)]


def test_pair_similarity(spark):
    v = spark.createDataFrame([("q", 1, 2.0), ("q", 2, 1.0), ("a", 1, 1.0), ("a", 2, 4.0), ("z", 9, 1.0)], "key string, idx int, value double")
    pairs = spark.createDataFrame([("q", "a"), ("q", "z"), ("q", "none")], "left string, right string")
    for how, value in (("overlap", 2.0), ("dot", 6.0), ("cosine", pytest.approx(0.650791, abs=1e-6))):
        got = {r.right: r.similarity for r in similarity.pair_similarity(pairs, v, how).collect()}
        assert got == {"a": value, "z": 0.0, "none": None}


def test_vector_conversion(spark):
    df = spark.createDataFrame([([0.0, 2.5, 0.0, 1.0],)], "d array<double>")
    sparse = df.select(dense_to_sparse(F.col("d")).alias("s"))
    assert [tuple(e) for e in sparse.first().s] == [(1, 2.5), (3, 1.0)]
    assert sparse.select(sparse_to_dense(F.col("s"), 4)).first()[0] == [0.0, 2.5, 0.0, 1.0]
    assert sparse.select(sparse_to_dense(F.col("s"), 2)).first()[0] == [0.0, 2.5]
    odd = spark.createDataFrame([([(1, 1.0), (-1, 9.0), (1, 3.0)],), ([],)], "s array<struct<idx:int,value:double>>")
    assert [r[0] for r in odd.select(sparse_to_dense(F.col("s"), 3)).collect()] == [[0.0, 3.0, 0.0], [0.0, 0.0, 0.0]]


def test_sanitize(spark):
    df = spark.createDataFrame([("a\x01b\tc\U0001F600d￾",)], "t string")
    assert df.select(sanitize(F.col("t"))).first()[0] == "a b\tc  d "


def test_plans_stay_distributed(spark, features):
    plan = association.association_scores(association.jobim_rotate(features))._jdf.queryExecution().toString()
    assert "SinglePartition, REPARTITION" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    top = association.prune_contexts(spark.createDataFrame([("a", "b", 1.0)], "jo string, bim string, lmi double"), 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_scores_with_sums_before_the_rotation(spark):
    rng = random.Random(6)
    plain = [(rng.choice("abc"), rng.choice("abcd"), rng.choice(["X of Y", "X and Y", "Y for X", "X c Y"])) for _ in range(200)]
    # a noun that is a pattern, and parts that make strings of different views alike
    odd = [("a", "b", "X^-1"), ("a", "b", "X"), ("b", "a", "X"), ("@", "b", "a"), ("a::b", "c", "X"), ("a", "X", "Y")]
    for given in (plain, plain + odd, plain + [("a", "X of Y", "X of Y")], plain[:1], []):
        df = spark.createDataFrame(given, "noun1 string, noun2 string, pattern string")
        for totals in ("pooled", "separate"):
            want = association.association_scores(association.jobim_rotate(df), totals)
            got = association.feature_scores(df, totals)
            shown = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows(want)]
            assert sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows(got)) == sorted(shown)


def test_one_pass_four_outputs(spark):
    given = [*FEATURES, ("dog", None, "X chased Y", "s9"), ("dog", "cat", None, None)]
    df = spark.createDataFrame(given, "noun1 string, noun2 string, pattern string, sentence string")
    stored, counters = counts.store_frequencies(df)
    assert counters == {"features": len(given), "incomplete": 2}
    for name, single in (
        ("sentence", counts.sentence_frequencies), ("pair", counts.pair_frequencies),
        ("pattern", counts.pattern_frequencies), ("pair_pattern", counts.pair_pattern_frequencies),
    ):
        assert stored[name].columns == single(df).columns and rows(stored[name]) == rows(single(df))
    none, counters = counts.store_frequencies(df.limit(0))
    assert counters["features"] == 0 and all(t.isEmpty() for t in none.values())


@pytest.mark.parametrize("chunk", [1, 1000])
def test_frequencies_with_their_sets(spark, chunk):
    given = [*FEATURES, ("dog", None, "X chased Y", "s9"), ("dog", "cat", None, None), (None, None, None, "s1")]
    df = spark.createDataFrame(given, "noun1 string, noun2 string, pattern string, sentence string")
    for made, keys, n, name, plain in (
        (counts.pair_frequencies(df, sets=True, chunk=chunk), ["noun1", "noun2"], "num_patterns", "patterns", counts.pair_frequencies(df)),
        (counts.pattern_frequencies(df, sets=True, chunk=chunk), ["pattern"], "num_pairs", "pairs", counts.pattern_frequencies(df)),
    ):
        assert made.columns == [*keys, "freq", n, "part", name]
        found = {}
        for r in made.collect():
            assert len(r[name]) >= 1 or r[n] == 0
            found.setdefault((*[r[k] for k in keys], r.freq, r[n]), []).extend(tuple(m) if name == "pairs" else m for m in r[name])
        assert sorted(found, key=repr) == rows(plain)
        key = [0, 1] if name == "patterns" else [2]
        for group, members in found.items():
            same = [g for g in given if [g[i] for i in key] == list(group[: len(keys)])]
            want = {g[2] for g in same if g[2] is not None} if name == "patterns" else {g[:2] for g in same}
            assert sorted(members, key=repr) == sorted(want, key=repr) and len(same) == group[-2] and len(want) == group[-1]


def test_rotated_views_are_shuffled_only_where_they_can_be_alike(spark):
    plain = spark.createDataFrame([("a", "b", "X of Y")] * 3 + [("b", "a", "X of Y"), ("a", "a", "X Y z")], "noun1 string, noun2 string, pattern string")
    for flipped in (False, True):
        made = association.jobim_rotate(plain, flipped)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        assert made.count() == 18 == made.select("jo", "bim").distinct().count() and made.agg({"cnt": "sum"}).first()[0] == 30
    # the inverse of one is the other
    odd = spark.createDataFrame([("a", "b", "X^-1"), ("b", "a", "X"), ("b", "a", "X")], "noun1 string, noun2 string, pattern string")
    alike = association.jobim_rotate(odd).filter("jo = 'X^-1' and bim = 'a::@::b'")
    assert rows(alike) == [("X^-1", "a::@::b", 3.0)]


@pytest.mark.parametrize("hot_rows", [3, 2_000_000])
def test_scores_of_hot_patterns(spark, hot_rows):
    rng = random.Random(9)
    given = [(rng.choice("abcde"), rng.choice("abcde"), rng.choice(["X of Y"] * 4 + ["X and Y", "Y for X", "X c Y"])) for _ in range(150)]
    df = spark.createDataFrame(given, "noun1 string, noun2 string, pattern string")
    want = association.association_scores(association.jobim_rotate(df))
    got = association.feature_scores(df, hot_rows=hot_rows)
    planned = got._jdf.queryExecution().executedPlan().toString()
    shown = [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t.collect()) for t in (want, got)]
    assert shown[0] == shown[1] and len(shown[0]) > 100
    # rows travel by pattern and by pair; before they were joined to five sums
    if hot_rows > 150:
        assert planned.count("Exchange hashpartitioning") <= 2

"""The threshold join against brute force, and what it forms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pairspace.operators import similarity
from pairspace.operators.similarity import candidate_pairs, cosine_distances, equal_vectors, indexed_entries, matrix_stats, similar_pairs
from pairspace.plans.skew import shared_group_pairs


def some_vectors(seed, n=120, features=25):
    rng = random.Random(seed)
    made = {}
    for i in range(n):
        if i % 4 == 3:
            made[i] = {f: v * rng.choice([1, 1, 1.3]) for f, v in made[i - 1].items()}
        else:
            # feature 0 is in nearly all, low numbers are common
            made[i] = {min(features - 1, int(rng.expovariate(0.15))): rng.choice([1.0, 2.0, -1.0, 5.0]) for _ in range(rng.randrange(1, 9))} | ({0: 1.0} if rng.random() < 0.9 else {})
    return made | {500: {1: 0.0}, 501: {2: 3.0}, 502: {2: 7.0}}


def cosine(a, b):
    na, nb = (math.sqrt(sum(x * x for x in v.values())) for v in (a, b))
    return sum(a[f] * b[f] for f in a.keys() & b.keys()) / (na * nb) if na and nb else 0.0


@pytest.mark.parametrize("least", [0.1, 0.5, 0.8, 0.95, 1.0])
def test_similar_pairs(spark, least):
    vectors = some_vectors(int(least * 100))
    df = spark.createDataFrame([(i, f, v) for i, e in vectors.items() for f, v in e.items()] + [(None, 1, 1.0)], "id long, idx int, value double")
    # bounds that rounding decides are left to it
    sure = {(a, b) for a in vectors for b in vectors if a > b and cosine(vectors[a], vectors[b]) > least + 1e-9}
    maybe = {(a, b) for a in vectors for b in vectors if a > b and cosine(vectors[a], vectors[b]) >= least - 1e-9}
    got = {(r["row"], r["col"]): r["similarity"] for r in similar_pairs(df, least, chunk=10).collect()}
    assert sure <= got.keys() <= maybe
    assert all(abs(s - cosine(vectors[a], vectors[b])) < 1e-9 for (a, b), s in got.items())


@pytest.mark.parametrize(("least", "crowd", "block", "groups"), [(0.3, 1, 13, 4), (0.8, 3, 1000, 1), (0.95, 16, 30, 1024)])
def test_similar_pairs_in_blocks(spark, monkeypatch, least, crowd, block, groups):
    """Vectors that meet many others are compared in blocks, with few dense columns too; the rest still meets them."""
    monkeypatch.setattr(similarity, "OWN", groups)
    monkeypatch.setattr(similarity, "SHARED", groups)
    monkeypatch.setattr(similarity, "ROWS_AT_ONCE", 7)
    vectors = some_vectors(7)
    df = spark.createDataFrame([(f"k{i}", f, v) for i, e in vectors.items() for f, v in e.items()], "id string, idx int, value double")
    sure = {frozenset((f"k{a}", f"k{b}")) for a in vectors for b in vectors if a > b and cosine(vectors[a], vectors[b]) > least + 1e-9}
    maybe = {frozenset((f"k{a}", f"k{b}")) for a in vectors for b in vectors if a > b and cosine(vectors[a], vectors[b]) >= least - 1e-9}
    rows = similar_pairs(df, least, crowd=crowd, block=block).collect()
    got = {frozenset((r["row"], r["col"])): r["similarity"] for r in rows}
    assert len(rows) == len(got) and sure <= got.keys() <= maybe
    assert all(r["row"] > r["col"] for r in rows)
    assert all(abs(s - cosine(*(vectors[int(k[1:])] for k in pair))) < 1e-9 for pair, s in got.items())


def test_crowded_features_form_no_pairs_in_a_join(spark, monkeypatch):
    """Every vector indexes the same feature: joined there, they would form the square of their number."""
    formed = []
    monkeypatch.setattr(similarity, "shared_group_pairs", lambda *a, **k: formed.append(shared_group_pairs(*a, **k)) or formed[-1])
    rows = [(i, f, w) for i in range(400) for f, w in ((0, 1.0), (1 + i, 1.0))]
    df = spark.createDataFrame(rows, "id long, idx int, value double")
    assert similar_pairs(df, 0.4).count() == 400 * 399 // 2
    assert formed[0].count() == 0


def test_common_features_form_no_pairs(spark):
    """Every vector has the two common features, which carry nearly half of its length: they are not indexed."""
    rows = [(i, f, w) for i in range(600) for f, w in ((0, 3.0), (1, 2.0), (10 + i // 2, 4.0), (1000 + i, 1.0))]
    df = spark.createDataFrame(rows, "id long, idx int, value double")
    unit = df.withColumn("v", F.col("value") / F.lit(math.sqrt(30.0)))
    index = indexed_entries(unit.select("id", "idx", "v"), 0.8)
    assert index.filter("idx < 2").count() == 0
    assert shared_group_pairs(index, "idx", "id", []).filter("hi_id <> lo_id").count() == 300
    assert similar_pairs(df, 0.8).count() == 300


def test_equal_vectors(spark):
    rows = [(1, "a", 1.0), (1, "b", 2.0), (2, "b", 2.0), (2, "a", 1.0), (3, "a", 2.0), (3, "b", 1.0), (4, "a", 1.0), (0, "a", 1.0)]
    got = equal_vectors(spark.createDataFrame(rows, "id long, idx string, value double"))
    assert {r.id: r["first"] for r in got.collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 0}


@pytest.mark.parametrize("long_vector", [3, 10_000])
def test_all_pairs(spark, monkeypatch, long_vector):
    """Every pair that shares a feature, with small groups, tasks and shares as with large ones; entries may repeat."""
    monkeypatch.setattr(similarity, "LONG_VECTOR", long_vector)
    monkeypatch.setattr(similarity, "TASK_PAIRS", 500)
    vectors = some_vectors(4, n=80)
    entries = [(i, f, v) for i, e in vectors.items() for f, v in e.items()]
    df = spark.createDataFrame([*entries, (None, 1, 1.0), (1, None, 1.0), (7, 24, 1.0), (7, 24, 1.0)], "id long, idx int, value double")
    vectors[7][24] = vectors[7].get(24, 0.0) + 2.0
    expected = {(a, b) for a in vectors for b in vectors if a >= b and vectors[a].keys() & vectors[b].keys()}
    found = [tuple(r) for r in candidate_pairs(df, chunk=10).collect()]
    assert sorted(found) == sorted(expected)
    apart = {r[:2]: r[2] for r in map(tuple, cosine_distances(df, skip_value=None, chunk=10).collect())}
    assert apart.keys() == expected
    assert all(abs(1 - d - cosine(vectors[a], vectors[b])) < 1e-9 for (a, b), d in apart.items() if 7 not in (a, b) and 500 not in (a, b))


def test_pairs_are_formed_after_the_shuffle(spark):
    """The pairs of vectors are summed in the tasks that form them: no exchange stands above the explode."""
    df = spark.createDataFrame([(i, j, 1.0) for i in range(30) for j in range(5)], "id long, idx int, value double")
    plan = candidate_pairs(df)._jdf.queryExecution().executedPlan().toString()
    top = plan.split("Generate explode(arrays_zip")[0]
    assert "Generate explode(arrays_zip" in plan and "Exchange" not in top


def test_matrix_stats_counts_each_column_by_itself(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (1, 6, 2.0), (2, 5, 1.0), (None, 7, 1.0), (2, None, 1.0)], "id long, idx int, value double")
    stats = matrix_stats(df, cosine_distances(df, skip_value=None))
    assert "Expand" not in stats._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in stats.collect()] == [(3, 2, 3)]
    assert [tuple(r) for r in matrix_stats(df.limit(0), cosine_distances(df.limit(0))).collect()] == [(0, 0, 0)]
